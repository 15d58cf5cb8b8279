import corpus_pipeline as pipeline
import numpy as np

from panelweave.llm import rules
from panelweave.llm.queries import tokenizer_path

from .brute import WORD, removed_words
from .test_packing_mixing import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in pipeline.STAGES:
        inputs[name] = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "harmonic_packing" or docs.columns == columns
    ruled, alike, cut, mixed = (inputs[n] for n in ("simhash_near_dedup", "substring_dedup", "source_mixing", "harmonic_packing"))
    entries = rules.ledger(inputs["quality_rules"]).collect()
    assert {r.doc_id for r in ruled.collect()} == {r.doc_id for r in entries if not r.fail_bits & rules.mask("v1")}

    before, kept = {r.doc_id: r.text for r in ruled.collect()}, [r.doc_id for r in alike.collect()]
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in before.items() for w in [WORD.findall(t.lower())]}
    assert len(kept) == len(set(kept)) < len(before)
    for d in before.keys() - set(kept):  # what went has a near copy
        assert max(len(shingles[d] & shingles[e]) / len(shingles[d] | shingles[e]) for e in before if e != d) >= 0.8
    for i, d in enumerate(kept):  # what stayed has none beyond doubt
        assert all(len(shingles[d] & shingles[e]) / len(shingles[d] | shingles[e]) < 0.8 for e in kept[:i])

    rows = [(r.doc_id, r.text) for r in alike.collect()]
    want = removed_words(rows)
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) == {d for d, (n, gone, _) in want.items() if gone == 0 or gone < n}
    for d, t in rows:
        if d in after:
            n, gone, _ = want[d]
            assert len(WORD.findall(after[d].text)) == n - gone and (gone or after[d].text == t) and after[d].n_chars == len(after[d].text)

    assert {r.doc_id for r in mixed.collect()} <= set(after)
    tok = Tokenizer.from_file(tokenizer_path())
    pieces = docs.collect()
    drawn = [r for r in mixed.collect()]
    assert sum(p.length for p in pieces) == sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in drawn)
    once = {}
    for r in drawn:
        once.setdefault(r.doc_id, []).append(r.text)
    single = [(d, t[0]) for d, t in once.items() if len(t) == 1]
    check_packing(single, pieces, lambda t: [*tok.encode(t, add_special_tokens=False).ids, 1], 2048)


def test_run_counts_as_the_stages(spark):
    out = pipeline.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0 and np.isfinite(out.selectExpr("sum(length)").first()[0])


def test_stages_keep_own_columns_and_take_an_empty_table(spark, make):
    words = " ".join(f"k{i}" for i in range(60))
    rows = [(1, words), (2, words + " end"), (3, " ".join(f"z{i}" for i in range(40)) + " " + words), (4, " ".join(f"y{i}" for i in range(50))), (None, None)]
    docs = make(rows, clashes=True)
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", *(f"'mine' AS {c}" for c in ("kept", "runs", "n_removed", "n_symbols", "epoch", "n_tokens", "size", "root")))
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for c in docs.columns[5:]:
            assert {r[0] for r in out.select(c).distinct().collect()} <= {"mine"}, (name, c)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert pipeline.STAGES[4][1](spark, docs, SF).count() > 0 and pipeline.STAGES[4][1](spark, docs.limit(0), SF).count() == 0
