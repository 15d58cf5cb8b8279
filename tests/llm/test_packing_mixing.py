import zlib

import numpy as np
import pytest

from panelweave.llm import mixing, packing
from panelweave.llm.queries import tokenizer_path

from .brute import WORD


def check_packing(rows, pieces, ids_of, capacity):
    """Each document's ids lie in exactly one piece each, and sequences are full or powers of two."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for seq in by_seq.values():
        seq.sort()
        assert [o for o, _ in seq] == list(np.cumsum([0] + [n for _, n in seq])[:-1])
        total = sum(n for _, n in seq)
        assert total <= capacity and total & (total - 1) == 0
    for d, t in rows:
        ids = ids_of(t)
        mine = sorted(by_doc[d], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in mine) == np.array(ids, "<u4").tobytes()
        assert all(p.doc_tokens == len(ids) and p.length * 4 == len(p.ids) for p in mine)
        assert [p.start for p in mine] == list(np.cumsum([0] + [p.length for p in mine])[:-1])


@pytest.mark.parametrize("capacity,parts", [(2048, 1), (64, 3)])
def test_round_trip(make, edge, capacity, parts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = [(i, t) for i, (d, t, *_) in enumerate(edge)] + [(100, "<|endoftext|> It's İstanbul, ΣΑΣ 42nd é  x y <|STARTOFTEXT|>")]
    pieces = packing.pack(make(rows).repartition(parts), tokenizer_path(), capacity).collect()
    check_packing(rows, pieces, lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1], capacity)


def test_packing_edges(make, edge):
    docs = make(edge, clashes=True)
    got = packing.pack(docs, tokenizer_path()).collect()
    assert sum(p.start == 0 for p in got) == len(edge)  # repeated rows and a null id are documents too
    assert all(zlib.crc32(bytes(p.ids)) >= 0 for p in got)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_fill_gives_shortages_to_siblings():
    assert mixing.fill(10, [100, 100], [1, 1]) == [5, 5]
    assert mixing.fill(10, [2, 100], [1, 1]) == [2, 8]
    assert mixing.fill(10, [2, 3, 100], [1, 1, 2]) == [2, 2 + 2 / 3, 5 + 1 / 3] or sum(mixing.fill(10, [2, 3, 100], [1, 1, 2])) == pytest.approx(10)
    assert mixing.fill(10, [2, 3], [1, 1]) == [2, 3]


def test_shortage_stays_under_its_parent_while_siblings_have_room():
    tokens = {("web", "en", "a"): 10, ("web", "en", "b"): 1000, ("books", "en", "c"): 1000, ("books", "de", "d"): 5}
    weights = ({"web": 1.0, "books": 1.0}, {}, {})
    q = mixing.quotas(tokens, 400, weights, epochs=2)
    assert q == {("web", "en", "a"): 20, ("web", "en", "b"): 180, ("books", "en", "c"): 190, ("books", "de", "d"): 10}
    assert mixing.quotas({("x", "y", "z"): 7}, 100, ({}, {}, {}), 2) == {("x", "y", "z"): 14}


@pytest.fixture(scope="module")
def sources(make):
    rows = []
    for i in range(400):
        source = ["src0", "src0", "src0", "src1", "src2", "src4", None][i % 7]
        rows.append((i, " ".join(["w"] * (i * 37 % 61)), ["en", "en", "de", None][i % 4], source))
    return make(rows)


def test_mix_matches_a_plain_prefix(spark, sources):
    """Each leaf: whole epochs, then the shortest prefix of its seeded order that reaches the rest."""
    order = {(r.doc_id, r.e): r.p for r in sources.selectExpr("doc_id", "explode(array(0L, 1L, 2L)) as e").select("doc_id", "e", mixing._order(mixing.F.col("doc_id"), mixing.F.col("e"), mixing.SEED).alias("p")).collect()}
    docs = {}
    for r in sources.select("doc_id", "text", *mixing.leaf_columns()).collect():
        docs.setdefault((r.domain, r.lang, r.source), []).append((r.doc_id, len(WORD.findall(r.text))))
    tokens = {leaf: sum(n for _, n in ds) for leaf, ds in docs.items()}
    plan = mixing.quotas(tokens, mixing.SHARE * sum(tokens.values()))
    want = set()
    for leaf, ds in docs.items():
        whole, rest = divmod(plan[leaf], tokens[leaf])
        want |= {(d, e) for d, _ in ds for e in range(whole)}
        for d, n in sorted(ds, key=lambda x: order[x[0], whole]):
            if rest <= 0:
                break
            want.add((d, whole))
            rest -= n
    got = [(r.doc_id, r.epoch) for r in mixing.mix_sources(sources).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(e for _, e in got)


def test_mixing_edges(make, edge):
    docs = make(edge, clashes=True)
    out = mixing.mix_sources(docs)
    assert [c for c in out.columns if c not in ("epoch", "n_tokens")] == [c for c in docs.columns if c != "epoch"] and out.count() > 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(make([(1, None), (2, "")])).count() == 0


def test_words_are_forgotten_and_learned_again(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from panelweave.llm.common import utf8

    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    path = tokenizer_path()
    table, tok = packing.WordIds(path), Tokenizer.from_file(path)
    common = [f"common{i}" for i in range(50)]
    for k in range(12):
        texts = [" ".join([*common, *(f"rare{k}x{i}" for i in range(90)), packing.PARTING if k == 5 else "", "é, ß! 42%"]), None, "", f"a{packing.PARTING}b" if k == 7 else "x"]
        ids, bounds = table.ids(*utf8(pa.array(texts)))
        for t, lo, hi in zip(texts, bounds[:-1], bounds[1:]):
            assert ids[lo:hi].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, packing.END]
        assert len(table.place) <= 300 + 100
    assert all(w.encode() in table.place for w in common)
