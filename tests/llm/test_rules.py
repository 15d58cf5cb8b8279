import re

import pytest

from panelweave.llm import rules

from .brute import WORD


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    first, hit = {}, [0] * len(w)
    for i in range(len(w) - 7):
        first.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in first.values():
        if len(places) > 1:
            for i in places:
                hit[i : i + 8] = [1] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(hit)


@pytest.fixture(scope="module")
def texts(edge):
    base = " ".join(f"t{i}" for i in range(8))
    return edge + [(20, base), (21, base + " " + base), (22, base + " q " + base + " r " + base), (23, ("a b c d " * 9).strip()), (24, "#$ | < > && **" * 3)]


def test_measures_match_brute_force(make, texts):
    got = rules.ledger(make(texts)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[2:] == brute(r.text), r.doc_id


def test_policies_and_ablations(make, texts):
    entries = rules.ledger(make(texts, clashes=True)).cache()
    rows = entries.collect()
    for version in rules.POLICIES:
        m = rules.mask(version)
        kept = {r.doc_id for r in entries.filter(rules.verdict(entries.fail_bits, version)).collect()}
        assert kept == {r.doc_id for r in rows if not r.fail_bits & m}
        for a in rules.ablations(entries, version).collect():
            bit = 1 << next(x.bit for x in rules.RULES if x.name == a.rule)
            assert a.failed == sum(1 for r in rows if r.fail_bits & m & bit)
            assert a.failed_alone == sum(1 for r in rows if r.fail_bits & m == bit)
            assert a.kept_without == sum(1 for r in rows if not r.fail_bits & m & ~bit)


def test_keep_returns_the_columns_of_the_documents(make, texts):
    docs = make(texts, clashes=True)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    assert {4, 5, 6, 13} <= {r.doc_id for r in kept.collect()} and rules.keep(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(make):
    plan = rules.ledger(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
