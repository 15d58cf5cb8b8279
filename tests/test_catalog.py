"""A spread of registered queries against their oracles at the smallest scale."""

import math

import pytest

import __spark_entry__ as entry
from panelweave.plans import load_catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["bars_from_trades", "top_momentum_names", "rsi", "macd", "rolling_max_drawdown", "asof_release_join", "macro_transforms", "regime", "consensus", "symbol_normalization", "event_bars", "block_reasons"]


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else str(v)[:19]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_registry_is_complete_and_lazy():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    own = load_catalog()
    assert len(own) > 120 and sum(x.sql is None for x in own.values()) <= 8 and set(own) <= set(q)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["region", "entity", "ts", "place", "mom", "mom_pct"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(repr, map(canon, r))) for r in df.select(*cols).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    want = sorted(tuple(map(repr, map(canon, r))) for r in rel.select(*cols).fetchall())
    assert got == want
