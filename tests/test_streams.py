"""The ledger's commit log, its JSON-lines form, and outcomes by keyed state."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from panelweave.operators import ledger as lg
from panelweave.sources import ledger_store as store
from panelweave.streaming import ledger as sl
from panelweave.streaming import maturity as mt
from panelweave.streaming import replay as rp

COLS = [f.name for f in store.LEDGER_SCHEMA.fields]
DAY = dt.date(2024, 1, 1)


def records(spark, *rows):
    return spark.createDataFrame([{**dict.fromkeys(COLS), **r} for r in rows], store.LEDGER_SCHEMA)


def rec(i, alpha=0.0, day=DAY):
    return {"id": i, "date": day, "alpha": alpha}


def stored(spark, path):
    return sorted((r.id, r.alpha) for r in store.read_ledger(spark, path).collect())


# ------------------------------------------------------------------ commit log
def test_files_of_a_writer_that_died_are_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    store.append_ledger(records(spark, rec("a")), path, query="q", epoch=0)

    def dies(self, number, entry):
        raise RuntimeError("killed between files and commit")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(store.CommitLog, "claim", dies)
        store.append_ledger(records(spark, rec("b")), path, query="q", epoch=1)
    assert len(list((tmp_path / "ledger" / "data").iterdir())) == 2 and stored(spark, path) == [("a", 0.0)]
    assert store.append_ledger(records(spark, rec("b")), path, query="q", epoch=1)  # replayed
    assert not store.append_ledger(records(spark, rec("b", 9.0), rec("c")), path, query="q", epoch=1)  # and once more
    assert stored(spark, path) == [("a", 0.0), ("b", 0.0)]


def test_two_writers_at_once_write_an_id_once(spark, tmp_path, monkeypatch):
    path, real, ahead = str(tmp_path / "ledger"), store.CommitLog.claim, []

    def raced(self, number, entry):
        if not ahead:  # another writer is faster, just before this one claims its number
            ahead.append(1)
            store.append_ledger(records(spark, rec("a", 1.0), rec("x", 1.0)), path)
        return real(self, number, entry)

    monkeypatch.setattr(store.CommitLog, "claim", raced)
    store.append_ledger(records(spark, rec("a", 2.0), rec("y", 2.0)), path)
    assert stored(spark, path) == [("a", 1.0), ("x", 1.0), ("y", 2.0)]


def test_threads_append_disjoint_and_shared_ids(spark, tmp_path):
    path = str(tmp_path / "ledger")
    jobs = [threading.Thread(target=store.append_ledger, args=(records(spark, rec("shared", float(k)), rec(f"own{k}")), path)) for k in range(4)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert [i for i, _ in stored(spark, path)] == ["own0", "own1", "own2", "own3", "shared"]


def test_rows_without_a_date_or_id_and_other_dates(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for _ in range(2):
        store.append_ledger(records(spark, rec("a"), rec("n", day=None), {"id": None, "date": DAY}), path)
    store.append_ledger(records(spark, rec("b", day=dt.date(2030, 1, 1))), path)
    store.append_ledger(records(spark), path)
    assert stored(spark, path) == [("a", 0.0), ("b", 0.0)]
    assert store.read_ledger(spark, str(tmp_path / "none")).count() == 0


def test_json_lines(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    path.write_text('{"id": "a", "date": "2024-01-01", "alpha": 1.5}\n\n   \n{"id": "b", "date": "2024-01-02"}\n')
    got = [(r.id, str(r.date), r.alpha) for r in store.read_jsonl(spark, str(path)).orderBy("id").collect()]
    assert got == [("a", "2024-01-01", 1.5), ("b", "2024-01-02", None)]
    store.write_jsonl(store.read_jsonl(spark, str(path)), str(tmp_path / "again"))
    assert store.read_jsonl(spark, str(tmp_path / "again")).count() == 2 and '"alpha":null' in "".join(p.read_text() for p in (tmp_path / "again").glob("part*"))
    path.write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        store.read_jsonl(spark, str(path)).collect()
    assert store.read_jsonl(spark, str(tmp_path / "missing.jsonl")).count() == 0


def test_a_stream_replayed_from_scratch_writes_nothing_twice(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    stream = rp.replay(records(spark, rec("a", 1.0), rec("b", 1.0), rec("a", 3.0), rec("c", 1.0)), F.when(F.col("alpha") > 2, 1).otherwise(0), 2, src, 1)
    for checkpoint in ("cp", "cp", "cp2"):
        rp.drained(sl.start_ledger_append(stream, path, str(tmp_path / checkpoint)))
    assert stored(spark, path) == [("a", 1.0), ("b", 1.0), ("c", 1.0)]


# ------------------------------------------------------------------ outcomes
BAR = "entity string, ts date, close double"
SIG = "id string, date date, entity string, region string, model_version string, view string, alpha double, benchmark string"


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def market(spark):
    rng = random.Random(1)
    spans = {"LIVE": range(0, 40), "HALTED": range(0, 15), "LATE": range(10, 40), "GAPS": [k for k in range(40) if k % 7 < 5]}
    bars = [(e, day(k), 100 + rng.random() * 20) for e, ks in spans.items() for k in ks]
    bars += [("GAPS", day(5), None)]
    signals = [(f"{e}{k}", day(k), e, "US", "m", "POSITIVE", float(k), "B") for e in (*spans, "UNKNOWN") for k in (2, 5, 9, 14, 20, 33)]
    bench = [("B", day(k), 100.0 + k) for k in range(40) if k % 3]
    return spark.createDataFrame(bars, BAR), spark.createDataFrame(signals, SIG), spark.createDataFrame(bench, "benchmark string, ts date, bench double")


def play(spark, tmp_path, bars, signals, bench, step, steps, runs=1, delay="3 days"):
    at = lambda df, kind, when: rp.replay(df, step(F.datediff(when, F.lit(day(0))), kind), steps, str(tmp_path / kind), 1)
    streams = at(bars, "bars", "ts"), at(signals, "signals", "date")
    for _ in range(runs):
        rp.drained(mt.start_maturity(*streams, bench, str(tmp_path / "out"), str(tmp_path / "cp"), (3, 10), delay))
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "horizon", "fwd", "excess", "mfe", "mae").collect()]


def twin(bars, signals, bench, until):
    out = lg.outcomes(signals, bars.where(F.col("ts") < F.lit(day(until))), bench, (3, 10))
    return {(r.id, r.horizon, r.fwd, r.excess, r.mfe, r.mae) for r in out.collect()}


@pytest.mark.parametrize("steps, width", [(1, 40), (4, 10), (14, 3)])
def test_outcomes_are_the_batch_ones_for_any_cut(spark, tmp_path, steps, width):
    bars, signals, bench = market(spark)
    got = play(spark, tmp_path, bars, signals, bench, lambda n, kind: F.floor(n / width), steps)
    want = twin(bars, signals, bench, 39 - 3)
    assert len(got) == len(set(got)) and set(got) == want
    assert {"LIVE2", "HALTED2", "LATE14", "GAPS5"} <= {g[0] for g in got} and not any(g[0] == "LATE2" for g in got)
    assert ("HALTED9", 3) in {g[:2] for g in got} and ("HALTED9", 10) not in {g[:2] for g in got}


def test_disorder_within_the_delay_changes_nothing(spark, tmp_path):
    bars, signals, bench = market(spark)
    shifted = lambda n, kind: F.floor((n + F.pmod(n * 7, F.lit(3))) / 4)
    got = play(spark, tmp_path, bars, signals, bench, shifted, 11, delay="6 days")
    assert set(got) == twin(bars, signals, bench, 39 - 6) and len(got) == len(set(got))


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    bars, signals, bench = market(spark)
    early = lambda df, when: df.where(F.col(when) <= F.lit(day(12)))
    for part, when, name in ((bars, "ts", "bars"), (signals, "date", "signals")):
        early(part, when).repartition(1).write.parquet(str(tmp_path / name))
    args = [spark.readStream.schema(df.schema).parquet(str(tmp_path / n)) for df, n in ((bars, "bars"), (signals, "signals"))]
    run = lambda: rp.drained(mt.start_maturity(*args, bench, str(tmp_path / "out"), str(tmp_path / "cp"), (3, 10), "3 days"))
    run()
    first = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "horizon").collect()}
    assert first and not any(h == 10 and i == "LIVE2" for i, h in first)
    bars.where(F.col("ts") > F.lit(day(12))).repartition(1).write.mode("append").parquet(str(tmp_path / "bars"))
    signals.where(F.col("date") > F.lit(day(12))).repartition(1).write.mode("append").parquet(str(tmp_path / "signals"))
    run()
    run()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "horizon", "fwd", "excess", "mfe", "mae").collect()]
    assert set(got) == twin(bars, signals, bench, 36) and len(got) == len(set(got))


def test_the_state_of_an_entity_is_bounded():
    class State:
        exists, hasTimedOut, wm, value = False, False, 0, None

        def getCurrentWatermarkMs(self):
            return self.wm

        def update(self, v):
            self.value, self.exists = v, True

        def setTimeoutTimestamp(self, t):
            assert t > self.wm

        @property
        def get(self):
            return self.value

    import pandas as pd

    state, step, found = State(), mt._step((3, 10)), 0
    for k in range(500):
        rows = [(k, 100.0 + k, None, None)] + ([(k, None, f"s{k}", "{}")] if k % 50 == 0 else [])
        found += sum(len(x) for x in step(("E",), iter([pd.DataFrame(rows, columns=["day", "close", "id", "text"])]), state))
        state.wm = (k - 3) * mt.DAY_MS if k > 3 else 0
        assert len(state.value[0]) <= 10 + 6 and len(state.value[2]) <= 1
    assert found == 2 * 10
