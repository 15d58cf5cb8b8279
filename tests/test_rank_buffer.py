"""The rank buffer over history against a plain fold."""

import datetime as dt

import numpy as np
import pytest

from panelweave.operators import selection as sel

COLUMNS = "as_of date, region string, entity string, alpha double, above_ma200 boolean, data_insufficient boolean"


def panel(seed, names, dates, regions=("US", "KR"), drift=0.3, missing=0.1):
    rng = np.random.default_rng(seed)
    out = []
    for region in regions:
        alpha = rng.normal(size=names)
        for t in range(dates):
            alpha = alpha + drift * rng.normal(size=names)
            for i in range(names):
                if rng.random() < missing:
                    continue
                day = dt.date(2020, 1, 1) + dt.timedelta(days=30 * t)
                above = None if rng.random() < 0.05 else bool(rng.random() < 0.6)
                out.append((day, region, f"n{i:03d}", float(np.round(alpha[i], 1)), above, bool(rng.random() < 0.1)))
    return out


def fold(rows, start=()):
    """{(region, date): [(entity, qualified, incumbent)]} by the rules, one date after the other."""
    out = {}
    for region in {r[1] for r in rows}:
        held = {e for g, e in start if g == region}
        for day in sorted({r[0] for r in rows if r[1] == region}):
            names = [r for r in rows if r[0] == day and r[1] == region and not r[5]]
            values = sorted(r[3] for r in names)
            share = {r[2]: 100 * (values.index(r[3]) + 1 + values.index(r[3]) + values.count(r[3])) / 2 / len(values) for r in names}
            names.sort(key=lambda r: (-(-1 if r[4] is None else int(r[4])), -r[3], r[2]))
            good = {r[2]: share[r[2]] >= (72 if r[2] in held else 88) for r in names}
            chosen = [r[2] for r in names if good[r[2]]]
            for r in names:
                if len(chosen) >= 8:
                    break
                if r[2] not in chosen:
                    chosen.append(r[2])
            chosen = chosen[:12]
            out[region, day] = [(e, good[e], e in held) for e in chosen]
            held = set(chosen)
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.pick):
        out.setdefault((r.region, r.as_of), []).append((r.entity, r.qualified, r.incumbent))
    return out


@pytest.mark.parametrize("names, dates, drift, missing", [(120, 14, 0.3, 0.1), (9, 10, 1.0, 0.3), (400, 5, 0.1, 0.0)])
def test_against_a_plain_fold(spark, names, dates, drift, missing):
    rows = panel(names, names, dates, drift=drift, missing=missing)
    got = result(sel.select_over_time(spark.createDataFrame(rows, COLUMNS)))
    assert got == {k: v for k, v in fold(rows).items() if v}
    kept = [x for v in got.values() for x in v]
    assert any(i for _, _, i in kept) and any(not i for _, _, i in kept)


def test_start_holdings_and_path_dependence(spark):
    rows = panel(7, 100, 8, regions=("US",), drift=0.2)
    start = [("US", f"n{i:03d}") for i in range(0, 100, 7)]
    df = spark.createDataFrame(rows, COLUMNS)
    held = spark.createDataFrame(start, "region string, entity string")
    assert result(sel.select_over_time(df, held)) == fold(rows, start) != fold(rows)


def test_a_date_without_eligible_names_ends_the_holdings(spark):
    days = [dt.date(2024, m, 1) for m in (1, 2, 3)]
    rows = [(d, "US", f"n{i:02d}", float(-i if d == days[0] else (i * 7) % 50), True, d == days[1]) for d in days for i in range(50)]
    got = result(sel.select_over_time(spark.createDataFrame(rows, COLUMNS)))
    assert set(k[1] for k in got) == {days[0], days[2]} and got == {k: v for k, v in fold(rows).items() if v}
    assert not any(i for _, _, i in got["US", days[2]])


def test_the_fold_sees_few_rows_of_a_date(spark):
    rows = panel(3, 1500, 6, regions=("US",), missing=0.0)
    seen = sel.buffered_candidates(spark.createDataFrame(rows, COLUMNS), None, 12, 28, 8, 12)
    assert seen.groupBy("as_of").count().agg({"count": "max"}).first()[0] < 90


def test_an_empty_panel(spark):
    assert sel.select_over_time(spark.createDataFrame([], COLUMNS)).count() == 0
