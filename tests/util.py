"""Small literal panels (business days unless said otherwise)."""

import datetime as dt

import numpy as np
import pandas as pd


def bdays(n, start="2024-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def bars(spark, closes, start="2024-01-01", volume=1000.0, region="US", sector="Technology"):
    """closes: {entity: list of closes} -> bars with high+1 / low-1."""
    rows = []
    for e, cs in closes.items():
        for d, c in zip(bdays(len(cs), start), cs):
            c = None if c is None else float(c)
            rows.append((e, region, sector, d, c, None if c is None else c + 1, None if c is None else c - 1, c, volume))
    return spark.createDataFrame(
        rows, "entity string, region string, sector string, ts date, open double, high double, low double, close double, volume double")


def walk(n, drift=0.0, vol=0.015, seed=1):
    rng = np.random.default_rng(seed)
    return [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(drift, vol, n)))]


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def date(s):
    return dt.date.fromisoformat(s)
