"""The direction ensemble of one fold, fitted within a task: boosted trees, a penalised logistic, a sigmoid map.

Trees are histogram boosting on the log loss: inputs are cut at the quantiles of the fold's own training
rows, so nothing of later dates enters, and a tree is a complete binary one of fixed depth, stored as flat
arrays.  A model is one row of plain columns and can be written, read and broadcast as such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bins of an input, the least hessian of a leaf (some twenty rows), and the shares of rows
# and inputs that a tree sees.
BINS = 64
LEAST_HESSIAN = 5.0
COLUMN_SHARE = 0.8
NEWTON = 50

MODEL = (
    "fold int, n_train long, n_cal long, start double, feature array<int>, threshold array<double>, leaf array<double>, "
    "mean array<double>, scale array<double>, coef array<double>, slope double, offset double"
)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
MODEL_TABLE = pa.schema([(name, _ARROW[kind]) for name, kind in (field.split(" ") for field in MODEL.split(", "))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, share: float, seed: int = 42) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(start, feature, threshold, leaf): log odds to start from, and per tree 2^depth - 1 splits (right
    where the input reaches the threshold) and 2^depth leaves."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(prior / (1 - prior)))
    edges = np.full((d, BINS - 1), np.inf)
    for j, cuts in enumerate(np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T):
        cuts = np.unique(cuts)
        edges[j, : len(cuts)] = cuts
    codes = np.stack([np.searchsorted(edges[j], x[:, j], "right") for j in range(d)], axis=1).astype(np.int64)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    out = np.full(n, start)
    wide = max(1, int(np.ceil(COLUMN_SHARE * d)))
    for t in range(trees):
        rows = np.sort(rng.choice(n, max(1, int(share * n)), replace=False))
        columns = np.sort(rng.choice(d, wide, replace=False))
        p = sigmoid(out[rows])
        g, h = p - y[rows], p * (1 - p)
        own = codes[np.ix_(rows, columns)]
        cell = own + np.arange(wide) * BINS
        node = np.zeros(len(rows), np.int64)
        cut = np.full(inner, BINS)
        sums = None
        for level in range(depth):
            many = 1 << level
            # Below the root only right children are summed; what their parent has besides is the left child's.
            mine = np.flatnonzero(node & 1) if level else np.arange(len(rows))
            at = (cell[mine] + ((node[mine] >> 1) * (wide * BINS))[:, None]).ravel()
            right_sums = [np.bincount(at, weights=np.repeat(w[mine], wide), minlength=max(1, many // 2) * wide * BINS).reshape(-1, wide, BINS) for w in (g, h)]
            sums = [np.stack([p - r, r], axis=1).reshape(many, wide, BINS) for p, r in zip(sums, right_sums)] if level else right_sums
            gs, hs = (s.cumsum(axis=2) for s in sums)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            right = h_all - hs
            allowed = (hs >= LEAST_HESSIAN) & (right >= LEAST_HESSIAN)
            gain = np.where(allowed, gs**2 / np.maximum(hs, 1e-12) + (g_all - gs) ** 2 / np.maximum(right, 1e-12) - g_all**2 / np.maximum(h_all, 1e-12), 0.0)
            best = gain.reshape(many, -1).argmax(axis=1)
            split = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            column, bin_ = best // BINS, best % BINS
            place = many - 1 + np.flatnonzero(split)
            feature[t, place] = columns[column[split]]
            threshold[t, place] = edges[columns[column[split]], bin_[split]]
            cut[place] = bin_[split]
            node = 2 * node + (own[np.arange(len(rows)), np.where(split, column, 0)[node]] > cut[many - 1 + node])
        g_leaf, h_leaf = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=h, minlength=leaves)
        leaf[t] = -rate * g_leaf / np.maximum(h_leaf, 1e-12) * (h_leaf > 0)
        out += tree_sums(x, feature[t : t + 1], threshold[t : t + 1], leaf[t : t + 1])
    return start, feature, threshold, leaf


def tree_sums(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Sum of the trees' leaves per row, all trees a level at a time."""
    trees, inner = feature.shape
    tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
    node = np.zeros((len(x), trees), np.int64)
    many = 1
    while many <= inner:
        at = many - 1 + node
        node = 2 * node + (x[row, feature[tree, at]] >= threshold[tree, at])
        many *= 2
    return leaf[tree, node].sum(axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """Newton's method for weight * log loss + half the penalised squares; the last input is a constant."""
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON):
        p = sigmoid(x @ w)
        grad = weight * (x.T @ (p - y)) + penalty * w
        hess = weight * (x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def with_constant(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def raw_probability(x: np.ndarray, m: dict) -> np.ndarray:
    """The mean of both members' probabilities; of the trees alone where the linear one is missing."""
    p = sigmoid(m["start"] + tree_sums(x, m["feature"], m["threshold"], m["leaf"]))
    if not len(m["coef"]):
        return p
    return 0.5 * (p + sigmoid(with_constant((x - m["mean"]) / m["scale"]) @ m["coef"]))


def fit(x: np.ndarray, y: np.ndarray, cal_x: np.ndarray, cal_y: np.ndarray, trees: int, depth: int, rate: float, share: float, inverse_penalty: float) -> dict:
    """All parts of a fold's model.  A single class leaves out the linear member, and, in the calibration
    rows, the sigmoid map (slope null)."""
    start, feature, threshold, leaf = fit_trees(x, y, trees, depth, rate, share)
    m = {"start": start, "feature": feature, "threshold": threshold, "leaf": leaf, "mean": np.zeros(0), "scale": np.zeros(0), "coef": np.zeros(0), "slope": None, "offset": None}
    if 0 < y.mean() < 1:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 0, scale, 1.0)
        penalty = np.append(np.ones(x.shape[1]), 0.0)
        m |= {"mean": mean, "scale": scale, "coef": fit_logistic(with_constant((x - mean) / scale), y, penalty, inverse_penalty)}
    if len(cal_y) and 0 < cal_y.mean() < 1:
        up = cal_y.sum()
        # Smoothed targets, as usual for a sigmoid map.
        target = np.where(cal_y > 0, (up + 1) / (up + 2), 1 / (len(cal_y) - up + 2))
        m["slope"], m["offset"] = fit_logistic(with_constant(raw_probability(cal_x, m)[:, None]), target, np.zeros(2)).tolist()
    return m


def calibrated(raw: np.ndarray, m: dict) -> np.ndarray:
    return raw if m["slope"] is None else sigmoid(m["slope"] * raw + m["offset"])
