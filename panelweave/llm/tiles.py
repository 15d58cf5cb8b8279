"""Near duplicates among vectors by int8 quantised tile products.

Every vector is scaled to length one and rounded to int8 with a scale of its own; the exact length
of what the rounding lost bounds the error of every product of codes.  Vectors stand in tiles of
their nearest pivot, tiles meet in pairs, and a pair of tiles is one integer matrix product: pairs
whose upper bound stays below the threshold are no links, pairs whose lower bound reaches it are
links, and only those between are computed again from the vectors themselves, in double precision.

Two vectors within the threshold's angle obey the triangle inequality with every pivot, so a vector
goes to a tile of another pivot only if its angle to that pivot exceeds the tile's radius by no more
than that angle.  This loses nothing, and spares most pairs of tiles where the vectors form clusters.

No pair leaves a task: a pair of tiles gives link counts per vector and a spanning forest of its
links, at most one row per vector each.  Equal vectors are one node with its number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import centroids, usable
from .common import parts_for, staged
from .components import components

#: Vectors of a tile, about; rows of a tile that one product takes; pivots at most, and the vectors
#: they are fitted on at most (pivots steer the work, never the result).
TILE, ROWS, PIVOTS, SAMPLE = 4096, 512, 256, 16_384
#: Products of so many int8 components are exact in single precision.
EXACT = 1024
#: Covers the rounding of the double precision sums that make the bounds.
SLACK = 1e-9
#: Covers the rounding of angles between vectors and pivots.
ANGLE_SLACK = 1e-6

FOUND = "key long, kind int, a long, b long, n long"
COUNT, EDGE, OPEN = 0, 1, 2


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for tiny and huge components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 codes, their scales, the lengths of code times scale, and of what is lost."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    near = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of int8 rows, exact."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], EXACT):
        out += a[:, lo : lo + EXACT].astype(np.float32) @ b[:, lo : lo + EXACT].astype(np.float32).T
    return out


class Side:
    """Rows of one tile as their quantised form."""

    def __init__(self, ids, copies, codes, scale, length, lost):
        self.ids, self.copies, self.codes = ids, copies, codes
        self.scale, self.length, self.lost = scale, length, lost

    @classmethod
    def of(cls, t: pa.Table) -> Side:
        n = t.num_rows
        raw = t.column("code").combine_chunks()
        codes = np.frombuffer(b"".join(raw.to_pylist()), np.int8).reshape(n, -1)
        num = lambda c: t.column(c).to_numpy()
        return cls(num("id"), num("copies"), codes, num("scale"), num("length"), num("lost"))


def doubtful(a: Side, b: Side, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) of the pairs whose bounds do not rule a link out; ``same``: i before j of one tile only."""
    # |u.v - s_u s_v q_u.q_v| <= lost_u * length_v + lost_v * length_u + lost_u * lost_v
    worst_length, worst_lost = b.length.max(), b.lost.max()
    for lo in range(0, len(a.ids), ROWS):
        rows = slice(lo, lo + ROWS)
        product = code_products(a.codes[rows], b.codes)
        scaled = product * b.scale.astype(product.dtype)[None, :]
        reach = a.lost[rows] * worst_length + worst_lost * a.length[rows] + a.lost[rows] * worst_lost
        least = (threshold - reach) / a.scale[rows]
        i, j = np.nonzero(scaled >= (least - np.abs(least) * 1e-6)[:, None].astype(product.dtype))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        near = product[i - lo, j].astype(np.float64) * a.scale[i] * b.scale[j]
        bound = a.lost[i] * b.length[j] + b.lost[j] * a.length[i] + a.lost[i] * b.lost[j] + SLACK
        keep = near + bound >= threshold
        i, j = i[keep], j[keep]
        yield i, j, near[keep] - bound[keep] >= threshold


class Links:
    """Link counts and a spanning forest of the links of two tiles."""

    def __init__(self, a: Side, b: Side, same: bool):
        self.a, self.b, self.same = a, b, same
        self.at = 0 if same else len(a.ids)
        self.ids = a.ids if same else np.concatenate([a.ids, b.ids])
        self.n = np.zeros(len(self.ids), np.int64)
        self.root = np.arange(len(self.ids))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        size = len(self.ids)
        # Weights are exact in double precision below 2 ** 53 copies.
        self.n += np.bincount(i, weights=self.b.copies[j], minlength=size).astype(np.int64)
        self.n += np.bincount(j + self.at, weights=self.a.copies[i], minlength=size).astype(np.int64)
        j = j + self.at
        while True:
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def rows(self, key: int, extra: np.ndarray) -> pa.Table:
        """Counts, forest edges and the ids of ``extra`` (positions) that need their vectors."""
        linked, child = np.flatnonzero(self.n), np.flatnonzero(self.root != np.arange(len(self.root)))
        kinds = np.repeat(np.array([COUNT, EDGE, OPEN], np.int32), [len(linked), len(child), len(extra)])
        a = np.concatenate([self.ids[linked], self.ids[child], self.ids[extra]])
        b = np.concatenate([self.ids[linked], self.ids[self.root[child]], self.ids[extra]])
        n = np.concatenate([self.n[linked], np.zeros(len(child) + len(extra), np.int64)])
        return pa.table({"key": np.full(len(a), key, np.int64), "kind": kinds, "a": a, "b": b, "n": n})


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The rows of either tile, each in order of their ids; one tile against itself if there is one."""
    t = t.sort_by([("tile", "ascending"), ("id", "ascending")])
    tiles = t.column("tile").to_numpy()
    cut = int(np.searchsorted(tiles, tiles[0], "right"))
    return (t, t, True) if cut == len(tiles) else (t.slice(0, cut), t.slice(cut), False)


def _pair_of(key: int) -> tuple[int, int]:
    return key >> 31, key & ((1 << 31) - 1)


def _compare(threshold: float):
    """A pair of tiles by codes: sure links as counts and forest, and the rows of pairs in doubt."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        key = int(key[0].as_py())
        left, right, same = _sides(t)
        first, second = _pair_of(key)
        if same and first != second:  # nothing of the other tile is near
            return pa.table({"key": np.zeros(0, np.int64), "kind": np.zeros(0, np.int32), **{c: np.zeros(0, np.int64) for c in "abn"}})
        a = Side.of(left)
        b = a if same else Side.of(right)
        links, open_ = Links(a, b, same), np.zeros(len(a.ids) + (0 if same else len(b.ids)), bool)
        for i, j, sure in doubtful(a, b, threshold, same):
            links.add(i[sure], j[sure])
            open_[i[~sure]] = True
            open_[j[~sure] + links.at] = True
        return links.rows(key, np.flatnonzero(open_))

    return run


def _settle(threshold: float):
    """The pairs in doubt of a pair of tiles, by their vectors in double precision."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        left, right, same = _sides(t)

        def side(x: pa.Table) -> tuple[Side, np.ndarray]:
            u = unit(x.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1))
            return Side(x.column("id").to_numpy(), x.column("copies").to_numpy(), *quantise(u)), u

        a, u = side(left)
        b, v = (a, u) if same else side(right)
        links = Links(a, b, same)
        for i, j, sure in doubtful(a, b, threshold, same):
            i, j = i[~sure], j[~sure]
            hit = np.concatenate([np.einsum("ij,ij->i", u[i[k : k + 65_536]], v[j[k : k + 65_536]]) >= threshold for k in range(0, len(i), 65_536)] or [np.zeros(0, bool)])
            links.add(i[hit], j[hit])
        return links.rows(int(key[0].as_py()), np.zeros(0, np.int64))

    return run


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _place(pivots: np.ndarray):
    """Each node's nearest pivot and its angle; a vector of another dimension than the pivots has none (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            pivot, angle = np.full(len(sizes), -1, np.int32), np.full(len(sizes), np.pi)
            own = np.flatnonzero(sizes == pivots.shape[1])
            codes, scale, length, lost = [None] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes))
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                u = unit(batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
                q, scale[rows], length[rows], lost[rows] = quantise(u)
                for r, c in zip(rows, q):
                    codes[r] = c.tobytes()
                if len(own) and dim == pivots.shape[1]:
                    angles = _angles(u, pivots)
                    pivot[rows], angle[rows] = angles.argmin(axis=1), angles.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "copies", "dim", "v")], pa.array(codes, pa.binary()), pa.array(scale), pa.array(length), pa.array(lost), pa.array(pivot), pa.array(angle)],
                names=["id", "copies", "dim", "v", "code", "scale", "length", "lost", "pivot", "angle"],
            )

    return run


def _send(pivots: np.ndarray, cells: list, reach: float):
    """Each row once for every pair of tiles in which a partner can be.

    ``cells`` is (dim, pivot, radius, first tile, number of tiles) of each group of tiles.
    """
    dims, owner, radius, first, parts = (np.array(x) for x in zip(*cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                n = batch.num_rows
                can = batch.column("dim").to_numpy()[:, None] == dims[None, :]
                mine = np.flatnonzero(batch.column("pivot").to_numpy() >= 0)
                with_pivot = np.flatnonzero(owner >= 0)
                if len(mine) and len(with_pivot):
                    u = unit(batch.column("v").take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1))
                    near = _angles(u, pivots[owner[with_pivot]]) <= radius[with_pivot] + reach + ANGLE_SLACK
                    can[np.ix_(mine, with_pivot)] &= near
                own = batch.column("tile").to_numpy()
                row, cell = np.nonzero(can)
                times = parts[cell]
                other = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row = np.repeat(row, times)
                mine_first = np.minimum(own[row], other)
                key = (mine_first.astype(np.int64) << 31) + np.maximum(own[row], other)
                out = batch.take(pa.array(row)) if n else batch
                names = ["id", "copies", "code", "scale", "length", "lost", "tile"]
                yield pa.RecordBatch.from_arrays([pa.array(key), *[out.column(c) for c in names]], names=["key", *names])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs with a cosine of ``threshold`` or more.

    A vector that is null, empty, zero or holds null or non-finite components links with nothing and is
    its own component, as are vectors of different dimensions to each other.  Rows of one id are one
    vector (the smallest usable one); rows without an id are left out.  Other columns are not read, so
    their names do not matter; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(key, value), key, value)
    members = staged(rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v")), "tile-members")
    nodes = staged(members.groupBy("h", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "tile-nodes")
    everyone = vectors.select(F.col(key).cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    common = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    share = int(min(1.0, SAMPLE / common["count"]) * 1_000_000)
    picked = nodes.filter((F.col("dim") == common["dim"]) & (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000)) < share)).orderBy("id").limit(SAMPLE).select("v").toArrow()
    wanted = max(1, min(PIVOTS, round(common["count"] / TILE)))
    sample = unit(picked.column("v").combine_chunks().flatten().to_numpy().reshape(-1, common["dim"])) if picked.num_rows else np.eye(common["dim"])[:1]
    pivots = centroids(sample, wanted)
    coded = "id long, copies long, dim int, v array<double>, code binary, scale double, length double, lost double, pivot int, angle double"
    placed = staged(nodes.select("id", "copies", "dim", "v").mapInArrow(_place(pivots), coded), "tile-placed")

    # One group of tiles per pivot, and per other dimension; the numbers of both are small.
    groups = placed.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).orderBy("dim", "pivot").collect()
    cells, tile = [], 0
    for g in groups:
        parts = -(-g["n"] // TILE)
        cells.append((g["dim"], g["pivot"], g["radius"], tile, parts))
        tile += parts
    firsts = spark.createDataFrame([(d, p, t, n) for d, p, _, t, n in cells], "dim int, pivot int, first int, parts int")
    tiled = placed.join(F.broadcast(firsts), ["dim", "pivot"]).withColumn("tile", (F.col("first") + F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts"))).cast("int"))
    tiled = tiled.select("id", "copies", "dim", "v", "code", "scale", "length", "lost", "pivot", "tile")
    sent = tiled.mapInArrow(_send(pivots, cells, float(np.arccos(threshold))), "key long, id long, copies long, code binary, scale double, length double, lost double, tile int")
    n = parts_for(vectors)
    found = staged(sent.repartition(n, "key").groupBy("key").applyInArrow(_compare(threshold), FOUND), "tile-links")

    doubt = found.filter(F.col("kind") == OPEN).select("key", F.col("a").alias("id")).join(tiled.select("id", "copies", "tile", "v"), "id")
    settled = doubt.repartition(n, "key").groupBy("key").applyInArrow(_settle(threshold), FOUND)
    links = staged(found.filter(F.col("kind") != OPEN).unionByName(settled), "tile-settled")

    counts = links.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(links.filter(F.col("kind") == EDGE).select("a", "b"))
    per_node = nodes.select("h", "v", F.col("id").alias("node"), "copies").join(counts, "node", "left").join(roots, "node", "left")
    per_node = per_node.select("h", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    linked = members.join(per_node, ["h", "v"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    out = everyone.join(linked, "vec_id", "left")
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (root == F.col("vec_id")).alias("kept"))
