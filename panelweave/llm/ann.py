"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are normalised and rotated by a random orthogonal matrix, assigned to the list of their
nearest centroid, and stored in column blocks.  A query probes its nearest lists; within each, a
candidate's distance grows block by block, and a hypothesis test on the part seen so far, scaled
to all dimensions, gives candidates up that cannot beat the k-th distance found.  What is left is
scored exactly on the original vectors.

Equal vectors are one candidate and one query, with their smallest ids, so a vector that a third
of all rows share costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, staged

#: Vectors on which the centroids are fitted, at most about, and their number and rounds.
SAMPLE, LISTS, ROUNDS = 16_384, 64, 10
PROBES = 44
#: Candidates of a list that one task compares at a time; longer lists are dealt out in parts.
BLOCK = 4096
#: Dimensions of a column block, and the error bound of the test: a partial distance d of the first
#: m of D dimensions gives up a candidate if d * D / m exceeds (1 + ERROR / sqrt(m)) ** 2 times the bar.
COLUMNS, ERROR = 16, 2.1


def rotation(dim: int, seed: int = 29) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, seed: int = 31) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    out = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        near = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norm > 0, sums / np.maximum(norm, 1e-30), out)
    return out


def scan(blocks: np.ndarray, query: np.ndarray, bar: float, k: int) -> np.ndarray:
    """Candidates of column ``blocks`` (dims x n, rotated) that may be among the k nearest.

    ``bar`` is the squared distance to beat.  Candidates leave between blocks by the test.
    """
    dims, n = blocks.shape
    live = np.arange(n)
    part = np.zeros(n)
    for lo in range(0, dims, COLUMNS):
        hi = min(dims, lo + COLUMNS)
        diff = blocks[lo:hi, live] - query[lo:hi, None]
        part = part[: len(live)] + np.einsum("ij,ij->j", diff, diff)
        limit = bar if hi == dims else bar * (1 + ERROR / np.sqrt(hi)) ** 2 * hi / dims
        keep = part <= limit
        live, part = live[keep], part[keep]
        if not len(live):
            break
    return live


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """(id, v): rows whose vector is not null, not empty and not zero, and has finite components only."""
    v = F.col(value).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(F.forall("v", lambda x: x.isNotNull()) & (F.size("v") > 0)).filter(finite & F.exists("v", lambda x: x != 0))


def _assign(dim: int, turn: np.ndarray, centres: np.ndarray, probes: int):
    """Each row's nearest lists, ``probes`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_unit(_matrix(batch.column("v"), dim)) @ turn @ centres.T), axis=1, kind="stable")[:, :probes]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    return run


def _search(dim: int, turn: np.ndarray, k: int):
    """The k nearest of a part of a list to each query that probes it, by original vectors."""

    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_c, out_s = [], [], []
        if candidates.num_rows and queries.num_rows:
            raw = _unit(_matrix(candidates.column("v").combine_chunks(), dim))
            ids = candidates.column("id").to_numpy()
            asked = queries.column("id").to_numpy()
            wanted = _unit(_matrix(queries.column("v").combine_chunks(), dim))
            # A random order, the same at every attempt, so that the first ones give a fair bar.
            order = np.random.default_rng(int(key[0].as_py())).permutation(np.argsort(ids))
            raw, ids = raw[order], ids[order]
            blocks, turned = np.ascontiguousarray((raw @ turn).T), wanted @ turn
            lead = min(len(ids), 8 * (k + 1))
            for q, (point, original) in enumerate(zip(turned, wanted)):
                head = ((blocks[:, :lead] - point[:, None]) ** 2).sum(axis=0)
                bar = np.partition(head, k)[k] if lead > k else np.inf
                live = scan(blocks, point, bar * (1 + 1e-9) + 1e-12, k) if np.isfinite(bar) else np.arange(len(ids))
                score = raw[live] @ original
                best = np.lexsort((ids[live], -score))[: k + 1]
                out_q.append(np.full(len(best), asked[q]))
                out_c.append(ids[live][best])
                out_s.append(score[best])
        cat = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.zeros(0), kind)
        return pa.table({"query": cat(out_q, pa.int64()), "candidate": cat(out_c, pa.int64()), "near": cat(out_s, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", value: str = "embedding", lists: int = LISTS, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of the rows for which ``is_query`` (a
    condition over ``id``) holds, among all rows but the query's own.

    Rows with null, zero or non-finite vectors or a null id take no part, nor do those of another
    than the commonest dimension.  Ties go to the smaller id; repeated ids are one row.  Fewer than
    k candidates give fewer rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, key, value).dropDuplicates(["id"])
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return empty
    dim = sizes["dim"]
    rows = rows.filter(F.size("v") == dim)
    # One node per distinct vector: its smallest id stands for it.
    classes = staged(rows.select("id", "v", F.xxhash64("v").alias("h")), "vectors")
    nodes = staged(classes.groupBy("h", "v").agg(F.min("id").alias("node")), "nodes")
    members = classes.join(nodes, ["h", "v"]).select("node", "id")
    members = staged(members, "members")

    share = min(1.0, SAMPLE / max(1, sizes["count"]))
    picked = nodes.filter(F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("node").limit(SAMPLE).select("v").toArrow()
    turn = rotation(dim)
    sample = _unit(_matrix(picked.column("v").combine_chunks(), dim)) @ turn if picked.num_rows else np.eye(dim)[:1]
    centres = centroids(sample, lists)

    named = nodes.select(F.col("node").alias("id"), "v")
    schema = "id long, v array<double>, lists array<int>"
    placed = named.mapInArrow(_assign(dim, turn, centres, 1), schema).select("id", "v", F.element_at("lists", 1).alias("list"))
    placed = staged(placed, "placed")
    # Long lists are dealt out in parts of about BLOCK candidates.
    parts = placed.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    asked = members.filter(is_query).select("node").distinct().withColumnRenamed("node", "id").join(named, "id")
    probed = asked.mapInArrow(_assign(dim, turn, centres, min(probes, len(centres))), schema).select("id", "v", F.explode("lists").alias("list"))
    parts = F.broadcast(parts)  # at most ``lists`` rows
    left = placed.join(parts, "list").select((F.col("list") * (1 << 20) + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("long").alias("cell"), "id", "v")
    right = probed.join(parts, "list").select("list", "id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    right = right.select((F.col("list") * (1 << 20) + F.col("p")).cast("long").alias("cell"), "id", "v")
    n = parts_for(vectors)
    found = left.repartition(n, "cell").groupBy("cell").cogroup(right.repartition(n, "cell").groupBy("cell")).applyInArrow(_search(dim, turn, k), "query long, candidate long, near double")

    # Nearest nodes, then their members: no more than k + 1 ids of a node can matter.
    by_near = Window.partitionBy("query").orderBy(F.desc("near"), "candidate")
    top = found.withColumn("r", F.row_number().over(by_near)).filter(F.col("r") <= k + 1).select("query", "candidate", "near")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1).select(F.col("node").alias("candidate"), F.col("id").alias("vec_id"))
    near = top.join(first, "candidate").select("query", "vec_id", "near")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    queries = members.filter(is_query).select(F.col("node").alias("query"), F.col("id").alias("query_id"))
    pairs = queries.join(best, "query").filter("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("near").alias("score"))
