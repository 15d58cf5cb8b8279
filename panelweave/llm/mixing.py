"""Mixing sources to target weights over a domain-language-source tree.

The token budget goes down the tree by weight.  A child takes no more than its subtree can give
in the allowed epochs, and what it leaves goes to its siblings by their weights, so a shortage
reaches an ancestor only when all siblings are full.  Each leaf then reads whole epochs and, in
the last one, a prefix of its documents in that epoch's seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP

LEVELS = ("domain", "lang", "source")
#: Leaves are categories, not data: their totals are collected, and more than this is an error.
MAX_LEAVES = 50_000
#: Parts of an epoch's order in which a prefix is searched before its documents are.
PARTS = 4096
SEED = 17

#: Production weights by level and name; a name not listed weighs 1.
WEIGHTS = (
    {"web": 4.0, "books": 3.0, "code": 2.0},
    {"en": 4.0},
    {},
)
#: Share of the corpus's tokens to draw, and how often a document may be read.
SHARE, EPOCHS = 0.7, 2


def domain_of(source: Column) -> Column:
    """The domain of a source, by its number."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("long") % 3
    return F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "code").otherwise("other")


def tokens_of(text: Column) -> Column:
    """Tokens counted as words; a null or empty text has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")).cast("long")


def fill(budget: float, capacity: list[float], weights: list[float]) -> list[float]:
    """Shares of ``budget`` by weight, none above its capacity while another has room."""
    out = [0.0] * len(capacity)
    open_ = [i for i, (c, w) in enumerate(zip(capacity, weights)) if c > 0 and w > 0]
    rest = min(budget, sum(capacity[i] for i in open_))
    while open_ and rest > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / total >= capacity[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = capacity[i]
        rest -= sum(capacity[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def quotas(tokens: dict[tuple, int], budget: float, weights=WEIGHTS, epochs: int = EPOCHS) -> dict[tuple, int]:
    """Tokens to draw from each leaf, given the tokens it has."""
    out: dict[tuple, int] = {}

    def down(depth: int, leaves: list[tuple], share: float) -> None:
        if depth == len(LEVELS):
            out[leaves[0]] = min(round(share), tokens[leaves[0]] * epochs)
            return
        children: dict[str, list[tuple]] = {}
        for leaf in leaves:
            children.setdefault(leaf[depth], []).append(leaf)
        names = sorted(children)
        capacity = [float(sum(tokens[leaf] for leaf in children[n]) * epochs) for n in names]
        for name, part in zip(names, fill(share, capacity, [weights[depth].get(name, 1.0) for name in names])):
            down(depth + 1, children[name], part)

    if tokens:
        down(0, sorted(tokens), budget)
    return out


def _order(key: Column, epoch: Column, seed: int) -> Column:
    """A document's place in an epoch's order."""
    return F.xxhash64(F.lit(seed), epoch, F.coalesce(key.cast("string"), F.lit("")))


def mix_sources(docs: DataFrame, share: float = SHARE, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` once for every epoch that reads them, with ``epoch`` and ``n_tokens`` (long).

    A prefix ends with the document that reaches the quota, and rows that share the last place
    come together.  Null languages and sources are leaves named "unknown"; documents without
    tokens come with each whole epoch.  Columns of ``docs`` named like an added one give way.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("epoch", "n_tokens")]
    helper = ["_" + name for name in LEVELS]
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    tree = docs.select(*own).withColumns({"_domain": domain_of(F.col("source")), "_lang": unknown("lang"), "_source": unknown("source"), "n_tokens": tokens_of(F.col("text"))})
    slim = tree.select("doc_id", *helper, "n_tokens")
    totals = slim.groupBy(*helper).agg(F.sum("n_tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves; coarser sources are needed")
    tokens = {tuple(r[:3]): r[3] for r in totals}
    plan = quotas(tokens, share * sum(tokens.values()), weights, epochs)
    rows = [(*leaf, q // max(1, tokens[leaf]), q - q // max(1, tokens[leaf]) * tokens[leaf]) for leaf, q in plan.items()]
    leaves = F.broadcast(spark.createDataFrame(rows, ", ".join(f"{h} string" for h in helper) + ", whole long, rest long"))

    # The place at which each leaf's last epoch reaches its rest: first the part, then the document.
    placed = slim.join(leaves, helper).filter("rest > 0").withColumn("place", _order(F.col("doc_id"), F.col("whole"), seed))
    placed = placed.withColumn("part", F.shiftrightunsigned("place", 64 - PARTS.bit_length() + 1).bitwiseXOR(F.lit(PARTS // 2)))
    parts = placed.groupBy(*helper, "part").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*helper).orderBy("part"))
    last = parts.withColumn("upto", upto).filter("upto >= rest and upto - n < rest").select(*helper, "part", (F.col("rest") - F.col("upto") + F.col("n")).alias("need"))
    inside = placed.join(F.broadcast(last), [*helper, "part"])
    by_place = Window.partitionBy(*helper).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = inside.withColumn("sum", F.sum("n_tokens").over(by_place)).filter("sum >= need").groupBy(*helper).agg(F.min("place").alias("cut"))
    ends = {tuple(r[:3]): r[3] for r in cuts.collect()}
    final = spark.createDataFrame([(*r[:4], ends.get(r[:3])) for r in rows], ", ".join(f"{h} string" for h in helper) + ", whole long, cut long")
    drawn = tree.join(F.broadcast(final), helper)
    times = F.col("whole") + F.when(_order(F.col("doc_id"), F.col("whole"), seed) <= F.col("cut"), 1).otherwise(0)
    drawn = drawn.withColumn("_times", times).filter("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    return drawn.select(*own, "epoch", "n_tokens")


def leaf_columns() -> list[Column]:
    """The leaf of a mixed document."""
    return [domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source")]
