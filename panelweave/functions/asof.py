"""As-of merge: for each row the newest earlier one of its key, without a task per key or a row per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a time bucket: a key's rows of one bucket are sorted together.
BUCKET_DAYS = 128


def asof_merge(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: Column, order: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Each row of ``left`` (keys, ``at``) with the row of ``right`` that is greatest by ``order`` among those
    whose ``since`` is not later; left rows that see none are dropped.

    Both sides meet in (key, time bucket) groups.  Within a group a running maximum decides; what earlier
    buckets hold comes from a prefix over the buckets' own maxima, one row per key and bucket.  Buckets
    depend on the date alone, so a recomputed task agrees with the first attempt.
    """
    rest = [c for c in right.columns if c not in keys]
    payload = F.struct(order, *[c for c in rest if c != order])
    bucket = lambda day: F.floor(F.unix_date(day) / bucket_days).alias("_bucket")
    seen = right.select(*keys, since.alias("_at"), payload.alias("_row")).where(F.col("_at").isNotNull()).select(*keys, "_at", bucket("_at"), F.lit(0).alias("_asks"), "_row")
    own = [c for c in left.columns if c not in keys]
    asks = left.select(*keys, F.col(at).alias("_at"), F.struct(*own).alias("_own")).select(*keys, "_at", bucket("_at"), F.lit(1).alias("_asks"), "_own")
    # An exchange of its own, which window and maxima share: a union of two sides that are partitioned
    # alike by the keys may pass for partitioned although their partitions were coalesced differently.
    both = seen.unionByName(asks, allowMissingColumns=True).repartition(*keys, "_bucket")
    within = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_row", F.max("_row").over(within)).where("_asks = 1")
    tails = both.groupBy(*keys, "_bucket").agg(F.max("_row").alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_bucket", F.max("_tail").over(before).alias("_carried"))
    out = met.join(carried, [*keys, "_bucket"]).withColumn("_row", F.greatest("_row", "_carried")).where(F.col("_row").isNotNull())
    return out.select(*keys, "_own.*", "_row.*")
