"""A table played as a stream: its rows in steps, one micro-batch each."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a stream's input, sink and checkpoint."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def span_step(micros: Column, first: int, last: int, steps: int) -> Column:
    """The step of an instant, [first, last] cut into ``steps`` equal spans."""
    return F.floor((micros - first) * steps / F.lit(last - first + 1)).cast("int")


def replay(df: DataFrame, step: Column, steps: int, folder: str, files: int = 1) -> DataFrame:
    """A file stream of ``df``: the rows of step k are written after those of the steps before, ``files`` files
    each, and every micro-batch takes so many.  A step that fills fewer files is an error: its batch would
    run into the next one."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = df.withColumn("_step", step)
    for k in range(steps):
        rows.where(F.col("_step") == k).drop("_step").repartition(files).write.mode("append").parquet(folder)
        written = sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(place))
        if written != files * (k + 1):
            raise ValueError(f"step {k} has rows for {written - files * k} of {files} files")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def drained(query, timeout: int | None = None) -> None:
    """Wait for a query over what is there; its failure is raised."""
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
