"""Session construction for tests, bench and the entry script."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "panelweave") -> SparkSession:
    """A local session with the settings the operators are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "12g"))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_STAGE_DIR") or tempfile.mkdtemp(prefix="spark-ckpt-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage is cut into, named by ``spark.checkpoint.dir``.

    A session over several machines without one is an error: its executors would write to their
    own disks.  Only a local session gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages then start from files: lost executors never replay the
    upstream joins, several consumers share one computation, and Catalyst sees
    true sizes and can prune columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Size, number and newest change of the files in a folder, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return "none"
    total = fs.getContentSummary(place)
    newest = max((s.getModificationTime() for s in fs.listStatus(place)), default=0)
    return f"{total.getLength()}-{total.getFileCount()}-{newest}"


_TABLES: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def stage_table(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table computed once per application and state of its input, and shared by its readers.

    ``name`` is the input folder, a slash and the table's name; once the folder's files change the
    table is built again.
    """
    folder, _, label = name.rpartition("/")
    key, state = (spark.sparkContext.applicationId, name), fingerprint(spark, folder)
    if key not in _TABLES or _TABLES[key][0] != state:
        _TABLES[key] = state, cut_lineage(build(), label)
    return _TABLES[key][1]
