"""Stored ledger: append-only Parquet under a log of commits, and its JSON-lines form.

A commit is one small JSON file that names the Parquet files it adds, numbered without gaps.  A reader
takes the files of all commits and nothing else, so files of a writer that died are never seen.  A
writer reads the ids of the commits it can see, writes its files, and claims the next number by a rename
that fails where the number is taken; it then looks at what the other writer added and tries again.  A
commit made for a (query, epoch) is never made twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gates import live_only
from ..operators.ledger import append_new
from ..session import cut_lineage

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("view", T.StringType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("alpha_percentile", T.IntegerType()),
        T.StructField("ref_close", T.DoubleType()),
        T.StructField("benchmark", T.StringType()),
        T.StructField("macro_regime", T.StringType()),
        T.StructField("entry_state", T.StringType()),
        T.StructField("date", T.DateType()),
    ]
)


class CommitLog:
    """The numbered commits of a folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def entries(self) -> list[dict]:
        """All commits in order: files, query, epoch, first and last date."""
        folder = self._at("commits")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        out = []
        for name in sorted(n for n in names if n.endswith(".json")):
            stream = self.fs.open(self._at(f"commits/{name}"))
            out.append(json.loads(self.jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next()))
            stream.close()
        return out

    def claim(self, number: int, entry: dict) -> bool:
        """Write ``entry`` as commit ``number``; False if that number is taken."""
        tmp, to = self._at(f"commits/{uuid.uuid4().hex}.tmp"), self._at(f"commits/{number:012d}.json")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.context.rename(tmp, to, options)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.fs.delete(tmp, False)
            return False

    def files(self, folder: str) -> list[str]:
        """Data files below a folder of this log, relative to it."""
        found, files = [], self.fs.listFiles(self._at(folder), True)
        base = self.fs.getFileStatus(self._at("")).getPath().toString().rstrip("/")
        while files.hasNext():
            name = files.next().getPath().toString()
            if name.endswith(".parquet"):
                found.append(name.removeprefix(base).lstrip("/"))
        return sorted(found)

    def frame(self, entries: list[dict], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{f}" for e in entries for f in e["files"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    """The committed rows; a folder that does not exist yet is an empty ledger."""
    log = CommitLog(spark, path)
    return log.frame(log.entries(), schema)


def append_ledger(new: DataFrame, path: str, schema: T.StructType = LEDGER_SCHEMA, order: list[str] = ["date"], query: str | None = None, epoch: int | None = None) -> bool:
    """Append the new rows of live runs; stored rows are never rewritten.  False if (query, epoch) is stored.

    Rows without a date or an id are not recorded.  An id holds its date, so only commits whose dates
    meet those of the new rows are read for ids.
    """
    log = CommitLog(new.sparkSession, path)
    rows = live_only(new).drop("data_mode") if "data_mode" in new.columns else new
    rows = cut_lineage(rows.where("date is not null and id is not null").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), "ledger_batch")
    first, last = (str(d) if d else None for d in rows.agg(F.min("date"), F.max("date")).first())
    while True:
        seen = log.entries()
        if query is not None and any(e["query"] == query and e["epoch"] == epoch for e in seen):
            return False
        near = [e for e in seen if first and e["first"] and e["first"] <= last and first <= e["last"]]
        folder = f"data/{uuid.uuid4().hex}"
        append_new(log.frame(near, schema).select("id"), rows, order).write.parquet(f"{log.path}/{folder}")
        entry = {"query": query, "epoch": epoch, "first": first, "last": last, "files": log.files(folder)}
        if log.claim(len(seen), entry):
            return True


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    """A ledger of one JSON object a line; blank lines count for nothing, a broken one is an error, and a
    path that does not exist is an empty ledger."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written out."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
