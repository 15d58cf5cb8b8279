"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import fmindex, mixing, packing, rules, simhash
from panelweave.llm.common import stage_folder
from panelweave.llm.queries import tokenizer_path


def _aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, list]:
    """``docs`` with every column that a stage does not use under a name that no operator has, and the
    columns that restore it: a document's own column keeps its values whatever it is called."""
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return rules.keep(docs, "v1")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of twenty words that also start earlier.

    A text that loses words is its other words joined by blanks; a document that loses all goes.
    """
    plain, back = _aside(docs, ["doc_id", "text", "n_chars"])
    cut = fmindex.dedup_words(plain)
    kept = cut.filter("n_removed = 0 or n_removed < n_symbols")
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    kept = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*back)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one that two epochs read stands twice."""
    plain, back = _aside(docs, ["doc_id", "text", "lang", "source"])
    return mixing.mix_sources(plain).select(*back)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("harmonic_packing", harmonic_packing),
]

#: The stages past the first are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result goes to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{stage_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
