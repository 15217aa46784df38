"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, mixture.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the stage before it kept;
``run`` writes each stage's result to the shared folder as Parquet and reads it again, so that a
lost executor costs the tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, crf_secrets, decontam, langmask, mixing, trie_join


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on; those that op5 gives none (no letter, or no language learned) are rejected.  ``lang`` is as it was."""
    judged = langmask.predict(spark, docs, langmask.train(spark, docs), keep=tuple(c for c in docs.columns if c != "doc_id"))
    return judged.where(F.col("lang_pred") != langmask.UNDECIDED).select(*docs.columns)


def _key(docs: DataFrame) -> F.Column:
    """A fingerprint of a whole row: never null, and equal for rows that are equal in all columns."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: the one with the smallest id, or one without an id if the class has no other.

    Rows are told apart by their fingerprints, not by ids, which may be null or repeat.  Texts
    without words are in no class and all stay.
    """
    rows = docs.withColumn("_key", _key(docs))
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = rows.where(worded)
    classes = trie_join.near_duplicates(spark, some.select(F.col("_key").alias("doc_id"), "text"))
    named = classes.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(some.select("_key", "doc_id").distinct(), "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_key")).alias("first")
    kept = common.save(spark, named.groupBy("component_id").agg(first).select("first._key"))
    one = some.join(kept, "_key", "left_semi").dropDuplicates(["_key"])
    return one.unionByName(rows.where(~worded)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item of the benchmark go, whatever their id."""
    rows = docs.withColumn("_key", _key(docs))
    found = decontam.leaks(spark, rows.select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(common.save(spark, found.select(F.col("doc_id").alias("_key")).distinct()), "_key", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay, and n_chars follows the text."""
    return crf_secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix of sources takes it."""
    return mixing.mix(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secrets), ("mixture", mixture)]

#: SQL can express neither the trained filters nor the trained field; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.save(spark, docs)
    return docs
