"""Labelled pairs, splits and sampling (L1 to L9).

Every choice is a hash of ids and a seed, so that it does not depend on the order of rows or on
how tasks are dealt out, and any SQL engine with md5 makes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def parse_truth(truth: DataFrame) -> DataFrame:
    """(s1_id, cand_id) from (source1_entity_id, matched_entity_ids): split at commas, trimmed, blanks dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(parts).alias("cand_id"))


def of_source(truth: DataFrame, prefix: str) -> DataFrame:
    return truth.where(F.startswith("cand_id", F.lit(prefix))).distinct()


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidate pairs with label: 1 if the pair is true."""
    return pairs.join(truth.select("s1_id", "cand_id").distinct().withColumn("_true", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("_true", F.lit(0))).drop("_true")


def recovered(pairs: DataFrame, truth: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs that blocking did not keep and whose target exists: label 1, no passes, score 0, and the record's number of kept candidates."""
    lost = truth.join(pairs.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").join(targets.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_semi")
    kept = pairs.groupBy("s1_id").agg(F.count("*").alias("raw_candidate_count"))
    return lost.join(kept, "s1_id", "left").select(
        "s1_id", "cand_id", F.array().cast("array<string>").alias("methods"), F.lit(0).cast("long").alias("score"), F.coalesce("raw_candidate_count", F.lit(0)).cast("long").alias("raw_candidate_count"), F.lit(1).alias("label")
    )


def coverage(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(total, retrieved, pct) of true pairs among pairs."""
    kept = pairs.select("s1_id", "cand_id").distinct().withColumn("kept", F.lit(True))
    return truth.join(kept, ["s1_id", "cand_id"], "left").agg(F.count("*").alias("total"), F.count("kept").alias("retrieved")).withColumn(
        "pct", F.when(F.col("total") > 0, F.col("retrieved") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    )


def draw(*parts: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(*[p.cast("string") for p in parts], F.lit(str(seed))))


def _first_ranks(df: DataFrame, key: Column, ties: list[str], wanted: Column | int, buckets: int = 4096) -> DataFrame:
    """The wanted first rows in order of (key, ties), exactly, without sorting all rows in one task.

    key is a hex digest: its first three digits are a bucket; buckets are counted, and only rows
    within a bucket are ranked.
    """
    rows = df.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, 3))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_b").orderBy("_k", *ties)
    ranked = rows.join(F.broadcast(counts), "_b").withColumn("_rank", F.col("_before") + F.row_number().over(within))  # at most 4,096 rows are broadcast
    return ranked.withColumn("_in", F.col("_rank") <= wanted).drop("_k", "_b", "_before", "_rank")


def group_split(ids: DataFrame, ratio: float = 0.8, seed: int = SEED, key: str = "s1_id") -> DataFrame:
    """(key, is_train) of the distinct ids: the first floor(ratio * n) in order of their draw."""
    distinct = ids.select(key).distinct()
    n = distinct.count()
    return _first_ranks(distinct, draw(F.col(key), seed=seed), [key], int(n * ratio)).withColumnRenamed("_in", "is_train")


def subsample_negatives(pairs: DataFrame, ratio: int | None = 10, seed: int = SEED) -> DataFrame:
    """All positives and at most ratio times as many negatives, the first in order of their draw; all rows if ratio is None or not above 0."""
    if not ratio or ratio <= 0:
        return pairs
    positives = pairs.where("label = 1").count()
    negatives = _first_ranks(pairs.where("label <> 1"), draw(F.col("s1_id"), F.col("cand_id"), seed=seed), ["s1_id", "cand_id"], ratio * positives)
    return pairs.where("label = 1").unionByName(negatives.where("_in").drop("_in"))


def of_countries(records: DataFrame, countries: tuple[str, ...] | None = None) -> DataFrame:
    return records if countries is None else records.where(F.col("country").isin(*countries))
