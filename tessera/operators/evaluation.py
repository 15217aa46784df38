"""Blocking recall, classifier metrics and threshold search (A1 to A13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocking as B
from . import keys as K

CAPS = (30, 50, 75, 100)
#: Cumulative configurations of the pass study.
STUDY = tuple((("" if k == 0 else "+") + p, K.PASSES[: k + 1]) for k, p in enumerate(K.PASSES))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def truth_ranks(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """truth (s1_id, cand_id) with rn and methods of the pair; null where blocking lost it."""
    return truth.join(B.ranked(pairs).select("s1_id", "cand_id", "rn", "methods"), ["s1_id", "cand_id"], "left")


def recall(truth: DataFrame, pairs: DataFrame, caps: tuple[int, ...] = (50,), by: str | None = None) -> DataFrame:
    """True pairs in all, kept, lost to the cap and lost to blocking, per cap (and per column of truth named by by); ranks are made once for all caps."""
    found = truth_ranks(truth, pairs)
    rows = found.withColumn("cap", F.explode(F.array(*map(F.lit, caps))))
    kept, lost = F.count_if(F.col("rn") <= F.col("cap")), F.count_if(F.col("rn") > F.col("cap"))
    out = rows.groupBy("cap", *([by] if by else [])).agg(F.count("*").alias("total"), kept.alias("retrieved"), lost.alias("lost_to_cap"), F.count_if(F.col("rn").isNull()).alias("lost_to_blocking"))
    return out.withColumn("recall_pct", percent(F.col("retrieved"), F.col("total"))).withColumn("uncapped_recall_pct", percent(F.col("retrieved") + F.col("lost_to_cap"), F.col("total")))


def entity_counts(queries: DataFrame, truth: DataFrame, pairs: DataFrame, cap: int = 50) -> DataFrame:
    """Records in all, with a candidate, with all their matches kept, and without a match."""
    has = pairs.select("s1_id").distinct().withColumn("has", F.lit(True))
    kept = truth_ranks(truth, pairs).groupBy("s1_id").agg((F.count_if(F.col("rn") <= cap) == F.count("*")).alias("complete"))
    rows = queries.select(F.col("entity_id").alias("s1_id")).join(has, "s1_id", "left").join(kept, "s1_id", "left")
    return rows.agg(
        F.count("*").alias("entities"), F.count_if("has").alias("with_candidates"), F.count_if(F.coalesce("complete", F.lit(False))).alias("with_all_matches"), F.count_if(F.col("complete").isNull()).alias("without_matches")
    )


def count_distribution(queries: DataFrame, pairs: DataFrame, cap: int = 50) -> DataFrame:
    """Mean, middle, 95th percentile and largest number of candidates of a record, before and after the cap.

    The percentile p of n values is that at position min(int(p n), n - 1) from 0.  Counts are first
    grouped, so the ranks are over few distinct numbers, not over records.
    """
    per = queries.select(F.col("entity_id").alias("s1_id")).join(pairs.groupBy("s1_id").count(), "s1_id", "left").select(F.coalesce("count", F.lit(0)).alias("raw"))
    kinds = per.select(F.explode(F.array(F.struct(F.lit("capped").alias("kind"), F.least("raw", F.lit(cap)).alias("n")), F.struct(F.lit("raw").alias("kind"), F.col("raw").alias("n")))).alias("x")).select("x.kind", "x.n")
    grouped = kinds.groupBy("kind", "n").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("kind")
    at = grouped.withColumn("cum", F.sum("k").over(upto)).withColumn("total", F.sum("k").over(whole))

    def percentile(p: float) -> Column:
        place = F.least(F.floor(F.lit(p) * F.col("total")), F.col("total") - 1)
        return F.min(F.when(F.col("cum") > place, F.col("n")))

    return at.groupBy("kind").agg(F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 2).alias("mean"), percentile(0.5).alias("median"), percentile(0.95).alias("p95"), F.max("n").alias("largest"))


def pass_contributions(truth: DataFrame, pairs: DataFrame, cap: int = 50) -> DataFrame:
    """(pass, retrieved): kept true pairs that each pass found."""
    return truth_ranks(truth, pairs).where(F.col("rn") <= cap).select(F.explode("methods").alias("pass")).groupBy("pass").agg(F.count("*").alias("retrieved"))


def pass_study(truth: DataFrame, hit_rows: DataFrame, cap: int = 50) -> DataFrame:
    """(step, label, retrieved, total): recall as passes are added one by one.

    One aggregation over the hits, with a sum for each pass: a step adds up the sums of its passes.
    """
    sums = hit_rows.groupBy("s1_id", "cand_id").agg(*[F.sum(F.when(F.col("pass") == p, F.col("score"))).alias(f"_{p}") for p in K.PASSES])
    by_pass = F.array(*[F.col(f"_{p}") for p in K.PASSES])
    names = ", ".join(f"'{p}'" for p in K.PASSES)
    steps = sums.select("s1_id", "cand_id", by_pass.alias("_sums"), F.explode(F.sequence(F.lit(0), F.lit(len(STUDY) - 1))).alias("step"))
    pairs = steps.selectExpr(
        "step", "s1_id", "cand_id", "aggregate(slice(_sums, 1, step + 1), 0L, (a, x) -> a + coalesce(x, 0L)) AS score", f"array_sort(filter(array({names}), (p, i) -> i <= step AND _sums[i] IS NOT NULL)) AS methods"
    ).where("size(methods) > 0")
    one = pairs.select(F.struct("step", "s1_id").alias("s1_id"), "cand_id", "score", "methods")
    kept = B.ranked(one, cap).select("s1_id.step", F.col("s1_id.s1_id").alias("s1_id"), "cand_id")
    found = kept.join(truth.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi").groupBy("step").agg(F.count("*").alias("retrieved"))
    spark = truth.sparkSession
    names = spark.createDataFrame([(k, label) for k, (label, _) in enumerate(STUDY)], "step int, label string")
    total = truth.agg(F.count("*").alias("total"))
    return names.join(found, "step", "left").crossJoin(F.broadcast(total)).select("step", "label", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), "total")


def merge_statistics(parts: DataFrame) -> DataFrame:
    """One row from rows of statistics of parts: counts add up, means are weighted by entities, the middle is the mean of middles and p95 the largest (an approximation)."""
    n = F.col("entities")
    return parts.agg(
        F.sum(n).alias("entities"), F.sum("total").alias("total"), F.sum("retrieved").alias("retrieved"), F.sum("lost_to_cap").alias("lost_to_cap"), F.sum("lost_to_blocking").alias("lost_to_blocking"),
        F.round(F.sum(F.col("mean") * n) / F.sum(n), 2).alias("mean"), F.bround(F.avg("median"), 0).cast("long").alias("median"), F.max("p95").alias("p95"), F.max("largest").alias("largest"),
    )


# --------------------------------------------------------------------------- classifiers


def f05(precision: Column, rec: Column) -> Column:
    return F.when(0.25 * precision + rec > 0, 1.25 * precision * rec / (0.25 * precision + rec)).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and f05 of (label, prob) rows at a threshold."""
    hit, true = F.col("prob") >= threshold, F.col("label") == 1
    counts = scored.groupBy(*(by or [])).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("f05", f05(F.col("precision"), F.col("recall")))


def threshold_sweep(scored: DataFrame, first: int = 20, last: int = 975, step: int = 5) -> DataFrame:
    """(threshold, tp, fp, fn, f05) at first / 1000, ... last / 1000.

    Rows are first counted per threshold that they pass last (at most 192 of them and a count below),
    then summed from above: the rows are read once and never multiplied by thresholds.
    """
    spark = scored.sparkSession
    n = (last - first) // step
    k = F.floor((F.col("prob") * 1000 - first) / step).cast("int")
    at = lambda i: (F.lit(first) + i * step) / 1000  # noqa: E731  exact test where the product rounds
    k = F.when(F.col("prob") >= at(k + 1), k + 1).when(F.col("prob") < at(k), k - 1).otherwise(k)
    bins = scored.select(F.greatest(F.least(k, F.lit(n)), F.lit(-1)).alias("k"), "label").groupBy("k").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    grid = spark.range(-1, n + 1).select(F.col("id").cast("int").alias("k")).join(bins, "k", "left").select("k", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = grid.withColumn("tp", F.sum("p").over(above)).withColumn("fp", F.sum("q").over(above)).withColumn("fn", F.sum("p").over(whole) - F.col("tp")).where("k >= 0")
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(((F.lit(first) + F.col("k") * step) / 1000).alias("threshold"), "tp", "fp", "fn", f05(p, r).alias("f05"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """(threshold, f05): the best F0.5, of equal ones the lowest threshold; 0.5 and 0 if none is above 0."""
    top = threshold_sweep(scored).where("tp + fp > 0 AND f05 > 0").agg(F.max(F.struct("f05", (-F.col("threshold")).alias("t"))).alias("b"))
    return top.select(F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"), F.coalesce("b.f05", F.lit(0.0)).alias("f05"))


def average_precision(scored: DataFrame, buckets: int = 1024) -> DataFrame:
    """(average_precision): sum of precision times the step in recall over distinct scores, from above.

    Sums from above are made within buckets of scores and over the buckets, so that no task sees all scores.
    """
    per = scored.groupBy("prob").agg(F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("prob") * buckets))
    over = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = per.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    base = sums.select("bucket", F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("n0"))
    within = Window.partitionBy("bucket").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = per.withColumn("tp", F.sum("p").over(within)).withColumn("seen", F.sum("n").over(within)).join(F.broadcast(base), "bucket")  # a row a bucket
    gain = F.sum(F.col("p") * (F.col("tp") + F.col("p0")) / (F.col("seen") + F.col("n0")))
    return steps.agg(F.when(F.sum("p") > 0, gain / F.sum("p")).otherwise(F.lit(0.0)).alias("average_precision"))
