"""Data profiling (R1 to R13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE
from .pairs import parse_truth

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def missing_values(records: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(column, empty, whitespace_only, untrimmed): null counts as empty; the last two are of values that are not empty."""
    aggregates = []
    for c in columns:
        v = F.coalesce(F.col(c), F.lit(""))
        aggregates.append(F.struct(F.lit(c).alias("column"), F.count_if(v == "").alias("empty"), F.count_if((v != "") & (trimmed(v) == "")).alias("whitespace_only"), F.count_if((v != "") & (trimmed(v) != v)).alias("untrimmed")))
    return records.agg(F.array(*aggregates).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def duplicate_ids(records: DataFrame, key: str = "entity_id") -> DataFrame:
    """(rows, distinct_ids, duplicates): occurrences after the first."""
    return records.groupBy(key).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_ids")).withColumn("duplicates", F.col("rows") - F.col("distinct_ids"))


def duplicate_values(records: DataFrame) -> DataFrame:
    """(value, distinct_values, repeated_values, duplicate_rows) of names, addresses, and both together."""
    name, address = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    kinds = F.array(
        F.struct(F.lit("name").alias("value"), name.alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("address").alias("value"), address.alias("a"), F.lit("").alias("b")),
        F.struct(F.lit("name_address").alias("value"), name.alias("a"), address.alias("b")),
    )
    grouped = records.select(F.explode(kinds).alias("k")).select("k.*").groupBy("value", "a", "b").count()
    return grouped.groupBy("value").agg(F.count("*").alias("distinct_values"), F.count_if(F.col("count") > 1).alias("repeated_values"), (F.sum("count") - F.count("*")).alias("duplicate_rows"))


def non_ascii(records: DataFrame) -> DataFrame:
    """(names, addresses, rows) with a character beyond ASCII."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"[^\x00-\x7F]")
    return records.agg(F.count_if(has("business_name")).alias("names"), F.count_if(has("business_address")).alias("addresses"), F.count_if(has("business_name") | has("business_address")).alias("rows"))


def length_statistics(records: DataFrame) -> DataFrame:
    """(field, unit, n, least, most, mean, std, p25, median, p75) of the trimmed values that are not empty.

    Lengths are counted per value first, so the exact percentiles are over few distinct lengths.
    """
    name, address = (trimmed(F.coalesce(F.col(c), F.lit(""))) for c in ("business_name", "business_address"))
    words = lambda v: F.size(F.split(v, f"{SPACE}+"))
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(u).alias("unit"), (F.length(v) if u == "chars" else words(v)).alias("len"), (v != "").alias("there")) for f, v in (("name", name), ("address", address)) for u in ("chars", "words")])
    counted = records.select(F.explode(kinds).alias("k")).where("k.there").groupBy("k.field", "k.unit", "k.len").agg(F.count("*").alias("k"))
    return length_summary(counted)


def length_summary(counted: DataFrame) -> DataFrame:
    """The statistics of (field, unit, len, k): k values of a length.  Sums of squares are exact decimals, since their product with n is beyond whole numbers of 64 bits at some 1 GB of texts."""
    upto = Window.partitionBy("field", "unit").orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("field", "unit")
    at = counted.withColumn("cum", F.sum("k").over(upto)).withColumn("total", F.sum("k").over(whole))
    p = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("len")))
    whole_number = lambda c: F.col(c).cast("decimal(38,0)")
    n, s, s2 = F.sum("k"), F.sum(F.col("len") * F.col("k")), F.sum(whole_number("len") * whole_number("len") * whole_number("k"))
    exact_n, exact_s = (x.cast("decimal(38,0)") for x in (n, s))
    mean, variance = s / n, (s2 * exact_n - exact_s * exact_s).cast("double") / (n.cast("double") * n)
    return at.groupBy("field", "unit").agg(
        n.alias("n"), F.min("len").alias("least"), F.max("len").alias("most"), F.round(mean, 2).alias("mean"), F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), 2).alias("std"), p(0.25).alias("p25"), p(0.5).alias("median"), p(0.75).alias("p75")
    )


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("country", F.lit("")).alias("country")).agg(F.count("*").alias("rows")).withColumn("pct", F.round(F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()), 2))


def truth_summary(truth: DataFrame) -> DataFrame:
    """One row about a ground-truth table (R7)."""
    parts = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), trimmed), lambda x: x != "")
    rows = truth.select(F.col("source1_entity_id").alias("s1_id"), parts.alias("p"))
    count = lambda prefix: F.sum(F.size(F.filter("p", lambda x: F.startswith(x, F.lit(prefix)))))
    per = rows.agg(
        F.count("*").alias("rows"), F.count_if(F.size("p") == 0).alias("zero"), F.count_if(F.size("p") == 1).alias("one"), F.count_if(F.size("p") > 1).alias("several"), count("S2-").alias("s2_matches"), count("S3-").alias("s3_matches"),
        F.sum(F.size("p")).alias("matches"), F.count_if(F.size(F.array_distinct("p")) < F.size("p")).alias("rows_with_repeats"),
    )
    ids = rows.groupBy("s1_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_s1_ids"))
    distinct = rows.select(F.explode("p").alias("x")).distinct().agg(F.count("*").alias("distinct_matched_ids"))
    return per.withColumn("other_matches", F.col("matches") - F.col("s2_matches") - F.col("s3_matches")).crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(distinct))  # single rows


def match_counts(truth: DataFrame) -> DataFrame:
    """(matches, rows, rows_cum, pct_cum): how many records have so many matches, and so many or fewer."""
    parts = F.filter(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: trimmed(x) != "")
    upto = Window.orderBy("matches").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = truth.select(F.size(parts).alias("matches")).groupBy("matches").agg(F.count("*").alias("rows"))
    return counted.withColumn("rows_cum", F.sum("rows").over(upto)).withColumn("pct_cum", F.round(F.col("rows_cum") * 100.0 / F.sum("rows").over(Window.partitionBy()), 2))


def integrity(truth: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, matched, existing, dangling): distinct matched ids with and without a record."""
    ids = parse_truth(truth).select("cand_id").distinct()
    there = targets.select(F.col("entity_id").alias("cand_id")).distinct().withColumn("there", F.lit(True))
    return ids.join(there, "cand_id", "left").groupBy(F.substring("cand_id", 1, 2).alias("source")).agg(F.count("*").alias("matched"), F.count("there").alias("existing")).withColumn("dangling", F.col("matched") - F.col("existing"))


def target_coverage(truth: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, records, matched, singletons, pct_matched) of the target sources."""
    ids = parse_truth(truth).select(F.col("cand_id").alias("entity_id")).distinct().withColumn("hit", F.lit(True))
    rows = targets.select("entity_id").distinct().join(ids, "entity_id", "left")
    out = rows.groupBy(F.substring("entity_id", 1, 2).alias("source")).agg(F.count("*").alias("records"), F.count("hit").alias("matched"))
    return out.withColumn("singletons", F.col("records") - F.col("matched")).withColumn("pct_matched", F.round(F.col("matched") * 100.0 / F.col("records"), 2))


def _numbers(records: DataFrame) -> DataFrame:
    return records.select(F.col("source"), F.try_to_number(F.substring("entity_id", 4, 18), F.lit("999999999999999999")).cast("long").alias("number")).where("number IS NOT NULL").distinct()


def suffix_overlaps(records: DataFrame) -> DataFrame:
    """(a, b, shared): numbers after the prefix that two sources both use, for each two of the column source.

    Each number's sources are gathered once (there are few sources), so all overlaps come from one grouping.
    """
    sets = _numbers(records).groupBy("number").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    two = F.expr("flatten(transform(sequence(1, size(s) - 1), i -> transform(slice(s, i + 1, size(s)), y -> struct(s[i - 1] AS a, y AS b))))")
    return sets.select(F.explode(two).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


def expected_collisions(records: DataFrame, space: float = 1e9) -> DataFrame:
    """(a, b, expected): numbers that two sources would share by chance."""
    n = records.groupBy("source").agg(F.count("*").alias("n"))
    return n.alias("x").join(n.alias("y"), F.col("x.source") < F.col("y.source")).select(F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.bround(F.col("x.n") * F.col("y.n") / space, 0).cast("long").alias("expected"))


def simple_profile(records: DataFrame) -> DataFrame:
    """(measure, value, n): rows, missing values by column and rows by country, as one long table."""
    missing = missing_values(records).select(F.lit("missing").alias("measure"), F.col("column").alias("value"), F.col("empty").alias("n"))
    countries = country_counts(records).select(F.lit("country").alias("measure"), F.col("country").alias("value"), F.col("rows").alias("n"))
    return records.agg(F.count("*").alias("n")).select(F.lit("rows").alias("measure"), F.lit("").alias("value"), "n").unionByName(missing).unionByName(countries)
