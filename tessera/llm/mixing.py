"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, every source gets a target, and its rate is target / size.
A document is emitted floor(rate) times, plus once more where a hash of its id and the seed
falls under the rate's fraction.  Targets share the whole size by weight but stop at
``max_repeat`` times the source; what is over goes to the others by weight.  That is water
filling: with sources ordered by size / weight, those that stop are a prefix, found with one
window over the (few) source rows, so no driver loop is needed.

Defined cases: null source is a source of its own, after all others; null or empty text has
size 0, is taken 0 words but still counts as a document; a source of size 0 has target 0 and
rate 0; rows that repeat an id draw the same number; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = "mix-1"
#: Copies of each source's row in the join, so that one hot source is many keys.
SALTS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from md5(seed:doc_id): 52 bits, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, rate) from rows with source and size."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("w"),
    )
    # In order of size / weight; a source stops if it does at the level that all later ones would share with it.
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    levels = weighed.select(
        "source",
        "source_size",
        "w",
        (F.sum("source_size").over(everything) - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        F.sum("w").over(after).alias("w_left"),
    ).withColumn("stops", max_repeat * F.col("source_size") <= F.col("left") * F.col("w") / F.col("w_left"))
    # The first that does not stop fixes the level of all from there on.
    first = F.min(F.when(~F.col("stops"), F.struct((F.col("source_size") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), "source", "left", "w_left"))).over(everything)
    return (
        levels.withColumn("open", first)
        .withColumn(
            "target",
            F.when(F.col("stops"), (max_repeat * F.col("source_size")).cast("double")).otherwise(F.col("open.left") * F.col("w") / F.col("open.w_left")),
        )
        .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    )


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row of docs: doc_id, size, source_size, target, copies, and the columns named in keep.

    The sources' rows go to the documents by a join on (source, salt): the salts split a source
    that holds most rows, and Spark broadcasts the small side by itself where its measured size allows.
    """
    rows = docs.select("doc_id", F.col("source").alias("source"), size_of(F.col("text")).alias("size"), *[F.col(c).alias(f"_kept_{c}") for c in keep])
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rates = targets(rows.select("source", "size"), weights, max_repeat).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.alias("d").join(rates.alias("r"), (F.col("d.salt") == F.col("r.salt")) & F.col("d.source").eqNullSafe(F.col("r.source")))
    whole = F.floor("r.rate")
    extra = F.when(uniform(F.col("d.doc_id"), seed) < F.col("r.rate") - whole, 1).otherwise(0)
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), "d.size", "r.source_size", "r.target", (whole + extra).cast("long").alias("copies"), *[F.col(f"_kept_{c}").alias(c) for c in keep]
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    taken = copies(docs, weights, max_repeat, seed, keep=others).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, (SELECT sum(source_size) FROM s)::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
  sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
  row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM w),
f AS (SELECT *, 3 * source_size <= rest * w / w_rest AS stops FROM l),
o AS (SELECT rest, w_rest FROM f WHERE NOT stops ORDER BY k LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN f.stops THEN (3 * f.source_size)::DOUBLE ELSE o.rest * f.w / o.w_rest END AS target FROM f LEFT JOIN o ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
u AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.rate, ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM u
"""
