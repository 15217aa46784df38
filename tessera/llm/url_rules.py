"""URL filters as a sort-merge range join, with DataFrame functions only.

A rule is (host, path, verdict).  With hosts reversed label by label, the rules on one host are
ranges of the paths that begin with theirs, and those ranges nest.  Each distinct (host, path)
is put under every ancestor host that has rules, rules and urls of an ancestor are sorted
together by path, and one window carries the last rule seen with its stack: the rules whose
ranges hold it.  Every rule that fits a url is on the stack of the last rule before it, since
whatever sorts between a prefix and its extension shares the prefix; the deepest stack entry
that the path begins with is the rule.  Over the ancestors the longest rule wins.

No url is compared with all rules.  Rules are copied to ``salts`` parts of each ancestor, so a
host with a third of all urls is many groups; equal urls are judged once.

Defined cases: null url or one without ``://`` has empty host and path; a repeated page gives
its row again; of rules with equal host and path the least verdict (allow) holds; an ancestor
is a whole suffix of labels, the host itself included; no pages give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
SALTS = 64


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def with_host_path(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every row."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    return (
        pages.select("page_id", rest.alias("_rest"))
        .withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
        .select("page_id", ascii_lower(F.col("_host")).alias("host"), F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0).alias("path"))
    )


def reversed_host(host) -> F.Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def stacks(rules: DataFrame) -> DataFrame:
    """Each rule as (key, path, stack): stack has the rules of its host that its path begins with, outermost first."""
    r = rules.groupBy(reversed_host(ascii_lower(F.col("host"))).alias("key"), F.col("path")).agg(F.min(F.struct("verdict", "host")).alias("v"))
    r = r.select("key", "path", F.col("v.verdict").alias("verdict"), ascii_lower(F.col("v.host")).alias("host"))
    prefixes = r.select("key", "path", F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("prefix"))
    outer = r.select("key", F.col("path").alias("prefix"), F.struct(F.length("path").alias("n"), "path", "host", "verdict").alias("entry"))
    return prefixes.join(outer, ["key", "prefix"]).groupBy("key", "path").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, default: str = DEFAULT, salts: int = SALTS) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) of urls."""
    distinct = urls.select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\."))
    ancestors = distinct.withColumn("_l", labels).withColumn("key", F.explode(F.expr("transform(sequence(1, size(_l)), n -> array_join(slice(_l, 1, n), '.'))"))).drop("_l")
    nested = stacks(rules)
    points = ancestors.join(nested.select("key").distinct(), "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
    ranges = nested.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = points.select("key", "salt", "path", "host", F.lit(1).alias("is_url"), F.lit(None).cast(nested.schema["stack"].dataType).alias("stack")).unionByName(
        ranges.select("key", "salt", "path", F.lit(None).cast("string").alias("host"), F.lit(0).alias("is_url"), "stack")
    )
    sweep = Window.partitionBy("key", "salt").orderBy("path", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("last", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    hit = swept.withColumn("rule", F.expr("try_element_at(filter(last, e -> startswith(path, e.path)), -1)")).where("rule is not null")
    best = hit.groupBy("host", "path").agg(F.max(F.struct((F.length("rule.host") + F.col("rule.n")).alias("n"), F.concat("rule.host", "rule.path").alias("rule"), F.col("rule.verdict").alias("verdict"))).alias("best"))
    return distinct.join(best, ["host", "path"], "left").select("host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, salts: int = SALTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages."""
    rows = with_host_path(pages)
    return rows.join(judge(rows, rules, default, salts), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return apply_rules(pages, rules_table(spark))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT row_number() OVER () AS k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT p.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC NULLS LAST, rhost || rpath DESC) AS n
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
