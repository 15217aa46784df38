"""Business records made from the tables at hand (our own design, apart from the operators).

Every document is a record with its whole text: the name is the first four words, the address
all that follows, the country follows from the language.  Documents are dealt by id to three
sources; sources 2 and 3 also have copies of source 1 with a legal form added, two words swapped
or the address left out, whose links are the ground truth.  A null id counts as 0 here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread

COUNTRIES = {"en": "US", "fr": "France", "de": "India"}


def _id() -> F.Column:
    return F.coalesce(F.col("doc_id"), F.lit(0))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, business_name, business_address, country, source) of all three sources, from one scan."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r" [\t-\r ]+|[\t-\r][\t-\r ]*", " "))  # words with single blanks
    country = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in COUNTRIES.items()], F.lit(""))
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")).select(_id().alias("id"), text.alias("text"), country.alias("country"))
    cut = docs.select("id", "country", "text", F.substring_index("text", " ", 4).alias("name")).select(
        "id", "country", "name", F.split("name", " ").alias("n"), F.expr("substring(text, length(name) + 2)").alias("address")
    )
    name = F.col("name")
    swapped = F.when(F.size("n") >= 2, F.array_join(F.concat(F.array(F.element_at("n", 2), F.element_at("n", 1)), F.slice("n", 3, 2)), " ")).otherwise(name)
    kept = F.when(F.col("id") % 20 == 0, "").otherwise(F.col("address"))
    row = lambda source, n, a: F.struct(F.lit(source).alias("source"), n.alias("business_name"), a.alias("business_address"))
    dealt = F.when(F.col("id") % 3 == 0, "S1").when(F.col("id") % 3 == 1, "S2").otherwise("S3")
    made = F.array(row("", name, F.col("address")), F.when(F.col("id") % 6 == 0, row("S2", F.concat(name, F.lit(" Inc.")), kept)), F.when(F.col("id") % 9 == 0, row("S3", swapped, kept)))
    rows = cut.select("id", "country", dealt.alias("dealt"), F.explode(made).alias("r")).where("r IS NOT NULL")
    source = F.when(F.col("r.source") == "", F.col("dealt")).otherwise(F.col("r.source"))
    return rows.select(F.concat(source, F.lit("-"), F.col("id")).alias("entity_id"), "r.business_name", "r.business_address", "country", source.alias("source"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source1_entity_id, matched_entity_ids)."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(_id().alias("id")).where("id % 3 = 0")
    pick = lambda m, p: F.when(F.col("id") % m == 0, F.concat(F.lit(p), F.col("id")))
    return ids.select(F.concat(F.lit("S1-"), F.col("id")).alias("source1_entity_id"), F.concat_ws(",", pick(6, "S2-"), pick(9, "S3-")).alias("matched_entity_ids"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``part``: few different tokens, so that frequent keys are pruned."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    country = F.element_at(F.array(F.lit("US"), F.lit("India"), F.lit("France")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(F.concat(F.lit("S2-"), F.col("p_partkey")).alias("entity_id"), F.concat_ws(" ", "p_name", "p_brand").alias("business_name"), F.concat_ws(" ", "p_type", "p_size").alias("business_address"), country.alias("country"))


#: The same in SQL, for comparison: relations docs, src and truth.
SQL = r"""
docs AS MATERIALIZED (SELECT id, list_slice(w, 1, 4) AS n, array_to_string(list_slice(w, 5, len(w)), ' ') AS address, CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' WHEN 'de' THEN 'India' ELSE '' END AS country
  FROM (SELECT coalesce(doc_id, 0) AS id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
src AS MATERIALIZED (
  SELECT CASE id % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'S3' END || '-' || id AS entity_id, array_to_string(n, ' ') AS business_name, address AS business_address, country, CASE id % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'S3' END AS source FROM docs
  UNION ALL SELECT 'S2-' || id, array_to_string(n, ' ') || ' Inc.', CASE WHEN id % 20 = 0 THEN '' ELSE address END, country, 'S2' FROM docs WHERE id % 6 = 0
  UNION ALL SELECT 'S3-' || id, CASE WHEN len(n) >= 2 THEN array_to_string([n[2], n[1]] || list_slice(n, 3, 4), ' ') ELSE array_to_string(n, ' ') END, CASE WHEN id % 20 = 0 THEN '' ELSE address END, country, 'S3' FROM docs WHERE id % 9 = 0),
truth AS (SELECT 'S1-' || id AS source1_entity_id, concat_ws(',', CASE WHEN id % 6 = 0 THEN 'S2-' || id END, CASE WHEN id % 9 = 0 THEN 'S3-' || id END) AS matched_entity_ids FROM docs WHERE id % 3 = 0)
"""
