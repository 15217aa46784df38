"""The queries by name, and their SQL.

Records come from the adapters and hold whole texts.  Source 1 is looked up in an index of sources
2 and 3 (``q10_candidates``, ``l5_both_sources`` and the flagship: in an index of each); the ``b``
queries index all records.  Arrays are joined to strings in results.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import blocking as B
from ..operators import evaluation as A
from ..operators import features as X
from ..operators import keys as K
from ..operators import pairs as L
from ..operators import profile as R
from ..sources import adapters, tables
from . import models as M
from . import sql as Q


def _with_tokens(kept: DataFrame) -> DataFrame:
    return kept.withColumns({f"{x}_tokens": T.words_of_normalized(F.col(f"{x}_normalized")) for x in ("name", "addr")})


class Data:
    """The relations that queries start from, each made once for a query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @functools.cached_property
    def src(self) -> DataFrame:
        return adapters.sources(self.spark, self.dir)

    @functools.cached_property
    def truth(self) -> DataFrame:
        return adapters.truth(self.spark, self.dir)

    @functools.cached_property
    def pre(self) -> DataFrame:
        """Preprocessed records, for queries that pass over them once."""
        return T.preprocess(self.src)

    @functools.cached_property
    def records(self) -> DataFrame:
        """The same from files, for queries that read them as both sides of a join; raw values are not kept, and tokens are split again when read."""
        return _with_tokens(tables.saved(self.pre.drop("name_raw", "addr_raw", "name_tokens", "addr_tokens")))

    @property
    def queries(self) -> DataFrame:
        return self.records.where("source = 'S1'")

    def targets(self, source: str | None = None) -> DataFrame:
        return self.records.where("source <> 'S1'" if source is None else F.col("source") == source)

    def hits(self, limits: K.Limits = K.Limits(), **options) -> DataFrame:
        return B.hits(self.queries, self.targets(), B.Options(**options), limits)

    def pairs(self, **options) -> DataFrame:
        return B.merged(self.hits(**options))

    @property
    def truths(self) -> DataFrame:
        return L.parse_truth(self.truth).distinct()

    @property
    def countries(self) -> DataFrame:
        return self.queries.select(F.col("entity_id").alias("s1_id"), K.country_of(F.col("country")).alias("country"))

    def scored(self) -> DataFrame:
        """Capped pairs with label and a score in place of a probability."""
        kept = B.ranked(self.pairs(), 50).drop("rn")
        return L.labelled(kept, self.truths).withColumn("prob", F.least(F.lit(1.0), F.col("score") / 150.0)).join(self.countries, "s1_id")

    def capped(self) -> DataFrame:
        """Capped pairs; no label is made."""
        kept = B.ranked(B.merged(self.hits(), named=False), 50).join(self.countries, "s1_id")
        return kept.select("s1_id", "cand_id", B.passes_of("mask").alias("methods"), "score")

    def two(self) -> DataFrame:
        """Capped pairs with both records, for queries that ask for names alone: addresses are kept for their keys, and only there."""
        self.records = _with_tokens(tables.saved(T.for_keys(self.src).drop("name_tokens", "addr_tokens"))).withColumn("addr_conservative", F.lit(""))
        return X.paired(self.capped(), self.queries, self.targets())

    def featured(self, similarities: bool = True) -> DataFrame:
        """Capped pairs with all features."""
        return X.features_in_rounds(self.capped(), self.queries, self.targets(), similarities)


def _candidates(d: Data) -> DataFrame:
    return B.candidates(d.queries, d.targets("S2"), "S2").unionByName(B.candidates(d.queries, d.targets("S3"), "S3"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of source 1 in either other source, each with its own index."""
    return _candidates(Data(spark, sf_dir)).drop("blocking_methods")


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(a, ",") for a in arrays})


def _pass_scores(passes: tuple[str, ...]) -> Callable:
    return lambda d: d.hits(passes=passes).groupBy("s1_id", "cand_id").agg(F.sum("score").alias("score"))


def _frequencies(p: str) -> Callable:
    return lambda d: K.document_frequencies(K.target_keys(d.pre, passes=(p,))).select("country", "key", "df")


def _keys(p: str) -> Callable:
    return lambda d: K.target_keys(d.pre, passes=(p,)).select("country", "key", "entity_id")


def _model(kind: str) -> Callable:
    def run(d: Data) -> DataFrame:
        df = M.dataset(d)
        return M.evaluate(M.fit(df.where("is_train"), kind), df.where("NOT is_train"))

    return run


_FREQ_SQL = lambda p: Q.chain("keys", f"SELECT country, key, df FROM freq WHERE pass = '{p}'", target="true")
_KEYS_SQL = lambda p: Q.chain("keys", f"SELECT country, key, entity_id FROM keys WHERE pass = '{p}'", target="true")
_EACH_SQL = lambda select: " UNION ALL ".join("SELECT * FROM (" + Q.chain("pairs", select.replace("$", x), target=f"source = '{x}'") + ")" for x in ("S2", "S3"))
_PASS_SQL = lambda p: Q.chain("hits", f"SELECT s1_id, cand_id, sum(score)::BIGINT AS score FROM hits WHERE pass = '{p}' GROUP BY s1_id, cand_id")
_RECALL = """count(*) AS total, count(*) FILTER (WHERE rn <= cap) AS retrieved, count(*) FILTER (WHERE rn > cap) AS lost_to_cap, count(*) FILTER (WHERE rn IS NULL) AS lost_to_blocking,
  round(count(*) FILTER (WHERE rn <= cap) * 100.0::DOUBLE / count(*), 2) AS recall_pct, round((count(*) FILTER (WHERE rn <= cap) + count(*) FILTER (WHERE rn > cap)) * 100.0::DOUBLE / count(*), 2) AS uncapped_recall_pct"""
_CONFUSION = "count(*) FILTER (WHERE h AND y) AS tp, count(*) FILTER (WHERE h AND NOT y) AS fp, count(*) FILTER (WHERE NOT h AND y) AS fn, count(*) FILTER (WHERE NOT h AND NOT y) AS tn"
_METRICS = """SELECT * EXCLUDE (p, r), p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1, CASE WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END AS f05 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS r FROM ({}))"""
_SWEEP = """grid AS (SELECT (20 + 5 * i) / 1000.0::DOUBLE AS threshold FROM range(0, 192) g(i)),
cells AS (SELECT threshold, count(*) FILTER (WHERE prob >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE prob >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE prob < threshold AND label = 1) AS fn FROM grid, scored GROUP BY threshold),
sweep AS (SELECT threshold, tp, fp, fn, CASE WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END AS f05 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS r FROM cells))"""
_PARTS = r"parts AS (SELECT source1_entity_id AS s1_id, list_filter(list_transform(string_split(matched_entity_ids, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM truth)"
_LENGTHS = r"""vals AS (SELECT 'name' AS field, trim(business_name) AS v FROM src UNION ALL SELECT 'address', trim(business_address) FROM src),
lens AS (SELECT field, unit, CASE unit WHEN 'chars' THEN length(v) ELSE len(string_split_regex(v, '\s+')) END AS l FROM vals, (VALUES ('chars'), ('words')) u(unit) WHERE v <> '')"""


def _entries() -> dict[str, tuple[Callable[[Data], DataFrame], str | None]]:
    s, c = (lambda q, more="": Q.chain("sources", q, more)), Q.chain
    out: dict[str, tuple[Callable[[Data], DataFrame], str | None]] = {
        # sources
        "s3_country_scan": (lambda d: d.src.where("country = 'France'").select("entity_id", "business_name"), s("SELECT entity_id, business_name FROM src WHERE country = 'France'")),
        "s5_first_truths": (lambda d: tables.first_rows(d.truth, 50, "source1_entity_id"), s("SELECT * FROM truth ORDER BY source1_entity_id LIMIT 50")),
        "s6_wanted_records": (
            lambda d: tables.wanted_records(d.src, L.parse_truth(d.truth).select(F.col("cand_id").alias("entity_id"))).select("entity_id", "country"),
            s("SELECT entity_id, country FROM src WHERE entity_id IN (SELECT unnest(string_split(matched_entity_ids, ',')) FROM truth)"),
        ),
        # profiling
        "r1_missing": (
            lambda d: R.missing_values(d.src),
            s(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) FILTER (WHERE {x} = '') AS empty, count(*) FILTER (WHERE {x} <> '' AND trim({x}) = '') AS whitespace_only, count(*) FILTER (WHERE {x} <> '' AND trim({x}) <> {x}) AS untrimmed FROM src" for x in R.COLUMNS)),
        ),
        "r2_duplicate_ids": (lambda d: R.duplicate_ids(d.src, "business_name"), s("SELECT count(*) AS rows, count(DISTINCT business_name) AS distinct_ids, count(*) - count(DISTINCT business_name) AS duplicates FROM src")),
        "r3_duplicates": (
            lambda d: R.duplicate_values(d.src),
            s("SELECT value, count(*) AS distinct_values, count(*) FILTER (WHERE k > 1) AS repeated_values, (sum(k) - count(*))::BIGINT AS duplicate_rows FROM (SELECT value, a, b, count(*) AS k FROM (SELECT 'name' AS value, business_name AS a, '' AS b FROM src UNION ALL SELECT 'address', business_address, '' FROM src UNION ALL SELECT 'name_address', business_name, business_address FROM src) GROUP BY ALL) GROUP BY value"),
        ),
        "r4_non_ascii": (lambda d: R.non_ascii(d.src), s(r"SELECT count(*) FILTER (WHERE regexp_matches(business_name, '[^\x00-\x7F]')) AS names, count(*) FILTER (WHERE regexp_matches(business_address, '[^\x00-\x7F]')) AS addresses, count(*) FILTER (WHERE regexp_matches(business_name || business_address, '[^\x00-\x7F]')) AS rows FROM src")),
        "r5_lengths": (
            lambda d: R.length_statistics(d.src),
            s("SELECT field, unit, count(*) AS n, min(l) AS least, max(l) AS most, round(avg(l), 2) AS mean, round(stddev_pop(l), 2) AS std, quantile_disc(l, 0.25) AS p25, quantile_disc(l, 0.5) AS median, quantile_disc(l, 0.75) AS p75 FROM lens GROUP BY field, unit", _LENGTHS),
        ),
        "r6_country": (lambda d: R.country_counts(d.src), s("SELECT country, count(*) AS rows, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM src), 2) AS pct FROM src GROUP BY country")),
        "r7_truth": (
            lambda d: R.truth_summary(d.truth),
            s("""SELECT count(*) AS rows, count(*) FILTER (WHERE len(p) = 0) AS zero, count(*) FILTER (WHERE len(p) = 1) AS one, count(*) FILTER (WHERE len(p) > 1) AS several, sum(len(list_filter(p, lambda x: x LIKE 'S2-%')))::BIGINT AS s2_matches, sum(len(list_filter(p, lambda x: x LIKE 'S3-%')))::BIGINT AS s3_matches,
  sum(len(p))::BIGINT AS matches, count(*) FILTER (WHERE len(list_distinct(p)) < len(p)) AS rows_with_repeats, sum(len(list_filter(p, lambda x: x NOT LIKE 'S2-%' AND x NOT LIKE 'S3-%')))::BIGINT AS other_matches, count(*) - count(DISTINCT s1_id) AS duplicate_s1_ids,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(p) AS x FROM parts)) AS distinct_matched_ids FROM parts""", _PARTS),
        ),
        "r8_truth_cum": (lambda d: R.match_counts(d.truth), s("SELECT matches, rows, (sum(rows) OVER (ORDER BY matches))::BIGINT AS rows_cum, round((sum(rows) OVER (ORDER BY matches)) * 100.0::DOUBLE / (sum(rows) OVER ()), 2) AS pct_cum FROM (SELECT len(p) AS matches, count(*) AS rows FROM parts GROUP BY 1)", _PARTS)),
        "r9_integrity": (
            lambda d: R.integrity(d.truth.unionByName(d.truth.limit(1).select("source1_entity_id", F.lit("S2-x, S3-y").alias("matched_entity_ids"))), d.src),
            s("SELECT substr(x, 1, 2) AS source, count(*) AS matched, count(*) FILTER (WHERE x IN (SELECT entity_id FROM src)) AS existing, count(*) FILTER (WHERE x NOT IN (SELECT entity_id FROM src)) AS dangling FROM (SELECT DISTINCT unnest(p) AS x FROM parts UNION SELECT 'S2-x' UNION SELECT 'S3-y') GROUP BY 1", _PARTS),
        ),
        "r10_coverage": (
            lambda d: R.target_coverage(d.truth, d.src.where("source <> 'S1'")),
            s("SELECT source, count(*) AS records, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE NOT hit) AS singletons, round(count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*), 2) AS pct_matched FROM (SELECT source, entity_id IN (SELECT unnest(p) FROM parts) AS hit FROM src WHERE source <> 'S1') GROUP BY source", _PARTS),
        ),
        "r11_overlap": (lambda d: R.suffix_overlaps(d.src), s("SELECT a, b, count(*) AS shared FROM (SELECT DISTINCT x.source AS a, y.source AS b, x.n FROM (SELECT source, substr(entity_id, 4)::BIGINT AS n FROM src) x JOIN (SELECT source, substr(entity_id, 4)::BIGINT AS n FROM src) y ON x.n = y.n AND x.source < y.source) GROUP BY a, b")),
        "r12_expected": (lambda d: R.expected_collisions(d.src, 1e5), s("SELECT a.source AS a, b.source AS b, round_even(a.n * b.n / 1e5, 0)::BIGINT AS expected FROM (SELECT source, count(*) AS n FROM src GROUP BY source) a JOIN (SELECT source, count(*) AS n FROM src GROUP BY source) b ON a.source < b.source")),
        "r13_profile": (
            lambda d: R.simple_profile(d.src),
            s("SELECT 'rows' AS measure, '' AS value, count(*) AS n FROM src UNION ALL SELECT 'country', country, count(*) FROM src GROUP BY country " + " ".join(f"UNION ALL SELECT 'missing', '{x}', count(*) FILTER (WHERE {x} = '') FROM src" for x in R.COLUMNS)),
        ),
        # text
        "p1_nfkc": (lambda d: d.src.select("entity_id", T.nfkc(F.concat(F.col("business_name"), F.lit(" ﬁ ＡＢＣ ²"))).alias("nfkc")), s("SELECT entity_id, business_name || ' fi ABC 2' AS nfkc FROM src")),
        "p2_lower": (lambda d: d.src.select("entity_id", T.lower(F.col("business_name")).alias("lowered")), s("SELECT entity_id, lower(business_name) AS lowered FROM src")),
        "p3_whitespace": (lambda d: d.src.select("entity_id", T.whitespace(F.replace("business_address", F.lit(" "), F.lit(" \t "))).alias("clean")), s("SELECT entity_id, trim(business_address) AS clean FROM src")),
        "p4_punctuation": (lambda d: d.src.select("entity_id", T.punctuation(F.col("business_name")).alias("plain"), T.punctuation(F.col("business_address"), True).alias("kept")), s(r"SELECT entity_id, trim(regexp_replace(regexp_replace(replace(business_name, '&', ' and '), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g')) AS plain, trim(regexp_replace(replace(regexp_replace(replace(business_address, '&', chr(1)), '[\p{P}\p{S}]', ' ', 'g'), chr(1), '&'), '\s+', ' ', 'g')) AS kept FROM src")),
        "p5_accents": (lambda d: d.src.select("entity_id", T.strip_accents(F.col("business_name")).alias("plain")), s("SELECT entity_id, strip_accents(business_name) AS plain FROM src")),
        "p6_suffix": (lambda d: d.pre.select("entity_id", "name_corporate_suffix"), c("pre", "SELECT entity_id, name_corporate_suffix FROM pre")),
        "p7_name": (lambda d: _joined(d.pre.select("entity_id", "name_raw", "name_conservative", "name_normalized", "name_corporate_suffix", "name_tokens"), "name_tokens"), c("pre", "SELECT entity_id, name_raw, name_conservative, name_normalized, name_corporate_suffix, array_to_string(toks, ',') AS name_tokens FROM pre")),
        "p8_address": (lambda d: _joined(d.pre.select("entity_id", "addr_is_empty", "addr_conservative", "addr_normalized", "addr_tokens"), "addr_tokens"), c("pre", "SELECT entity_id, addr_is_empty, addr_conservative, addr_normalized, array_to_string(atoks, ',') AS addr_tokens FROM pre")),
        "p9_record": (
            lambda d: _joined(d.pre.drop("source"), "name_tokens", "addr_tokens"),
            c("pre", "SELECT entity_id, country, name_raw, name_conservative, name_normalized, name_corporate_suffix, array_to_string(toks, ',') AS name_tokens, CASE WHEN trim(addr_raw) = '' THEN '' ELSE addr_raw END AS addr_raw, addr_is_empty, addr_conservative, addr_normalized, array_to_string(atoks, ',') AS addr_tokens FROM pre"),
        ),
        "p10_honorific": (
            lambda d: d.pre.select("entity_id", T.without_honorific(F.concat(F.element_at(F.array(*map(F.lit, ("dr ", "shri-", "", "mrs. "))), (F.length("name_normalized") % 4 + 1).cast("int")), F.col("name_normalized"))).alias("clean")),
            c("pre", f"SELECT entity_id, trim(regexp_replace(['dr ', 'shri-', '', 'mrs. '][length(name_normalized) % 4 + 1] || name_normalized, {Q._TITLE}, '')) AS clean FROM pre"),
        ),
        # predicates
        "w3_name_tokens": (lambda d: d.pre.select("entity_id", F.explode(K.name_tokens()).alias("t")), c("pre", f"SELECT * FROM (SELECT entity_id, unnest(toks) AS t FROM pre) WHERE {Q._NAME}")),
        "w4_addr_tokens": (lambda d: d.pre.select("entity_id", F.explode(K.address_tokens()).alias("t")), c("pre", f"SELECT * FROM (SELECT entity_id, unnest(atoks) AS t FROM pre) WHERE {Q._ADDRESS}")),
        "w5_block_cap": (lambda d: d.hits(block_cap=20).groupBy("s1_id", "cand_id").agg(F.sum("score").alias("score")), c("hits", "SELECT s1_id, cand_id, sum(score)::BIGINT AS score FROM hits GROUP BY s1_id, cand_id", cap=20)),
        # index
        "b1_exact_keys": (_keys(K.EXACT), _KEYS_SQL(K.EXACT)), "b2_conservative_keys": (_keys(K.CONSERVATIVE), _KEYS_SQL(K.CONSERVATIVE)),
        "b3_sorted_keys": (lambda d: K.first_of_sorted(K.target_keys(d.pre, passes=(K.SORTED,))).select("country", "key", "entity_id"), c("keys", "SELECT country, key, entity_id FROM kept WHERE pass = 'sorted_name'", target="true")),
        "b4_bigram_df": (_frequencies(K.BIGRAM), _FREQ_SQL(K.BIGRAM)), "b5_token_df": (_frequencies(K.NAME), _FREQ_SQL(K.NAME)),
        "b6_addr_df": (_frequencies(K.ADDRESS), _FREQ_SQL(K.ADDRESS)), "b7_prefix_df": (_frequencies(K.PREFIX), _FREQ_SQL(K.PREFIX)),
        "b8_index_statistics": (lambda d: K.index_statistics(d.src), s("SELECT country, count(*) AS records FROM (SELECT CASE WHEN country = '' THEN 'UNKNOWN' ELSE country END AS country FROM src) GROUP BY ROLLUP (country)")),
        # candidates
        **{f"q{k}_{name}": (_pass_scores((p,)), _PASS_SQL(p)) for k, (name, p) in enumerate((("exact", K.EXACT), ("conservative", K.CONSERVATIVE), ("sorted", K.SORTED), ("bigram", K.BIGRAM), ("token", K.NAME), ("addr", K.ADDRESS), ("prefix", K.PREFIX)), 1)},
        "q8_merge": (lambda d: _joined(d.pairs(), "methods"), c("pairs", "SELECT s1_id, cand_id, score, array_to_string(methods, ',') AS methods FROM pairs")),
        "q9_topk": (lambda d: B.ranked(d.pairs(), 5).select("s1_id", "cand_id", "score", "rn"), c("pairs", "SELECT s1_id, cand_id, score, rn FROM ranked WHERE rn <= 5")),
        "q10_candidates": (
            lambda d: _joined(_candidates(d), "blocking_methods"),
            _EACH_SQL("SELECT s1_id AS source1_entity_id, cand_id AS candidate_entity_id, '$' AS candidate_source, array_to_string(methods, ',') AS blocking_methods, score, raw_candidate_count, rn FROM ranked WHERE rn <= 50"),
        ),
        # pairs
        "l1_truth": (lambda d: L.parse_truth(d.truth), s("SELECT s1_id, unnest(p) AS cand_id FROM parts", _PARTS)),
        "l2_labels": (lambda d: d.scored().select("s1_id", "cand_id", "label"), c("scored", "SELECT s1_id, cand_id, label FROM scored")),
        "l3_recovered": (
            lambda d: L.recovered(B.ranked(d.pairs(), 3).drop("rn"), d.truths, d.targets()).drop("methods"),
            c("truths", "SELECT s1_id, cand_id, 0::BIGINT AS score, least(coalesce((SELECT count(*) FROM ranked r WHERE r.s1_id = f.s1_id), 0), 3)::BIGINT AS raw_candidate_count, 1 AS label FROM found f WHERE coalesce(rn, 99) > 3 AND cand_id IN (SELECT entity_id FROM tgt)"),
        ),
        "l4_coverage": (lambda d: L.coverage(B.ranked(d.pairs(), 50), d.truths), c("truths", "SELECT count(*) AS total, count(*) FILTER (WHERE rn <= 50) AS retrieved, count(*) FILTER (WHERE rn <= 50) * 100.0::DOUBLE / count(*) AS pct FROM found")),
        "l5_both_sources": (
            lambda d: functools.reduce(DataFrame.unionByName, [B.merged(B.hits(d.queries, d.targets(x))).agg(F.lit(x).alias("source"), F.count("*").alias("n"), F.sum("score").alias("score")) for x in ("S2", "S3")]),
            _EACH_SQL("SELECT '$' AS source, count(*) AS n, sum(score)::BIGINT AS score FROM pairs"),
        ),
        "l6_split": (
            lambda d: L.group_split(d.truth.select(F.col("source1_entity_id").alias("s1_id"))),
            s("SELECT s1_id, row_number() OVER (ORDER BY md5(s1_id || '42'), s1_id) <= floor(0.8 * count(*) OVER ()) AS is_train FROM (SELECT DISTINCT source1_entity_id AS s1_id FROM truth)"),
        ),
        "l7_negatives": (
            lambda d: L.subsample_negatives(d.scored(), 2).select("s1_id", "cand_id", "label"),
            c("scored", "SELECT s1_id, cand_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(s1_id || cand_id || '42'), s1_id, cand_id) AS k FROM scored) WHERE label = 1 OR k <= 2 * (SELECT count(*) FROM scored WHERE label = 1)"),
        ),
        "l8_matrix": (lambda d: d.featured().drop("methods"), None),
        "l9_countries": (lambda d: L.of_countries(d.src, ("US", "India")).groupBy("country").agg(F.count("*").alias("n")), s("SELECT country, count(*) AS n FROM src WHERE country IN ('US', 'India') GROUP BY country")),
        # evaluation
        "a1_recall": (lambda d: A.recall(d.truths, d.pairs()), c("truths", f"SELECT cap, {_RECALL} FROM found, (VALUES (50)) k(cap) GROUP BY cap")),
        "a1_entities": (
            lambda d: A.entity_counts(d.queries, d.truths, d.pairs()),
            c("truths", "SELECT count(*) AS entities, count(*) FILTER (WHERE entity_id IN (SELECT s1_id FROM ranked)) AS with_candidates, count(*) FILTER (WHERE done) AS with_all_matches, count(*) FILTER (WHERE done IS NULL) AS without_matches FROM qry LEFT JOIN (SELECT s1_id, bool_and(coalesce(rn <= 50, false)) AS done FROM found GROUP BY s1_id) f ON f.s1_id = entity_id"),
        ),
        "a2_distribution": (
            lambda d: A.count_distribution(d.queries, d.pairs()),
            c("truths", "SELECT kind, round(avg(n), 2) AS mean, (list(n ORDER BY n))[least(floor(0.5 * count(*)), count(*) - 1)::INT + 1] AS median, (list(n ORDER BY n))[least(floor(0.95 * count(*)), count(*) - 1)::INT + 1] AS p95, max(n) AS largest FROM kinds GROUP BY kind",
              "per AS (SELECT entity_id, count(r.s1_id) AS raw FROM qry LEFT JOIN ranked r ON r.s1_id = entity_id GROUP BY entity_id), kinds AS (SELECT 'raw' AS kind, raw AS n FROM per UNION ALL SELECT 'capped', least(raw, 50) FROM per)"),
        ),
        "a3_passes": (lambda d: A.pass_contributions(d.truths, d.pairs()), c("truths", "SELECT pass, count(*) AS retrieved FROM (SELECT unnest(methods) AS pass FROM found WHERE rn <= 50) GROUP BY pass")),
        "a4_country": (
            lambda d: A.recall(d.truths.join(d.countries, "s1_id"), d.pairs(), by="country"),
            c("truths", f"SELECT cap, country, {_RECALL} FROM found, (VALUES (50)) k(cap) GROUP BY cap, country"),
        ),
        "a4_cardinality": (
            lambda d: A.recall(L.parse_truth(d.truth).join(d.truth.select(F.col("source1_entity_id").alias("s1_id"), F.size(F.split("matched_entity_ids", ",")).alias("cardinality")), "s1_id"), d.pairs(), by="cardinality"),
            c("truths", f"SELECT cap, cardinality, {_RECALL} FROM (SELECT f.*, len(string_split(matched_entity_ids, ',')) AS cardinality FROM found f JOIN truth ON source1_entity_id = s1_id), (VALUES (50)) k(cap) GROUP BY cap, cardinality"),
        ),
        "a5_caps": (lambda d: A.recall(d.truths, d.pairs(), A.CAPS), c("truths", f"SELECT cap, {_RECALL} FROM found, (VALUES (30), (50), (75), (100)) k(cap) GROUP BY cap")),
        "a6_merge": (
            lambda d: A.merge_statistics(d.spark.createDataFrame([(10, 20, 15, 3, 2, 4.5, 4, 9, 12), (30, 50, 40, 6, 4, 6.25, 7, 8, 20)], "entities long, total long, retrieved long, lost_to_cap long, lost_to_blocking long, mean double, median long, p95 long, largest long")),
            "SELECT 40::BIGINT AS entities, 70::BIGINT AS total, 55::BIGINT AS retrieved, 9::BIGINT AS lost_to_cap, 6::BIGINT AS lost_to_blocking, 5.81::DOUBLE AS mean, 6::BIGINT AS median, 9::BIGINT AS p95, 20::BIGINT AS largest",
        ),
        "a7_incremental": (
            lambda d: A.pass_study(d.truths, d.hits(), 5),
            c("truths", "SELECT step, label, count(t.s1_id) AS retrieved, (SELECT count(*) FROM truths) AS total FROM steps LEFT JOIN (SELECT x.step, x.s1_id FROM sranked x JOIN truths t ON t.s1_id = x.s1_id AND t.cand_id = x.cand_id WHERE rn <= 5) t USING (step) GROUP BY step, label",
              "steps(step, label) AS (VALUES " + ", ".join(f"({k}, '{label}')" for k, (label, _) in enumerate(A.STUDY)) + """),
spairs AS (SELECT step, s1_id, cand_id, sum(score)::BIGINT AS score, list_sort(list(DISTINCT pass)) AS methods FROM hits, steps WHERE list_position([""" + ", ".join(f"'{p}'" for p in K.PASSES) + """], pass) <= step + 1 GROUP BY step, s1_id, cand_id),
sranked AS (SELECT *, row_number() OVER (PARTITION BY step, s1_id ORDER BY score DESC, len(methods) DESC, list_contains(methods, 'exact_name')::INT DESC, (list_contains(methods, 'name_bigram') OR list_contains(methods, 'sorted_name'))::INT DESC, list_contains(methods, 'name_token')::INT DESC, list_contains(methods, 'addr_token')::INT DESC, cand_id DESC) AS rn FROM spairs)"""),
        ),
        "a9_sweep": (lambda d: A.threshold_sweep(d.scored()), c("scored", "SELECT * FROM sweep", _SWEEP)),
        "a9_threshold": (lambda d: A.best_threshold(d.scored()), c("scored", "SELECT threshold, f05 FROM sweep ORDER BY f05 DESC, threshold LIMIT 1", _SWEEP)),
        "a10_confusion": (lambda d: A.confusion(d.scored(), 0.6), c("scored", _METRICS.format(f"SELECT {_CONFUSION} FROM (SELECT prob >= 0.6 AS h, label = 1 AS y FROM scored)"))),
        "a11_average_precision": (lambda d: A.average_precision(d.scored()), c("scored", "SELECT sum(p * tp / seen) / sum(p) AS average_precision FROM (SELECT p, (sum(p) OVER (ORDER BY prob DESC))::DOUBLE AS tp, (sum(n) OVER (ORDER BY prob DESC))::DOUBLE AS seen FROM (SELECT prob, count(*) FILTER (WHERE label = 1) AS p, count(*) AS n FROM scored GROUP BY prob))")),
        "a12_breakdown": (lambda d: A.confusion(d.scored(), 0.6, ["country"]), c("scored", _METRICS.format(f"SELECT country, {_CONFUSION} FROM (SELECT country, prob >= 0.6 AS h, label = 1 AS y FROM scored) GROUP BY country"))),
        # features
        "f1_features": (lambda d: d.featured(similarities=False).drop("methods", "score"), c("feats", Q.feature_select())),
        "f7_jaro_winkler": (lambda d: X.features(d.two()).select("s1_id", "cand_id", F.round("name_jaro_winkler", 9).alias("jw")), None),
        "f3_indel": (lambda d: X.features(d.two()).select("s1_id", "cand_id", F.round("name_fuzz_ratio", 9).alias("indel")), None),
        # models
        "m1_logistic": (_model("logistic"), None), "m2_boosting": (_model("boosting"), None), "m4_coefficients": (lambda d: M.coefficients(d), None),
    }
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Data(spark, sf_dir))) for name, (f, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}


__all__ = ["V", "flagship", "oracle_sql", "queries"]
