"""Blocking keys of target records (B1 to B8), as long rows (pass, country, key, entity_id).

The number of rows under a key decides whether the key is used.  Keys of the token passes that
are too frequent are gone before any join, so that no block is larger than its limit; the count
is one grouped sum with partial sums before its shuffle.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V

EXACT, CONSERVATIVE, SORTED, BIGRAM, NAME, ADDRESS, PREFIX = PASSES = (
    "exact_name", "exact_conservative", "sorted_name", "name_bigram", "name_token", "addr_token", "prefix_6gram",
)


@dataclass(frozen=True)
class Limits:
    """Largest numbers of rows under a key, and the length of the prefix key."""

    name: int = 400
    address: int = 150
    bigram: int = 200
    block: int = 500
    prefix_len: int = 6


def country_of(country: Column) -> Column:
    return F.when(F.coalesce(country, F.lit("")) == "", "UNKNOWN").otherwise(country)


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "\\'") + "'" for w in words) + ")"


# SQL over a record's columns, or over a token t: the same expression is part of many plans, and text is parsed in one call.
COUNTRY = "CASE WHEN coalesce(country, '') = '' THEN 'UNKNOWN' ELSE country END"
NUMBER = r"((t < ':' OR t > '~') AND t RLIKE r'^\p{Nd}+$')"  # most words are no numbers by their first byte
name_token = lambda t: f"({t} NOT IN {_in(V.NAME_STOP_TOKENS)} AND length({t}) >= 3)"
NAME_TOKEN = name_token("t")
ADDRESS_TOKEN = f"((length(t) >= 4 OR (length(t) >= 2 AND {NUMBER})) AND t NOT IN {_in(V.ADDRESS_STOP_TOKENS)})"
NO_TOKENS = "cast(array() AS array<string>)"
ADDRESS_TOKENS = f"CASE WHEN NOT addr_is_empty THEN addr_tokens ELSE {NO_TOKENS} END"
CLEAN = "trim(regexp_replace(name_normalized, r'(?i)^(" + "|".join(V.HONORIFICS) + r")\b[\s.\-/]*', ''))"
SORTED_KEY = "CASE WHEN size(name_tokens) >= 2 THEN array_join(array_sort(name_tokens), ' ') END"
#: Pairs of neighbouring tokens, in order, repeats included.
BIGRAMS = f"CASE WHEN size(name_tokens) >= 2 THEN transform(sequence(0, size(name_tokens) - 2), i -> concat(name_tokens[i], '_', name_tokens[i + 1])) ELSE {NO_TOKENS} END"


def prefix_key(n: int = 6) -> str:
    compact = "replace(name_normalized, ' ', '')"
    return f"CASE WHEN length({compact}) >= {n} THEN substring({compact}, 1, {n}) END"


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def name_tokens() -> Column:
    """A record's name tokens that make keys, repeats included."""
    return F.expr(f"filter(name_tokens, t -> {NAME_TOKEN})")


def address_tokens() -> Column:
    """The same of an address that is not empty."""
    return F.expr(f"filter({ADDRESS_TOKENS}, t -> {ADDRESS_TOKEN})")


def target_keys(records: DataFrame, limits: Limits = Limits(), passes: tuple[str, ...] = PASSES) -> DataFrame:
    """All keys of preprocessed records, before any limit.  ordinal (default: the id) is the order of arrival."""
    made = {  # few keys a record; those of an address are many, and are dealt with a word at a time
        EXACT: f"array_distinct(filter(array(name_normalized, CASE WHEN name_normalized <> '' THEN {CLEAN} END), k -> k <> ''))",
        CONSERVATIVE: "filter(array(CASE WHEN name_conservative <> name_normalized THEN name_conservative END), k -> k <> '')",
        SORTED: f"filter(array({SORTED_KEY}), k -> k IS NOT NULL)",
        BIGRAM: BIGRAMS,
        NAME: f"filter(name_tokens, t -> {NAME_TOKEN})",
        PREFIX: f"filter(array({prefix_key(limits.prefix_len)}), k -> k IS NOT NULL)",
    }
    ordinal = "ordinal" if "ordinal" in records.columns else "entity_id AS ordinal"
    parts = []
    if of_names := [p for p in PASSES if p in passes and p in made]:
        families = ", ".join(f"named_struct('pass', '{p}', 'keys', {made[p]})" for p in of_names)
        rows = records.selectExpr("entity_id", f"{COUNTRY} AS country", ordinal, f"explode(array({families})) AS f")
        parts.append(rows.selectExpr("f.pass AS pass", "country", "explode(f.keys) AS key", "entity_id", "ordinal"))
    if ADDRESS in passes:
        rows = records.selectExpr("entity_id", f"{COUNTRY} AS country", ordinal, f"explode({ADDRESS_TOKENS}) AS t").where(ADDRESS_TOKEN)
        parts.append(rows.selectExpr(f"'{ADDRESS}' AS pass", "country", "t AS key", "entity_id", "ordinal"))
    return functools.reduce(DataFrame.unionByName, parts)


def limit_of(limits: Limits) -> str:
    """SQL: the largest df at which a key of its pass is used; null where there is none."""
    return f"CASE pass WHEN '{BIGRAM}' THEN {limits.bigram} WHEN '{NAME}' THEN {limits.name} WHEN '{ADDRESS}' THEN {limits.address} WHEN '{PREFIX}' THEN {limits.block} END"


def key_counts(keys: DataFrame) -> DataFrame:
    """(pass, country, key, df) of all keys; df counts rows, not records."""
    return keys.groupBy("pass", "country", "key").agg(F.count("*").alias("df"))


def within_limits(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The keys that are used.  A key of sorted names is never dropped: it keeps its first rows, so its df stops at the block limit."""
    used = counts.where(f"coalesce(df <= {limit_of(limits)}, true)")
    return used.withColumn("df", F.expr(f"CASE WHEN pass = '{SORTED}' THEN least(df, {limits.block}) ELSE df END"))


def document_frequencies(keys: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(pass, country, key, df) of the keys within their limits."""
    return within_limits(key_counts(keys), limits)


def hottest(counts: DataFrame, rows: int, limits: Limits = Limits(), most: int = 1000) -> DataFrame:
    """Keys beyond their limits that hold more than one in most of all rows: fewer than most of them, whatever the input."""
    return counts.where(f"df > {limit_of(limits)} AND df > {rows} DIV {most}").select("pass", "country", "key")


#: What tells one key from another.
KEY = ("pass", "country", "key")


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b with equal keys.  A hash comes first in the join's order, as most of a sort's steps compare nothing else then."""
    hashed = lambda df: df.withColumn("_h", F.xxhash64(*KEY))
    return hashed(a).join(hashed(b), ["_h", *KEY]).drop("_h")


#: Bits a key of a filter, and the most that a filter has: it is broadcast, 64 bits a row.
BITS_A_KEY, MOST_BITS = 16, 1 << 24


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key is not among wanted, a table in files; every row whose key is stays.

    A bit is set for the hash of each wanted key, in 262,144 rows at most.  Where keys are so many
    that most bits are set, fewer rows leave here, and the join that follows drops them.
    """
    bits = 1 << (min(MOST_BITS, max(64, BITS_A_KEY * wanted.count())) - 1).bit_length()
    hashed = lambda df: df.withColumn("_at", F.pmod(F.xxhash64(*KEY), F.lit(bits)))
    place = "cast(_at & 63 AS int)"
    words = hashed(wanted).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, {place}))").alias("_set"))
    there = (F.shiftright("_at", 6) == F.col("_word")) & F.expr(f"shiftright(_set, {place}) & 1L = 1")
    return hashed(rows).join(F.broadcast(words), there, "left_semi").drop("_at")


def first_of_sorted(keys: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """keys without the rows of a sorted-name key that come after the block limit."""
    ordered = Window.partitionBy("country", "key").orderBy("ordinal", "entity_id")
    kept = keys.where(F.col("pass") == SORTED).withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= limits.block).drop("_n")
    return keys.where(F.col("pass") != SORTED).unionByName(kept)


def index_statistics(records: DataFrame) -> DataFrame:
    """(country, records): how many records are indexed, null country for all."""
    return records.select(country_of(F.col("country")).alias("country")).rollup("country").agg(F.count("*").alias("records"))
