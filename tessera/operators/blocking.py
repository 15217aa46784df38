"""Candidates of source-1 records by blocking (Q1 to Q10): one bounded equi-join.

probe keys -> join with key counts (rarest first where a pass takes a few) -> join with the
targets' keys -> sum of scores per pair -> rank per record.  Scores are whole numbers without
floating point: int(c - log2(df)) is c - length(bin(df - 1)) for df of at least 2.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved
from . import keys as K

#: A constant score; or (least, most before the loss by frequency).
SCORES = {K.CONSERVATIVE: 80, K.SORTED: 70, K.BIGRAM: (25, 65), K.NAME: (12, 35), K.ADDRESS: (15, 40), K.PREFIX: 8}


@dataclass(frozen=True)
class Options:
    max_candidates: int = 50
    passes: tuple[str, ...] = K.PASSES
    tokens: int = 3
    bigrams: int = 3
    numbers: int = 2
    block_cap: int = 500


def probe_keys(queries: DataFrame, options: Options = Options(), limits: K.Limits = K.Limits()) -> DataFrame:
    """(s1_id, pass, country, key, pos, grp, base): the keys a record is looked up by, in its order.

    grp: 0 for all keys, 1 for rarest-first words, 2 for address numbers in their order; pos is the place among all words.
    """
    one = lambda key, base: f"transform(filter(array({key}), k -> k <> ''), k -> named_struct('key', k, 'pos', 0, 'grp', 0, 'base', {base}))"
    several = lambda tokens, grp: f"transform({tokens}, (k, i) -> named_struct('key', k, 'pos', i, 'grp', {grp}, 'base', 0))"
    made = {
        K.EXACT: f"concat({one('name_normalized', 100)}, {one(f'CASE WHEN {K.CLEAN} <> name_normalized THEN {K.CLEAN} END', 95)})",
        K.CONSERVATIVE: one("CASE WHEN name_conservative <> name_normalized THEN name_conservative END", 0),
        K.SORTED: one(K.SORTED_KEY, 0),
        K.BIGRAM: several(f"slice({K.BIGRAMS}, 1, {options.bigrams})", 0),
        K.NAME: f"filter({several('name_tokens', 1)}, k -> {K.name_token('k.key')})",
        K.PREFIX: one(K.prefix_key(limits.prefix_len), 0),
    }
    parts = []
    if of_names := [p for p in K.PASSES if p in options.passes and p != K.ADDRESS]:
        families = ", ".join(f"named_struct('pass', '{p}', 'keys', {made[p]})" for p in of_names)
        rows = queries.selectExpr("entity_id AS s1_id", f"{K.COUNTRY} AS country", f"explode(array({families})) AS f")
        rows = rows.selectExpr("s1_id", "f.pass AS pass", "country", "explode(f.keys) AS k")
        parts.append(rows.select("s1_id", "pass", "country", "k.key", "k.pos", "k.grp", "k.base"))
    if K.ADDRESS in options.passes:  # many keys a record, which no other pass carries along: dealt with a word at a time
        rows = queries.selectExpr("entity_id AS s1_id", f"{K.COUNTRY} AS country", f"posexplode({K.ADDRESS_TOKENS}) AS (pos, t)").where(K.ADDRESS_TOKEN)
        parts.append(rows.selectExpr("s1_id", f"'{K.ADDRESS}' AS pass", "country", "t AS key", "pos", f"CASE WHEN {K.NUMBER} THEN 2 ELSE 1 END AS grp", "0 AS base"))
    return functools.reduce(DataFrame.unionByName, parts)


def score() -> Column:
    """What a row under a key is worth, from pass, base and df."""
    loss = "length(bin(greatest(df, 2) - 1))"
    worth = lambda w: str(w) if isinstance(w, int) else f"greatest({w[0]}, {w[1]} - {loss})"
    return F.expr(f"cast(CASE pass WHEN '{K.EXACT}' THEN base " + " ".join(f"WHEN '{p}' THEN {worth(w)}" for p, w in SCORES.items()) + " END AS bigint)")


def chosen_probes(probes: DataFrame, frequencies: DataFrame, options: Options = Options()) -> DataFrame:
    """Probes whose key is in the index: the rarest words (ties: the first) and first numbers of a record, within the block cap."""
    found = K.joined(probes, frequencies)
    order = Window.partitionBy("s1_id", "pass", "grp").orderBy(F.expr("CASE WHEN grp = 1 THEN df ELSE 0 END"), "pos", "key")
    most = max(2, options.tokens, options.numbers, options.bigrams)  # no pass has more keys of a record without a choice
    picked = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return picked.where(f"_n <= CASE grp WHEN 1 THEN {options.tokens} WHEN 2 THEN {options.numbers} ELSE _n END AND df <= {options.block_cap}").drop("_n").withColumn("score", score())


def look_up(probes: DataFrame, keys: DataFrame, counts: DataFrame, options: Options, limits: K.Limits) -> DataFrame:
    """Hits of probes in an index of keys.  counts are the keys' frequencies, in files.

    The words that make up most of a text are beyond their limits; the hottest of them, a number
    bounded by construction, are broadcast and leave both sides before their shuffles.  Of the
    probes only rows whose key's hash is that of a key within its limit are shuffled, and of the
    index only those whose key's hash is that of a chosen probe.
    """
    rows = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    hot = F.broadcast(K.hottest(counts, rows, limits))  # fewer than 1,000 keys
    cold = lambda df: df.join(hot, ["pass", "country", "key"], "left_anti")
    used = K.within_limits(counts, limits)
    chosen = saved(chosen_probes(cold(K.likely(probes, used)), used, options).select("s1_id", "pass", "country", "key", "score"))
    kept = K.first_of_sorted(keys, limits).select("pass", "country", "key", F.col("entity_id").alias("cand_id"))
    return K.joined(chosen, cold(K.likely(kept, chosen))).select("s1_id", "cand_id", "pass", "score")


def hits(queries: DataFrame, targets: DataFrame, options: Options = Options(), limits: K.Limits = K.Limits()) -> DataFrame:
    """(s1_id, cand_id, pass, score): a row for each row under a chosen key."""
    keys = K.target_keys(targets, limits, options.passes)
    return look_up(probe_keys(queries, options, limits), keys, saved(K.key_counts(keys)), options, limits)


#: Passes by name; a pair's passes are bits in this order until they are named.
NAMED = tuple(sorted(K.PASSES))


def passes_of(mask: str) -> Column:
    """The passes whose bits are set, by name."""
    return F.expr("filter(array(" + ", ".join(f"'{p}'" for p in NAMED) + f"), (p, i) -> (shiftright({mask}, i) & 1) = 1)")


def merged(hit_rows: DataFrame, named: bool = True) -> DataFrame:
    """(s1_id, cand_id, score, methods): one row a pair, before the cap; not named, with the passes' bits as mask.

    Hits are dealt out by record, so that pairs and their ranks need no other shuffle; a record's
    hits are bounded by its chosen keys and their limits.
    """
    bit = F.expr("CASE pass " + " ".join(f"WHEN '{p}' THEN {1 << k}" for k, p in enumerate(NAMED)) + " END")
    dealt = hit_rows.select("s1_id", "cand_id", "score", bit.alias("_bit")).repartition("s1_id")
    pairs = dealt.groupBy("s1_id", "cand_id").agg(F.sum("score").alias("score"), F.bit_or("_bit").alias("_mask"))
    return pairs.select("s1_id", "cand_id", "score", passes_of("_mask").alias("methods") if named else F.col("_mask").alias("mask"))


def ranked(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """pairs with rn, their rank within a record; those after the most-th are dropped as early as Spark can."""
    if "mask" in pairs.columns:  # all but the id as one whole number, since a comparison of long orders is what most of the sort costs
        bit = lambda *passes: f"if(mask & {sum(1 << NAMED.index(p) for p in passes)} <> 0, 1, 0)"
        keys = [f"(((((score * 8 + bit_count(mask)) * 2 + {bit(K.EXACT)}) * 2 + {bit(K.BIGRAM, K.SORTED)}) * 2 + {bit(K.NAME)}) * 2 + {bit(K.ADDRESS)})", "cand_id"]
        return _with_rank(pairs, keys, most)
    has = lambda p: f"array_contains(methods, '{p}')"
    keys = ["score", "size(methods)", has(K.EXACT), f"{has(K.BIGRAM)} OR {has(K.SORTED)}", has(K.NAME), has(K.ADDRESS), "cand_id"]
    return _with_rank(pairs, keys, most)


def _with_rank(pairs: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    order = Window.partitionBy("s1_id").orderBy(*[F.expr(k).desc() for k in keys])
    out = pairs.withColumn("rn", F.row_number().over(order))
    return out if most is None else out.where(F.col("rn") <= most)


def candidates(queries: DataFrame, targets: DataFrame, source: str = "", options: Options = Options(), limits: K.Limits = K.Limits()) -> DataFrame:
    """The capped candidates of every record, with their number before the cap."""
    pairs = merged(hits(queries, targets, options, limits))
    counted = pairs.withColumn("raw_candidate_count", F.count("*").over(Window.partitionBy("s1_id")))
    return ranked(counted, options.max_candidates).select(
        F.col("s1_id").alias("source1_entity_id"), F.col("cand_id").alias("candidate_entity_id"), F.lit(source).alias("candidate_source"),
        F.col("methods").alias("blocking_methods"), "score", "raw_candidate_count", "rn",
    )
