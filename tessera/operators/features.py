"""The 45 features of a pair of preprocessed records (F1 to F46).

All but the eight string similarities are built-in expressions.  Ids are never a feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jvm as J
from ..functions import strings as S
from ..sources.tables import saved
from . import keys as K

NAMES = (
    "name_exact_norm", "name_exact_cons", "name_fuzz_ratio", "name_fuzz_partial_ratio", "name_token_sort_ratio", "name_token_set_ratio",
    "name_jaro_winkler", "name_len_diff", "name_len_ratio", "name_shared_tokens_count", "name_token_jaccard", "name_sorted_token_equal",
    "name_prefix_equal_4", "name_prefix_equal_6", "suffix_both_present", "suffix_exact_match", "suffix_mismatch", "suffix_either_missing",
    "addr_exact_norm", "addr_exact_cons", "addr_fuzz_ratio", "addr_token_sort_ratio", "addr_token_set_ratio", "addr_token_jaccard",
    "addr_shared_tokens_count", "addr_numeric_shared_count", "addr_numeric_jaccard", "addr_len_diff", "addr_s1_empty", "addr_cand_empty",
    "addr_either_empty", "addr_both_empty", "country_match", "name_addr_high_agreement", "name_match_addr_conflict",
    "name_token_set_x_addr_jaccard", "prov_exact_name", "prov_exact_conservative", "prov_sorted_name", "prov_name_bigram",
    "prov_name_token", "prov_addr_token", "prov_prefix_6gram", "prov_num_passes", "prov_blocking_score",
)

SIDE = ("country", "name_conservative", "name_normalized", "name_corporate_suffix", "addr_normalized")

#: A pair's rows in one round, for each record that there is: what a round shuffles is in proportion to the records.
PAIRS_A_RECORD = 0.5


def _digest(text: Column) -> Column:
    """32 bytes in place of a text that is only asked to be equal to another."""
    return F.unhex(F.sha2(text, 256))


def _words(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


#: What a pair needs of one record, made once a record and not once a pair.  A whole address goes along only where a
#: similarity is asked for: else its distinct words, as one text (tokens hold no blank), its length and two digests.
DERIVED = {
    "name_set": lambda c: F.array_distinct(c("name_tokens")),
    "name_sorted": lambda c: F.array_join(F.sort_array(c("name_tokens")), " "),
    "addr_blank": lambda c: c("addr_is_empty") | (F.trim(c("addr_normalized")) == ""),
    "addr_length": lambda c: F.length(c("addr_normalized")),
    "addr_normalized_is": lambda c: _digest(c("addr_normalized")),
    "addr_conservative_is": lambda c: _digest(c("addr_conservative")),
    "addr_words": lambda c: F.array_join(F.array_distinct(c("addr_tokens")), " "),
    "addr_figures": lambda c: F.array_join(F.array_distinct(F.filter(c("addr_tokens"), K.is_number)), " "),
}


def _num(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _jaccard(a: Column, b: Column, both: Column) -> Column:
    """Of two sets of so many that share so many."""
    return F.when((a > 0) & (b > 0), both / (a + b - both)).otherwise(0.0)


def shared(pairs: DataFrame) -> DataFrame:
    """pairs with the sizes of the sets of words of both records, and how much of each set both share; those of addresses may be there."""
    sets, of = ["name_set"], {}
    if "a_count_addr_set" not in pairs.columns:
        of = {"addr_set": "addr_words", "addr_numbers": "addr_figures"}
        sets += of
    pairs = pairs.withColumns({f"{p}_{x}": _words(F.col(f"{p}_{y}")) for p in ("a", "b") for x, y in of.items()}) if of else pairs
    counts = {f"{p}_count_{x}": F.size(f"{p}_{x}") for p in ("a", "b") for x in sets}
    return pairs.withColumns(counts | {f"a_shared_{x}": F.size(F.array_intersect(f"a_{x}", f"b_{x}")) for x in sets})


def plain_features(pairs: DataFrame) -> dict[str, Column]:
    """The features that need no string similarity, from columns a_* (source 1) and b_* (candidate) of shared()."""
    a, b = (lambda x: F.col(f"a_{x}")), (lambda x: F.col(f"b_{x}"))
    na, nb, ta, tb = a("name_normalized"), b("name_normalized"), a("name_set"), b("name_set")
    la, lb = F.length(na), F.length(nb)
    ca, cb = F.replace(na, F.lit(" "), F.lit("")), F.replace(nb, F.lit(" "), F.lit(""))
    sa, sb = F.trim(a("name_corporate_suffix")), F.trim(b("name_corporate_suffix"))
    ea, eb = a("addr_blank"), b("addr_blank")
    there = ~ea & ~eb
    both = lambda x: F.col(f"a_shared_{x}")
    jaccard = lambda x: _jaccard(a(f"count_{x}"), b(f"count_{x}"), both(x))

    def prefix(n: int) -> Column:
        return _num((F.length(ca) >= n) & (F.length(cb) >= n) & (F.substring(ca, 1, n) == F.substring(cb, 1, n)))

    def if_there(c: Column) -> Column:
        return F.when(there, c).otherwise(0.0)

    return {
        "name_exact_norm": _num((na != "") & (na == nb)),
        "name_exact_cons": _num((a("name_conservative") != "") & (a("name_conservative") == b("name_conservative"))),
        "name_len_diff": F.abs(la - lb).cast("double"),
        "name_len_ratio": F.when(F.greatest(la, lb) == 0, 1.0).otherwise(F.least(la, lb) / F.greatest(la, lb, F.lit(1))),
        "name_shared_tokens_count": both("name_set").cast("double"),
        "name_token_jaccard": jaccard("name_set"),
        "name_sorted_token_equal": _num((F.size(ta) > 0) & (F.size(tb) > 0) & (a("name_sorted") == b("name_sorted"))),
        "name_prefix_equal_4": prefix(4),
        "name_prefix_equal_6": prefix(6),
        "suffix_both_present": _num((sa != "") & (sb != "")),
        "suffix_exact_match": _num((sa != "") & (sa == sb)),
        "suffix_mismatch": _num((sa != "") & (sb != "") & (sa != sb)),
        "suffix_either_missing": _num((sa == "") | (sb == "")),
        "addr_exact_norm": _num(there & (a("addr_normalized_is") == b("addr_normalized_is"))),
        "addr_exact_cons": _num(there & (a("addr_conservative_is") == b("addr_conservative_is"))),
        "addr_token_jaccard": if_there(jaccard("addr_set")),
        "addr_shared_tokens_count": if_there(both("addr_set").cast("double")),
        "addr_numeric_shared_count": if_there(both("addr_numbers").cast("double")),
        "addr_numeric_jaccard": if_there(jaccard("addr_numbers")),
        "addr_len_diff": if_there(F.abs(a("addr_length") - b("addr_length")).cast("double")),
        "addr_s1_empty": _num(ea), "addr_cand_empty": _num(eb), "addr_either_empty": _num(ea | eb), "addr_both_empty": _num(ea & eb),
        "country_match": _num((a("country") != "") & (a("country") == b("country"))),
    }


def provenance(methods: Column, score: Column) -> dict[str, Column]:
    """One flag a pass, their number and the score; from other features where there is no metadata (null methods)."""
    absent = methods.isNull()
    stand_in = {
        K.EXACT: F.col("name_exact_norm"), K.CONSERVATIVE: F.col("name_exact_cons"), K.SORTED: F.col("name_sorted_token_equal"), K.BIGRAM: F.lit(0.0),
        K.NAME: _num(F.col("name_shared_tokens_count") >= 1), K.ADDRESS: _num(F.col("addr_shared_tokens_count") >= 1), K.PREFIX: F.col("name_prefix_equal_6"),
    }
    out = {f"prov_{p}": F.when(absent, stand_in[p]).otherwise(_num(F.array_contains(methods, p))) for p in K.PASSES}
    counted = sum((stand_in[p] for p in (K.SORTED, K.NAME, K.ADDRESS, K.PREFIX)), stand_in[K.EXACT])
    out["prov_num_passes"] = F.when(absent, counted).otherwise(F.size(F.array_distinct(methods)).cast("double"))
    out["prov_blocking_score"] = F.when(absent, F.col("name_fuzz_ratio")).otherwise(F.least(F.lit(1.0), F.coalesce(score, F.lit(0)) / 150.0))
    return out


def sides(records: DataFrame) -> DataFrame:
    """entity_id and what a pair needs of a record."""
    return records.select("entity_id", *SIDE, *[of(F.col).alias(name) for name, of in DERIVED.items()])


def paired(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs (s1_id, cand_id, ...) with both records as a_* and b_*; pairs without a record are dropped."""
    return _with_sides(pairs, sides(queries), sides(targets))


def _with_sides(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of one source-1 record follow each other where the last join sorts."""
    side = lambda df, p, key: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "entity_id"])
    return pairs.join(side(targets, "b", "cand_id"), "cand_id").join(side(queries, "a", "s1_id"), "s1_id")


def _slim_sides(records: DataFrame, similarities: bool) -> DataFrame:
    """sides() with each address packed for J.likeness(), or without whole addresses."""
    if not similarities:
        return sides(records).withColumn("addr_normalized", F.lit(""))
    names = [c for c in (*SIDE, *DERIVED) if c not in ("addr_normalized", "addr_words", "addr_figures")]
    text = F.when(DERIVED["addr_blank"](F.col), "").otherwise(F.col("addr_normalized"))
    return J.packed(records.select("entity_id", *[DERIVED[c](F.col).alias(c) if c in DERIVED else c for c in names], text.alias("addr_text")), "addr_text")


def features_in_rounds(pairs: DataFrame, queries: DataFrame, targets: DataFrame, similarities: bool = True) -> DataFrame:
    """features(paired(...)) from files, made in rounds over the pairs.

    A record's texts go along with each of its pairs, so that one join of all pairs would shuffle every
    record as often as it has pairs.  Each round takes the pairs of some source-1 records and removes
    what it shuffled before the next; there are as many rounds as keep that in proportion to the records.
    Addresses are compared in the JVM, those of one source-1 record together; the values are the same.
    """
    kept, a, b = saved(pairs), saved(_slim_sides(queries, similarities)), saved(_slim_sides(targets, similarities))
    rounds = max(1, math.ceil(kept.count() / max(1, PAIRS_A_RECORD * (a.count() + b.count()))))
    of = lambda df, key, k: df.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == k)

    def made(k: int) -> DataFrame:
        rows = _with_sides(of(kept, "s1_id", k), of(a, "entity_id", k), b)
        return features(J.likeness(rows.sortWithinPartitions("s1_id"), "a_addr_text", "b_addr_text") if similarities else rows, similarities)

    return saved(*map(made, range(rounds)))


def features(pairs: DataFrame, similarities: bool = True) -> DataFrame:
    """Rows of paired() with the features; methods and score are the metadata, if those columns exist.

    Without similarities the features that rest on them are left out, and no row goes to Python.
    Those of addresses are not made again where J.likeness() has made them.
    """
    keep = [c for c in pairs.columns if not c.startswith(("a_", "b_")) and c not in J.LIKENESS]
    there_are = [c for c in J.LIKENESS if c in pairs.columns]
    methods = F.col("methods") if "methods" in keep else F.lit(None).cast("array<string>")
    score = F.col("score") if "score" in keep else F.lit(0)
    pairs = shared(pairs)
    df = pairs.withColumns(plain_features(pairs))
    there = F.col("addr_either_empty") == 0
    if similarities:
        if there_are:
            addresses = (F.lit(""), F.lit(""))
        else:
            blank = lambda p: F.when(there, F.col(f"{p}_addr_normalized")).otherwise("")
            df = df.withColumns({"_a": blank("a"), "_b": blank("b")})
            addresses = (F.col("_a"), F.col("_b"))
        made = S.metrics(F.col("a_name_normalized"), F.col("b_name_normalized"), *addresses)
        df = df.withColumns({name: value for name, value in made.items() if name not in there_are})
        high = F.col("name_token_set_ratio")
        df = df.withColumns({
            "name_addr_high_agreement": _num(there & (high >= 0.80) & (F.col("addr_token_set_ratio") >= 0.80)),
            "name_match_addr_conflict": _num(there & (high >= 0.90) & (F.col("addr_token_jaccard") < 0.15)),
            "name_token_set_x_addr_jaccard": high * F.col("addr_token_jaccard"),
        })
    else:
        df = df.withColumn("name_fuzz_ratio", F.col("name_exact_norm"))
    df = df.withColumns(provenance(methods, score))
    return df.select(*keep, *[n for n in NAMES if n in df.columns and (similarities or n != "name_fuzz_ratio")])


def vectors(df: DataFrame, column: str = "features") -> DataFrame:
    """df with the features as one vector, in their fixed order."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(NAMES), outputCol=column).transform(df)
