"""Normalisation of names and addresses as column expressions (P1 to P10).

NFKC has no built-in, so texts cross to Python in Arrow batches, names and addresses together and
once.  What can be done to the whole text while it is there is done there, at less than
half of what the same chain of JVM expressions costs; tokens, legal forms and all that follows stay in the JVM.  Character classes are tables made from Python's own
Unicode data, so that no engine's idea of a category matters.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from . import vocabulary as V

#: All that Python's \\s matches, for Java's engine.
SPACE = r"[\s\x1c-\x1f\u0085\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@functools.cache
def _spaces() -> str:
    return "".join(c for c in map(chr, range(0x10000)) if c.isspace() and c != " ")


@functools.cache
def _marks() -> str:
    """Punctuation and symbols of the basic plane except the ampersand, and white space."""
    return _spaces() + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c)[0] in "PS" and c != "&")


def _blanked(text: Column, characters: str) -> Column:
    """text with each of the characters as a blank, without blanks at the ends or two in a row."""
    return F.trim(F.regexp_replace(F.translate(text, characters, " " * len(characters)), " {2,}", " "))


@functools.cache
def _mark_runs() -> re.Pattern:
    return re.compile(f"[{re.escape(_marks())}]+")


@functools.cache
def _accent_marks() -> re.Pattern:
    return re.compile("[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in V.MARK_RANGES) + "]+")


def _decomposed(text: str) -> str:
    return unicodedata.normalize("NFC", _accent_marks().sub("", unicodedata.normalize("NFD", text)))


@functools.cache
def _latin_tables() -> tuple[bytes, bytes]:
    """For each of the 256 letters that are one byte: a blank for a mark, and the letter without its accent, which is one byte as well."""
    letters = list(map(chr, range(256)))
    return tuple("".join(x).encode("latin-1") for x in ([" " if c in _marks() else c for c in letters], map(_decomposed, letters)))


def _by_table(text: str, table: int) -> str | None:
    """text by a table of one-byte letters, some fifty times as fast as letter by letter; none if it has others."""
    try:
        return text.encode("latin-1").translate(_latin_tables()[table]).decode("latin-1")
    except UnicodeEncodeError:
        return None


def plain_words(text: str) -> list[str]:
    """Words of the Unicode compatibility form, lower case, ampersand as the word and, marks and white space as blanks."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    text = text.lower().replace("&", " and ")
    blanked = _by_table(text, 0)
    return (_mark_runs().sub(" ", text) if blanked is None else blanked).split()


def plain(text: str) -> str:
    return " ".join(plain_words(text))


def unaccented(text: str) -> str:
    if text.isascii():
        return text
    made = _by_table(text, 1)
    return _decomposed(text) if made is None else made


def shortened(words: list[str]) -> str:
    """Plain words of an address in their short forms, without accents."""
    text = " ".join(map(V.ADDRESS_SHORT.get, words, words))
    return text if text.isascii() else " ".join(unaccented(text).split())


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(plain)


def _each(text: pd.Series, make: Callable[[list[str]], tuple]) -> list[tuple]:
    """What make gives of the words of each text, once for equal neighbours: copies of a record often follow it."""
    out, last, made = [], None, ()
    for x in text:
        if x != last:
            last, made = x, make(plain_words(x))
        out.append(made)
    return out


@F.pandas_udf(StructType([StructField("cons", StringType()), StructField("norm", StringType())]))  # no text: workers import this without a session
def _address(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_each(text, lambda words: (" ".join(words), shortened(words))), columns=["cons", "norm"])


@F.pandas_udf(StructType([StructField("empty", BooleanType()), StructField("norm", StringType())]))
def _short_address(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_each(text, lambda words: (not words, shortened(words))), columns=["empty", "norm"])


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; null is empty."""
    return _nfkc(filled(text))


def lower(text: Column) -> Column:
    return F.lower(filled(text))


def whitespace(text: Column) -> Column:
    """Runs of any white space become one blank; none at the ends."""
    return _blanked(filled(text), _spaces())


def punctuation(text: Column, keep_ampersand: bool = False) -> Column:
    """Ampersands become the word and, unless kept; other marks and symbols become blanks."""
    text = filled(text)
    if not keep_ampersand:
        text = F.replace(text, F.lit("&"), F.lit(" and "))
    return _blanked(text, _marks())


@functools.cache
def _accents() -> tuple[str, str]:
    """For translate: characters that lose marks and what they become, then the marks themselves, which go."""
    marks = [chr(c) for lo, hi in V.MARK_RANGES for c in range(lo, hi + 1)]
    gone = dict.fromkeys(map(ord, marks))
    before, after = [], []
    for c in range(0x80, 0x10000):
        if 0xD800 <= c < 0xE000 or c in gone:
            continue
        plain = unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(c)).translate(gone))
        if len(plain) == 1 and plain != chr(c):
            before.append(chr(c))
            after.append(plain)
    return "".join(before + marks), "".join(after)


def strip_accents(text: Column) -> Column:
    """Latin, Greek and Cyrillic letters without their marks; marks of other scripts stay."""
    before, after = _accents()
    return F.translate(filled(text), before, after)


# --------------------------------------------------------------------------- legal forms


def suffixes(country: str | None) -> list[str]:
    """The legal forms of a country in the order in which they are tried."""
    if country == "France":
        chosen = [*V.SUFFIXES_FR, *V.SUFFIXES_EN]
    elif country == "India":
        chosen = [*V.SUFFIXES_HI, *V.SUFFIXES_EN]
    else:
        every = dict.fromkeys((*V.SUFFIXES_EN, *V.SUFFIXES_FR, *V.SUFFIXES_HI))
        chosen = sorted(every, key=lambda s: (-len(s.split()), -len(s), s))
    return list(dict.fromkeys(chosen))


def last_words() -> list[str]:
    return sorted({s.split()[-1] for s in (*V.SUFFIXES_EN, *V.SUFFIXES_FR, *V.SUFFIXES_HI)})


def _table(pairs: dict[str, str]) -> Column:
    """A constant map column."""
    return F.expr("map(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for pair in pairs.items() for x in pair) + ")")


def _forms(country: str | None) -> str:
    """Java pattern: a legal form at the end of blank-joined words; the earliest find is the longest form."""
    return "(?:^| )(" + "|".join(map(re.escape, suffixes(country))) + ")$"


def _stripped(words: Column, country: str | None) -> Column:
    """(n, c) after taking legal forms off the end of words, as often as one fits.

    The first word that is no stop word and what comes before it are never taken.
    """
    longest = max(len(s.split()) for s in suffixes(country))
    canonical = _table(V.SUFFIX_CANONICAL)
    state = lambda n, c, going: F.struct(n.cast("int").alias("n"), c.alias("c"), going.alias("going"))

    def step(p: Column, first: Column, st: Column) -> Column:
        begin = F.greatest(first, st["n"] - longest)
        tail = F.array_join(F.slice(p, begin + 1, F.greatest(st["n"] - begin, F.lit(0))), " ")
        taken = lambda form: st["n"] - 1 - (F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))))
        short = lambda form: F.when(st["c"] == "", F.coalesce(F.try_element_at(canonical, form), F.lit(""))).otherwise(st["c"])
        found = let(F.regexp_extract(tail, _forms(country), 1), lambda form: F.when(form == "", state(st["n"], st["c"], F.lit(False))).otherwise(state(taken(form), short(form), F.lit(True))))
        return F.when(st["going"], found).otherwise(st)

    def strip(p: Column) -> Column:
        first = F.array_position(F.transform(p, lambda t: t.isin(*V.STOP_WORDS)), False).cast("int")
        return let(first, lambda f: F.aggregate(p, state(F.size(p), F.lit(""), f > 0), lambda st, _: step(p, f, st)))

    return let(F.transform(words, lambda t: strip_accents(F.lower(t))), strip)


def suffix_of(words: Column, country: Column) -> Column:
    """(n, c): how many of the words are left without their legal forms, and the short form of the last of them.

    What ends in no legal form's last word is passed over.
    """
    tail = strip_accents(F.lower(F.try_element_at(words, F.lit(-1))))
    ends = F.coalesce(tail.isin(*last_words()), F.lit(False))
    whole = F.struct(F.size(words).alias("n"), F.lit("").alias("c"))
    of = lambda name: let(_stripped(words, name), lambda st: F.struct(st["n"].alias("n"), st["c"].alias("c")))
    return F.when((F.size(words) < 2) | ~ends, whole).when(country == "France", of("France")).when(country == "India", of("India")).otherwise(of(None))


# --------------------------------------------------------------------------- names, addresses, records


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def words_of_normalized(text: Column) -> Column:
    """The same of a text that has no blanks but single ones between words."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def conservative(text: Column) -> Column:
    return _plain(filled(text))


def without_honorific(normalized: Column) -> Column:
    """A name without one leading title."""
    titles = "|".join(V.HONORIFICS)
    return F.trim(F.regexp_replace(normalized, rf"(?i)^({titles})\b[\s.\-/]*", ""))


def normalized_names(df: DataFrame, name: str = "business_name", country: str = "country", strip_suffix: bool = True) -> DataFrame:
    """df with name_raw, name_conservative, name_normalized, name_corporate_suffix and name_tokens."""

    def fields(cons: Column, core: Column, suffix: Column) -> Column:
        named = lambda norm: F.struct(cons.alias("cons"), norm.alias("norm"), suffix.alias("suffix"), words_of(norm).alias("tokens"))
        return let(whitespace(strip_accents(core)), lambda plain: let(F.when(plain != "", plain).otherwise(cons), named))

    def made(cons: Column) -> Column:
        if not strip_suffix:
            return fields(cons, cons, F.lit(""))
        core = lambda w, s: F.array_join(F.slice(w, F.lit(1), s["n"]), " ")
        return let(words_of(cons), lambda w: let(suffix_of(w, F.col(country)), lambda s: fields(cons, core(w, s), s["c"])))

    df = df.withColumn("_n", let(conservative(F.col(name)), made))
    return df.withColumns({
        "name_raw": filled(F.col(name)), "name_conservative": F.col("_n.cons"), "name_normalized": F.col("_n.norm"),
        "name_corporate_suffix": F.col("_n.suffix"), "name_tokens": F.col("_n.tokens"),
    }).drop("_n")


def normalized_addresses(df: DataFrame, address: str = "business_address") -> DataFrame:
    """df with addr_raw, addr_is_empty, addr_conservative, addr_normalized and addr_tokens; a blank address is empty throughout."""
    raw = filled(F.col(address))
    df = df.withColumn("_a", _address(raw))
    return df.withColumns({
        "addr_raw": F.when((F.col("_a.cons") == "") & (whitespace(raw) == ""), "").otherwise(raw), "addr_is_empty": F.col("_a.cons") == "",
        "addr_conservative": F.col("_a.cons"), "addr_normalized": F.col("_a.norm"), "addr_tokens": words_of_normalized(F.col("_a.norm")),
    }).drop("_a")


def for_keys(records: DataFrame) -> DataFrame:
    """The fields of preprocess that blocking keys are made of, and the records' other columns but the raw ones: of an address its normalized form alone."""
    df = normalized_names(records.withColumn("country", filled(F.col("country"))))
    df = df.withColumn("_a", _short_address(filled(F.col("business_address"))))
    df = df.withColumns({"addr_is_empty": F.col("_a.empty"), "addr_normalized": F.col("_a.norm"), "addr_tokens": words_of_normalized(F.col("_a.norm"))})
    return df.drop("_a", "business_name", "business_address", "name_raw")


RECORD = (
    "entity_id", "country", "name_raw", "name_conservative", "name_normalized", "name_corporate_suffix", "name_tokens",
    "addr_raw", "addr_is_empty", "addr_conservative", "addr_normalized", "addr_tokens",
)


def preprocess(records: DataFrame) -> DataFrame:
    """The twelve fields of every record of (entity_id, business_name, business_address, country); other columns pass through."""
    others = [c for c in records.columns if c not in ("entity_id", "business_name", "business_address", "country")]
    df = records.withColumn("country", filled(F.col("country")))
    return normalized_addresses(normalized_names(df)).select(*RECORD, *others)
