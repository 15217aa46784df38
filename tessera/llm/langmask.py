"""Language ID with language-bitmask n-gram filters.

Training finds, for each byte n-gram, the languages whose sampled documents hold it often
enough.  A bit-sliced Bloom filter keeps them: every slot is a row of bits, one for each
language, and an n-gram sets its languages' bits in ``HASHES`` slots.  A probe takes the AND
of those slots and so learns all languages of an n-gram at once.

A text is judged by one popcount per language over all its n-grams, whole texts, never
prefixes.  A language whose filter is filled to a share f answers yes to an unknown n-gram with
probability f ** HASHES; the count is corrected to (count - n * fp) / (1 - fp).  The largest
corrected count wins, ties by name; the score is its share of the n-grams, between 0 and 1.

Bounds: ``TRAIN_DOCS`` labelled documents a language, chosen by a hash of the id; a filter of
``SLOTS`` rows whatever the corpus, and so a bounded broadcast.

Defined cases: text without a letter, empty or null is ``und`` with score 0; without labelled
rows all texts are ``und``; a text of one letter is judged by its n-grams with the blanks at
its ends; null lang is never learned; repeated rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

TRAIN_DOCS = 400
GRAM = 4
SLOTS = 1 << 21
HASHES = 3
#: An n-gram belongs to a language if so large a part of the language's documents that hold any n-gram holds it, and no less than a part of what the language that has it most shows.
MIN_SHARE, MIN_RATIO = 0.01, 0.2
UNDECIDED = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII but a-z becomes blank; bytes of other characters stay.
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def gram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as one array of 32-bit codes, and how many each text has.

    Lower-cased UTF-8 with every run of other ASCII as one blank, and a blank at each end.
    """
    blobs = [b" " + (x or "").lower().encode("utf-8", "replace").translate(_PLAIN) + b"   " for x in texts]
    raw = np.frombuffer(b"".join(blobs), np.uint8)
    owner = np.repeat(np.arange(len(blobs)), np.fromiter(map(len, blobs), np.int64, len(blobs)))
    blank = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (owner[1:] != owner[:-1])
    # one letter and its blanks are a byte short of an n-gram: the last blank stays
    short = np.bincount(owner[keep], minlength=len(blobs)) == GRAM - 1
    keep[np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)))[short] - 1] = True
    b, owner = raw[keep].astype(np.uint32), owner[keep]
    if len(b) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    n = len(b) - GRAM + 1
    codes = np.zeros(n, np.uint32)
    for k in range(GRAM):
        codes = (codes << np.uint32(8)) | b[k : k + n]
    inside = owner[:n] == owner[GRAM - 1 :]
    return codes[inside], np.bincount(owner[:n][inside], minlength=len(texts))


def slots_of(codes: np.ndarray, k: int, m: int = SLOTS) -> np.ndarray:
    mult = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)[k]
    h = codes * np.uint32(mult)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D) >> np.uint32(32 - (m.bit_length() - 1))).astype(np.int64)


class Filters:
    """The bit-sliced filters: rows of bits in words of 8 languages."""

    def __init__(self, langs: list[str], slots: int = SLOTS, hashes: int = HASHES):
        self.langs, self.slots, self.hashes = langs, slots, hashes
        self.bits = np.zeros((max(1, -(-len(langs) // 8)), slots), np.uint8)
        self.fp = np.zeros(len(langs))

    def add(self, lang: int, codes: np.ndarray) -> None:
        for k in range(self.hashes):
            self.bits[lang // 8, slots_of(codes, k, self.slots)] |= np.uint8(1 << lang % 8)

    def finish(self) -> Filters:
        for i in range(len(self.langs)):
            self.fp[i] = float((self.bits[i // 8] >> np.uint8(i % 8) & 1).mean()) ** self.hashes
        return self

    def masks(self, codes: np.ndarray, word: int) -> np.ndarray:
        """For each n-gram the bits of languages 8 * word to 8 * word + 7."""
        out = self.bits[word][slots_of(codes, 0, self.slots)]
        for k in range(1, self.hashes):
            out &= self.bits[word][slots_of(codes, k, self.slots)]
        return out

    def counts(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Corrected counts, a row for each text and a column for each language."""
        out = np.zeros((len(lens), len(self.langs)))
        owner = np.repeat(np.arange(len(lens)), lens)
        for w in range(len(self.bits)):
            here = np.bincount(owner * 256 + self.masks(codes, w), minlength=256 * len(lens)).reshape(-1, 256)
            for i in range(8 * w, min(8 * w + 8, len(self.langs))):
                out[:, i] = here[:, (np.arange(256) >> i % 8 & 1) == 1].sum(1)
        return np.clip((out - lens[:, None] * self.fp) / np.maximum(1 - self.fp, 1e-9), 0, None)


def _first_by_hash(spark: SparkSession, labelled: DataFrame, most: int) -> DataFrame:
    """(lang, doc_id): of each language the most ids that come first by hash, ties by id, or all of them.

    A language's hashes are cut off where some four times as many ids are expected, so that no task
    ranks a whole language; where repeated ids leave too few below the cut, it is raised.
    """
    sizes = labelled.groupBy("lang").count().collect()  # a row a language
    cut = {r[0]: 4.0 * most / r[1] for r in sizes}
    number = (F.shiftright(F.xxhash64("doc_id"), 11) + F.lit(1 << 52)) / float(1 << 53)  # in [0, 1], in order of the hash
    rows = labelled.select("lang", "doc_id", number.alias("_at"), F.xxhash64("doc_id").alias("_h"))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    while True:
        cuts = spark.createDataFrame(list(cut.items()), "lang string, cut double")
        below = rows.join(F.broadcast(cuts), "lang").where(F.col("_at") <= F.col("cut")).select("lang", "doc_id", "_h").distinct()
        chosen = C.save(spark, below.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("lang", "doc_id"))
        got = {r[0]: r[1] for r in chosen.groupBy("lang").count().collect()}
        few = [x for x, c in cut.items() if c < 1 and got.get(x, 0) < most]
        if not few:
            return chosen
        cut |= {x: 8 * cut[x] for x in few}


def train(spark: SparkSession, docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Filters:
    """Filters from at most train_docs documents of each language, those first by hash."""
    C.small_batches(spark)
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    sample = labelled.join(F.broadcast(_first_by_hash(spark, labelled, train_docs)), ["doc_id", "lang"])  # at most train_docs rows a language are broadcast

    def grams(batches):
        import pyarrow as pa

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            codes, lens = gram_codes(batch.column("text").to_pylist())
            ends = np.cumsum(lens)
            own = [np.unique(codes[e - n : e]) for e, n in zip(ends, lens, strict=True)]
            for lang in sorted(set(langs)):
                of = [c for c, x in zip(own, langs, strict=True) if x == lang]
                c, n = np.unique(np.concatenate(of), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    held = sample.select("lang", "text").mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    f = Filters(langs)
    if not langs:
        return f.finish()
    frequent = held.join(F.broadcast(spark.createDataFrame(list(sizes.items()), "lang string, docs long")), "lang").withColumn("share", F.col("n") / F.col("docs")).where(F.col("share") >= MIN_SHARE)
    top = frequent.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("of"))
    kept = top.select("gram", F.explode("of").alias("x"), "top").where(F.col("x.share") >= MIN_RATIO * F.col("top")).select("gram", F.col("x.lang").alias("lang"))
    by = kept.toPandas()  # bounded by the sample: an n-gram has to be in MIN_SHARE of at most train_docs texts
    for i, lang in enumerate(langs):
        f.add(i, by.loc[by["lang"] == lang, "gram"].to_numpy(np.uint32))
    return f.finish()


def predict(spark: SparkSession, docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, and the columns named in keep."""
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(filters)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").alias("_text"), *[F.col(c).alias(f"_kept_{c}") for c in keep])
    columns = [c for c in rows.columns if c != "_text"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double"

    def judge(batches):
        import pyarrow as pa

        f = shared.value
        for whole in batches:
            C.release()
            for batch in _parts(whole):
                texts = batch.column("_text").to_pylist()
                codes, lens = gram_codes(texts)
                counts = f.counts(codes, lens)
                letters = np.array([bool(x and _LETTER.search(x)) for x in texts], bool) & (len(f.langs) > 0)
                best = counts.argmax(1) if f.langs else np.zeros(len(texts), int)
                score = np.where(letters & (lens > 0), counts.max(1, initial=0) / np.maximum(lens, 1), 0.0).clip(0, 1)
                pred = [f.langs[b] if ok else UNDECIDED for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(pred, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    out = rows.mapInArrow(judge, schema)
    return out.select("doc_id", "held_out", "lang_pred", "score", *[F.col(f"_kept_{c}").alias(c) for c in keep])


def _parts(batch, most: int = 4 << 20):
    """The batch in pieces of at most so many text bytes (or one row)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return predict(spark, docs, train(spark, docs))
