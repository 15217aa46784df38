"""Benchmark decontamination with SimHash windows, with DataFrame functions only.

1.  Windows.  A window of a document that is similar to an item shares a five-word shingle with
    it.  The documents' shingles are joined with the items' (hash against hash), and each hit lays
    the item over the document: the window is what it covers.  A place without a hit cannot be
    similar, so no window there is ever hashed.
2.  SimHash.  Window and item get a 64-bit fingerprint of their words, weighted by how often
    each occurs: bit b is set if the words with bit b set in their hash outweigh the others.
3.  Multi-index Hamming blocks.  The 64 bits are cut into ``RADIUS`` + 1 = 22 blocks.  Two
    fingerprints within the radius agree in a block at least, so a join on (item, block, bits)
    finds every one of them; the distance itself then decides.
4.  Candidates are verified exactly: the weighted Jaccard similarity of five-word shingles, sum
    of least over sum of largest counts, must be at least 0.8.

Windows are the item's size; one that reaches over a text's edge is cut off there, so a text that
ends within a copy is judged by what it has.  An item of fewer than five words is one shingle of
all its words and matches texts that have these words only.

Defined cases: null or empty texts and items match nothing; a repeated document or item gives
the same row once, an item id with several texts its best; a document with several similar
windows of an item gives one row, its best (ties: the first); no items or documents give no
rows.  Words are compared with A-Z lower-cased.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
SIMILARITY = 0.8
#: Similar windows of nine words differ in 8 bits on average, with a deviation of 3; unrelated ones in 32, of 4.
RADIUS = 21
BITS = 64
#: Shingles of the items up to which the items' side is broadcast; above, both sides are shuffled.
BROADCAST_SHINGLES = 1_000_000
#: Keys of anchored documents (8 bytes each) up to which they are broadcast.
BROADCAST_DOCS = 1_000_000


def words_of(text: str = "text") -> str:
    """SQL: the words of a column, A-Z lower-cased."""
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    trimmed = f"trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM {lower})"
    return f"CASE WHEN {trimmed} = '' THEN cast(array() AS array<string>) ELSE split({trimmed}, '[ \\\\x09-\\\\x0D]+') END"


def shingles_of(words: str) -> str:
    """SQL: hashes of the shingles of an array of words, in order; fewer words are one shingle."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE))
    return f"""CASE WHEN size({words}) >= {SHINGLE} THEN transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({parts}))
        WHEN size({words}) > 0 THEN array(xxhash64(concat_ws(' ', {words}), size({words}))) ELSE cast(array() AS array<bigint>) END"""


def simhash_of(hashes: str) -> str:
    """SQL: the SimHash of an array of word hashes, each as often as it occurs.

    Two bits are counted at once, in the halves of a long.
    """
    terms = []
    for b in range(0, BITS, 2):
        pair = f"aggregate({hashes}, 0L, (a, h) -> a + (shiftrightunsigned(h, {b}) & 1L) + shiftleft(shiftrightunsigned(h, {b + 1}) & 1L, 32))"
        # from two counts to two bits: a count counts if it is more than half
        terms.append(f"transform(array({pair}), c -> shiftleft(CASE WHEN 2 * (c & 4294967295L) > size({hashes}) THEN 1L ELSE 0L END | CASE WHEN 2 * shiftrightunsigned(c, 32) > size({hashes}) THEN 2L ELSE 0L END, {b}))[0]")
    return " | ".join(terms)


def _blocks(fingerprint: str) -> str:
    """SQL: (block, bits) of a fingerprint: RADIUS + 1 blocks of nearly equal width."""
    edges = [k * BITS // (RADIUS + 1) for k in range(RADIUS + 2)]
    parts = [f"named_struct('block', {k}, 'bits', cast(shiftrightunsigned({fingerprint}, {lo}) & {(1 << hi - lo) - 1}L AS int))" for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    return f"array({', '.join(parts)})"


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, n_words, fingerprint, shingles); item numbers the distinct (item_id, words)."""
    words = benchmark.select("item_id", F.expr(words_of()).alias("_w")).where("size(_w) > 0").distinct()
    hashed = words.select("item_id", F.xxhash64("item_id", "_w").alias("item"), F.size("_w").alias("n_words"), F.expr("transform(_w, w -> xxhash64(w))").alias("_h"), F.expr(shingles_of("_w")).alias("shingles"))
    return hashed.select("item_id", "item", "n_words", F.expr(simhash_of("_h")).alias("fingerprint"), "shingles")


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): each item that a document holds, and the first word of its best window."""
    items = C.save(spark, _items(benchmark))
    at_item = items.select("item", "n_words", F.posexplode("shingles").alias("j", "shingle"))
    small = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    side = F.broadcast if small <= BROADCAST_SHINGLES else (lambda df: df)

    rows = docs.select("doc_id", F.col("text").alias("_text"), F.xxhash64("doc_id", "text").alias("key"))
    at_doc = rows.select("key", F.expr(words_of("_text")).alias("_w")).select("key", F.posexplode(F.expr(shingles_of("_w"))).alias("i", "shingle"))
    anchors = at_doc.join(side(at_item), "shingle").select("key", "item", "n_words", (F.col("i") - F.col("j")).alias("start")).distinct()
    anchors = C.save(spark, anchors)

    # The windows of the anchored documents.
    wanted = anchors.select("key").distinct()
    some = wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    held = rows.join(F.broadcast(wanted) if some else wanted, "key", "left_semi").dropDuplicates(["key"])
    whole = held.select("key", "doc_id", F.expr(words_of("_text")).alias("_w"))
    lo = "greatest(start, 0)"
    windows = anchors.join(whole, "key").select("key", "doc_id", "item", "start", F.expr(f"slice(_w, {lo} + 1, greatest(least(start + n_words, size(_w)) - {lo}, 0))").alias("_w")).where("size(_w) > 0")
    windows = windows.select("key", "doc_id", "item", "start", F.expr("transform(_w, w -> xxhash64(w))").alias("_h"), F.expr(shingles_of("_w")).alias("shingles"))
    windows = C.save(spark, windows.select("key", "doc_id", "item", "start", F.expr(simhash_of("_h")).alias("fingerprint"), "shingles").distinct())

    # Multi-index: one block at least agrees within the radius.
    cut = windows.select("key", "item", "start", "fingerprint", F.explode(F.expr(_blocks("fingerprint"))).alias("b")).select("key", "item", "start", "fingerprint", "b.block", "b.bits")
    index = items.select("item", F.col("fingerprint").alias("item_fingerprint"), F.explode(F.expr(_blocks("fingerprint"))).alias("b")).select("item", "item_fingerprint", "b.block", "b.bits")
    near = cut.join(side(index), ["item", "block", "bits"]).where(f"bit_count(fingerprint ^ item_fingerprint) <= {RADIUS}").select("key", "item", "start").distinct()

    # Exact similarity of what is near.
    found = windows.join(near, ["key", "item", "start"]).select("key", "doc_id", "item", "start", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    counted = found.groupBy("key", "doc_id", "item", "start", "n", "shingle").agg(F.count("*").alias("a"))
    own = at_item.groupBy("item", "shingle").agg(F.count("*").alias("b")).join(items.select("item", F.size("shingles").alias("m")), "item")
    shared = counted.join(side(own), ["item", "shingle"]).groupBy("key", "doc_id", "item", "start", "n", "m").agg(F.sum(F.least("a", "b")).alias("both"))
    similar = shared.withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    named = similar.join(side(items.select("item", "item_id")), "item")
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best"))
    return best.select("doc_id", "item_id", F.greatest(-F.col("best.at"), F.lit(0)).cast("long").alias("start"), F.col("best.similarity").alias("similarity"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold an item."""
    found = leaks(spark, docs, benchmark).select("doc_id").distinct()
    return docs.join(C.save(spark, found), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(spark, docs, benchmark)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
bs AS (SELECT item_id, len(w) AS n_words, j, list_slice(w, j, j + 4) AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
a AS (SELECT DISTINCT doc_id, item_id, n_words, i - j AS raw FROM ds JOIN bs USING (s)),
x AS (SELECT DISTINCT doc_id, item_id, greatest(raw, 0) AS start, raw + n_words AS stop FROM a),
c AS (SELECT x.doc_id, x.item_id, x.start, x.stop, ds.s, count(*) AS a FROM x JOIN ds ON ds.doc_id = x.doc_id AND ds.i > x.start AND ds.i + 4 <= x.stop GROUP BY ALL),
n AS (SELECT doc_id, item_id, start, stop, sum(a) AS n FROM c GROUP BY ALL),
k AS (SELECT item_id, s, count(*) AS b, sum(count(*)) OVER (PARTITION BY item_id) AS m FROM bs GROUP BY item_id, s),
v AS (SELECT c.doc_id, c.item_id, c.start, n.n, k.m, sum(least(c.a, k.b)) AS both_ FROM c JOIN k ON k.item_id = c.item_id AND k.s = c.s JOIN n ON n.doc_id = c.doc_id AND n.item_id = c.item_id AND n.start = c.start AND n.stop = c.stop GROUP BY c.doc_id, c.item_id, c.start, c.stop, n.n, k.m),
r AS (SELECT *, both_::DOUBLE / (n + m - both_)::DOUBLE AS similarity FROM v)
SELECT doc_id, item_id, start::BIGINT AS start, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM r WHERE similarity >= 0.8) WHERE k = 1
"""
