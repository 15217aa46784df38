"""Shared pieces: tokens, the shared folder, document blocks, packed key exchange, components.

Rows that the operators read
----------------------------
Only the named columns are read; any other column is ignored, whatever its name.
A null text counts as the empty text.  Rows that repeat stay separate rows.

Packed key exchange
-------------------
Several operators need one fact per distinct key (a word, a byte context, a word
window) over the whole corpus, and need it back where the documents are.  A row
per occurrence would shuffle more than the corpus itself.  Here a *block* (some
megabytes of documents, chosen by a hash of the row) sends, for each slice of the
64-bit key space, one row with its sorted distinct keys packed into bytes; the
task of a slice combines the blocks' keys with numpy and answers with values
aligned to the keys it was sent.  A key that a third of all rows hold costs one
entry a block, so no key is hot, and every group is bounded: a block by
``BLOCK_BYTES``, a slice by the number of slices, which grows with the input.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and separator patterns: words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: Text bytes a block holds on average.
BLOCK_BYTES = 4 << 20


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --------------------------------------------------------------------------- shared folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; sets that only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive executors.

    The shuffle files of the write are dropped at its end, since nothing reads them again.
    """
    path, schema, before = shared_folder(spark), df.schema, spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


# --------------------------------------------------------------------------- memory of Python tasks

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send documents to Python in batches of so many rows, unless the session says otherwise than the default."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(rows))


def release() -> None:
    """Give memory that the last block needed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# --------------------------------------------------------------------------- document blocks


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, block) and the number of blocks; a block is a hash class of rows.

    Id and text are hashed together so that repeated or null ids do not meet in one block
    unless their texts are equal too.  One very long text makes its block longer by itself.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def slices(n_blocks: int) -> int:
    """Slices of the key space: a power of two, so that a slice holds the keys of some four blocks."""
    return 1 << max(0, (n_blocks - 1).bit_length() - 2)


def utf8(table, name: str = "text") -> list[bytes]:
    """A string column as bytes, without decoding."""
    import pyarrow as pa

    return [x or b"" for x in table.column(name).cast(pa.binary()).to_pylist()]


#: Bytes hashed at a time, and the longest token that is hashed so; longer ones are hashed one by one.
_SEGMENT, _LONG = 1 << 18, 256
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = _SEGMENT + _LONG + 1
    of_byte = np.fromiter((xxhash.xxh3_64_intdigest(bytes([c])) for c in range(256)), np.uint64, 256)
    return of_byte, _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of all texts in order, and the number of words of each text.

    A word's hash is a difference of two prefix sums of byte values times powers of an odd number,
    brought to the same power and mixed: no word becomes an object.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(raw) and not blank[0]:
        edge = np.concatenate([[0], edge])
    lo, hi = edge[0::2], edge[1::2]  # the last byte is a blank, so every word ends
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    lens = np.diff(np.searchsorted(lo, np.concatenate([[0], np.cumsum(sizes)])))
    of_byte, up, down = _tables()
    out = np.empty(len(lo), np.uint64)
    for start in range(0, len(raw), _SEGMENT):
        i, j = np.searchsorted(lo, (start, start + _SEGMENT))
        if i == j:
            continue
        part = of_byte[raw[start : start + _SEGMENT + _LONG]]
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        a = lo[i:j] - start
        b = np.minimum(hi[i:j] - start, len(part))
        out[i:j] = (sums[b] - sums[a]) * down[a]
    out += (hi - lo).astype(np.uint64)
    out = mix64(out)
    for k in np.flatnonzero(hi - lo > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(raw[lo[k] : hi[k]].tobytes())
    return out, lens


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of size word hashes: a polynomial modulo 2**64, then mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    for k in range(size):
        out = out * m + hashes[k : k + n]
    return mix64(out)


# --------------------------------------------------------------------------- packed keys


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, so that planes that are mostly zero compress away in the shuffle."""
    v = np.ascontiguousarray(values, "<u8")
    return v.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as the planes of their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def cuts(keys: np.ndarray, n_slices: int) -> np.ndarray:
    """Where each slice of the key space begins and ends among ascending 64-bit keys."""
    if n_slices == 1:
        return np.array([0, len(keys)])
    edges = np.arange(1, n_slices, dtype=np.uint64) << np.uint64(64 - (n_slices.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def merge_keys(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of several packed lists, the index of each entry's key, the lists' lengths."""
    lists = [unpack_sorted(x) for x in packed]
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    keys, at = np.unique(np.concatenate(lists) if lists else np.empty(0, np.uint64), return_inverse=True)
    return keys, at, lens


# --------------------------------------------------------------------------- components


#: Nodes with more links than this, and than one in so many of all, are hubs.
HUB_LINKS, HUBS = 1000, 1000


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for the links (a, b): the smallest node that links reach.

    Alternating large-star and small-star steps: every node's neighbours are linked to the
    smallest node near it, until nothing changes.  A step is one grouped minimum (combined
    before its shuffle) and one join; each step's links are written to the shared folder.  Nodes
    with more than one in ``HUBS`` of all links, fewer than ``HUBS`` by construction, are joined by
    broadcast, so that no task gets all links of a hub.  No links give no rows.
    """
    links = save(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        low = save(spark, both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n"))
        rows, most = low.agg(F.sum("n"), F.max("n")).first()
        limit = max(HUB_LINKS, rows // HUBS)
        if most > limit:
            hubs = F.broadcast(low.where(F.col("n") > limit))  # fewer than HUBS rows
            moved = both.join(hubs, "a").unionByName(both.join(hubs, "a", "left_anti").join(low.where(F.col("n") <= limit), "a"))
        else:
            moved = both.join(low, "a")
        if large:  # larger neighbours go to the smallest node near
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # smaller neighbours, and the node itself, go to the smallest of them
        return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(links)
    while True:
        step = save(spark, star(links, True).where("a <> b").distinct())
        links = save(spark, star(step, False).where("a <> b").distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
