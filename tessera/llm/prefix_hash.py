"""Document fingerprints from prefix polynomial hashes.

For code points s[0..n) the prefix array is P[i] = sum of (s[j] + 1) * B**j for j < i, modulo
a prime.  (P[j] - P[i]) * B**-i is the hash of the span [i, j) wherever it stands, so that any
two spans are compared in constant time and the longest common extension of two positions is
found by binary search.  Two primes below 2**31 with random bases give 62 bits.

A fingerprint is ``length-hash-sketch``: the number of code points, the hash of the whole text,
and the ``SKETCH`` smallest of the distinct hashes of its ``SPAN``-character spans (all of them
read from the prefix array).  Likeness is the Jaccard similarity that two sketches estimate
(exact where the texts have fewer spans than the sketch holds), and 1 for equal texts.

Edited texts take the end from the next document in descending order of id.  Documents are
range-partitioned by id and sorted once; tasks stream over them, and only the first document of
each range is sent, whole, to the range before it.

Defined cases: null is the empty text; rows that repeat an id are ordered by text, descending;
a null id comes last; texts shorter than a span are one span; two empty texts have likeness 1,
an empty and another text 0; the only document is its own next; no documents give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SPAN = 24
SKETCH = 64
P = np.uint64((1 << 31) - 1)
#: Bases of the two hashes, primitive enough and fixed: equal texts must have equal fingerprints in every run.
BASES = (1_103_515_245, 1_566_083_941)
RANGE_BYTES = 16 << 20
#: Ranges at most: their heads are broadcast.
MAX_RANGES = 10_000


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


class Powers:
    """B**i and B**-i modulo P, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(P))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> Powers:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, k, int(P))))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(pow(self.inverse, k, int(P))))])
        return self


_POWERS = [Powers(b) for b in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Span hashes of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.points = points
        s = points.astype(np.uint64) + np.uint64(1)
        self.pre = []
        for p in _POWERS:
            p.upto(self.n + 1)
            # each term is below 2**31, so 2**32 of them fit
            self.pre.append(np.concatenate([np.zeros(1, np.uint64), _mod(np.cumsum(_mod(s * p.up[: self.n])))]))

    def spans(self, i: np.ndarray | slice, j: np.ndarray | slice, which: int) -> np.ndarray:
        pre, p = self.pre[which], _POWERS[which]
        return _mod(_mod(pre[j] + P - pre[i]) * p.down[i])

    def span(self, i: int, j: int) -> int:
        """The hash of [i, j): 62 bits."""
        out = 0
        for pre, p in zip(self.pre, _POWERS, strict=True):
            out = out << 31 | (int(pre[j]) - int(pre[i])) * int(p.down[i]) % int(P)
        return out

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """The longest common extension of position i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.equal(i, other, j, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def sketch(self, span: int = SPAN, size: int = SKETCH) -> np.ndarray:
        """The smallest distinct span hashes, ascending."""
        if not self.n:
            return np.empty(0, np.uint64)
        w = min(span, self.n)
        h = self.spans(slice(0, self.n - w + 1), slice(w, self.n + 1), 0)
        h = _mod(h * np.uint64(1_812_433_253 % int(P)) + np.uint64(12_345))  # another order than that of the spans' last letters
        most = 8 * size
        while len(h) > most:  # repeated spans: widen until enough distinct ones are among the smallest
            low = np.unique(np.partition(h, most)[:most])
            if len(low) >= size:
                return low[:size]
            most *= 4
        return np.unique(h)[:size]

    def fingerprint(self) -> tuple[str, np.ndarray]:
        s = self.sketch()
        return f"{self.n:x}-{self.span(0, self.n):016x}-" + "".join(f"{x:08x}" for x in s.tolist()), s


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    s, t = (np.array([int(x[i : i + 8], 16) for i in range(0, len(x), 8)], np.uint64) for x in (a.split("-")[2], b.split("-")[2]))
    return sketch_likeness(s, t)


def sketch_likeness(s: np.ndarray, t: np.ndarray, size: int = SKETCH) -> float:
    if not len(s) or not len(t):
        return 0.0
    both = np.union1d(s, t)
    if len(s) == size or len(t) == size:
        both = both[: max(min(len(s), len(t)), min(size, len(both)))]
        both = both[:size]
    shared = np.intersect1d(s, t, assume_unique=True)
    return float(np.isin(both, shared, assume_unique=True).sum() / len(both))


def ordered(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, part), each part a range of ids in descending order, and the number of parts; a null id is in the last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    n = min(MAX_RANGES, max(1, -(-int(total or 0) // range_bytes)))
    # Quantiles of the ids: edges that stay the same in every attempt of a task.
    edges = sorted(set(rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100_000)).first()[0] or [])) if n > 1 else []
    return rows.withColumn("part", F.coalesce(_search(edges), F.lit(len(edges))).cast("int")), n


def _search(edges: list[int]) -> F.Column:
    """How many edges are at least doc_id, by binary search: part 0 has the largest ids.

    The steps are an array that is folded over: an expression that names its own last step several
    times grows fourfold with each of them, which for hundreds of edges no driver holds.
    """
    if not edges:
        return F.lit(0)
    numbers = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731  a constant, made in one call
    array = numbers(edges, "bigint")
    steps = numbers([1 << k for k in reversed(range(len(edges).bit_length()))], "int")
    # at: edges known to be below doc_id; there is no edge beyond the last
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    return F.lit(len(edges)) - below


def pairs(docs: DataFrame, fn, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """fn(doc_id, text, next_text) for every document and the one that follows it in descending order of id.

    The text is shuffled once.  Tasks stream over sorted rows and hold two texts at a time, so a
    range may be of any size.
    """
    C.small_batches(docs.sparkSession)
    rows, n = ordered(docs, range_bytes)
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    top = rows.groupBy(F.col("part").alias("_p")).agg(F.max(order).alias("_o"))  # a row for each of at most MAX_RANGES ranges: broadcast
    heads = rows.join(F.broadcast(top), (F.col("part") == F.col("_p")) & (order == F.col("_o"))).groupBy("part").agg(F.max("text").alias("text"))
    ring = Window.orderBy("part")
    # Each range's head closes the range before; that of the first closes the last.
    prior = F.coalesce(F.lag("part").over(ring), F.max("part").over(Window.partitionBy()))
    ghosts = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", prior.alias("part"), F.lit(False).alias("own"))
    every = rows.select("doc_id", "text", "part", F.lit(True).alias("own")).unionByName(ghosts)
    stream = every.repartition(n, "part").sortWithinPartitions("part", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("text"))

    def run(batches):
        import pyarrow as pa

        arrow, done, before = _arrow(schema), [], None
        for batch in batches:
            C.release()
            for i, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                if before is not None:
                    done.append(fn(*before, text))
                    if len(done) == 256:
                        yield pa.RecordBatch.from_pylist(done, schema=arrow)
                        done = []
                before = (i, text) if own else None
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return stream.mapInArrow(run, schema)


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def edited(points: np.ndarray, after: np.ndarray) -> np.ndarray:
    m = len(points) // 2
    return np.concatenate([points[: len(points) - m], after[:m]])


def _compare(doc_id, text: str, after: str) -> dict:
    points, nxt = code_points(text), code_points(after)
    changed = edited(points, nxt)
    own, new, other = PrefixHash(points), PrefixHash(changed), PrefixHash(nxt)
    fp, s = own.fingerprint()
    fp_new, s_new = new.fingerprint()
    fp_next = f"{other.n:x}-{other.span(0, other.n):016x}"
    return {
        "doc_id": doc_id, "n_chars": own.n, "edited_sha256": hashlib.sha256(changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": fp, "edited_fingerprint": fp_new, "near_edited": 1.0 if fp == fp_new else sketch_likeness(s, s_new),
        "near_next": 1.0 if fp.startswith(fp_next + "-") else sketch_likeness(s, other.sketch()),
        "common_edited": own.common(0, new, 0), "common_next": own.common(0, other, 0),
    }


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = [PrefixHash(code_points(t)).fingerprint()[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pairs(docs, _compare, FIELDS)
