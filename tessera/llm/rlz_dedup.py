"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every document is a reference for those with larger ids.  A block of documents indexes all its
windows of ``WINDOW`` = 13 words: sorted 64-bit fingerprints with the smallest id that has each.
The blocks' indexes meet slice by slice of the fingerprint space, where one sorted merge tells
each block which of its windows begin in a smaller document and in which: so every document is
looked up against every block's index, and no pair of documents is formed.

With the smallest reference of each position known, a document is factored greedily: a factor
begins where a window is found and goes on while the following windows are found in the same
reference.  Only factors of at least a window are kept, and at a factor's boundary every window
that straddles it is looked up as well, so that the factors together cover exactly the words of
all windows that begin in a smaller document.  All decisions are on the input texts.

Defined cases: null or empty text has no words; texts of fewer than 13 words lose none; a row
that repeats an id is no smaller document; a null id is larger than all ids, and no smaller than
another null; a window repeated only within its own document stays.  Windows count as equal if
their 64-bit fingerprints are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common as C

WINDOW = 13
#: Ids are compared as unsigned numbers of the same order; a null id is the largest.
_SIGN, _NULL = np.uint64(1 << 63), np.uint64((1 << 64) - 1)


class Index:
    """The windows of a block: distinct fingerprints, the smallest id of each, and where they stand."""

    def __init__(self, table, window: int):
        ids = table.column("doc_id").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        texts = C.utf8(table)
        self.ids = [ids[k] for k in self.order]
        self.texts = [texts[k] for k in self.order]
        hashes, self.lens = C.token_hashes(self.texts)
        rank = np.array([_NULL if i is None else np.uint64(i + (1 << 63)) for i in self.ids], np.uint64)
        owner = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        h = C.gram_hashes(hashes, window)
        self.at = np.flatnonzero(owner[: len(h)] == owner[window - 1 : window - 1 + len(h)])  # windows within one document
        self.owner = owner
        self.keys, first, self.of = np.unique(h[self.at], return_index=True, return_inverse=True)  # documents are in order of id, so the first has the smallest
        self.rank = rank
        self.lowest = rank[owner[self.at[first]]] if len(first) else np.empty(0, np.uint64)


def _offset(table) -> np.uint64:
    ids = [i for i in table.column("doc_id").to_pylist() if i is not None]
    return np.uint64(min(ids) + (1 << 63)) if ids else np.uint64(0)


def references(spark: SparkSession, docs: DataFrame, made, schema: str, window: int = WINDOW, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """made(id, words, factors) rows for every document; factors are (first word, end, reference id) in order."""
    rows, n_blocks = C.in_blocks(docs, block_bytes)
    n_slices = C.slices(n_blocks)

    def send(table):
        import pyarrow as pa

        C.release()
        x, base, block = Index(table, window), _offset(table), table.column("block")[0].as_py()
        edges = C.cuts(x.keys, n_slices)
        out = [(k, C.pack_sorted(x.keys[lo:hi]), C.pack(x.lowest[lo:hi] - base)) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
        part, keys, lowest = zip(*out, strict=True) if out else ((), (), ())
        n = len(out)
        return pa.table({"block": pa.array([block] * n, pa.int32()), "slice": pa.array(part, pa.int32()), "base": pa.array([int(base) - (1 << 63)] * n, pa.int64()), "keys": pa.array(keys, pa.binary()), "lowest": pa.array(lowest, pa.binary())})

    def answer(table):
        import pyarrow as pa

        C.release()
        keys, at, lens = C.merge_keys(table.column("keys").to_pylist())
        base = table.column("base").to_pylist()
        own = np.concatenate([C.unpack(x) + np.uint64(b + (1 << 63)) for x, b in zip(table.column("lowest").to_pylist(), base, strict=True)])
        least = np.full(len(keys), _NULL)
        np.minimum.at(least, at, own)
        found = least[at] < own
        marks, refs = [], []
        for f, low in zip(np.split(found, np.cumsum(lens)[:-1]), np.split(least[at], np.cumsum(lens)[:-1]), strict=True):
            marks.append(np.packbits(f).tobytes())
            refs.append(C.pack(low[f] - _SIGN))
        return pa.table({"block": table.column("block"), "slice": table.column("slice"), "marks": pa.array(marks, pa.binary()), "refs": pa.array(refs, pa.binary())})

    sent = rows.groupBy("block").applyInArrow(send, "block int, slice int, base long, keys binary, lowest binary")
    told = sent.groupBy("slice").applyInArrow(answer, "block int, slice int, marks binary, refs binary")

    def factor(table, reply):
        import pyarrow as pa

        C.release()
        arrow = _arrow(schema)
        if not table.num_rows:
            return arrow.empty_table()
        x = Index(table, window)
        least = x.lowest.copy()  # the smallest id of each fingerprint anywhere
        edges = C.cuts(x.keys, n_slices)
        for part, marks, refs in zip(reply.column("slice").to_pylist(), reply.column("marks").to_pylist(), reply.column("refs").to_pylist(), strict=True):
            lo, hi = edges[part], edges[part + 1]
            f = np.unpackbits(np.frombuffer(marks, np.uint8), count=hi - lo).astype(bool)
            least[lo:hi][f] = C.unpack(refs) + _SIGN
        ref = np.full(len(x.owner), _NULL)
        ref[x.at] = least[x.of]
        found = np.zeros(len(x.owner), bool)
        found[x.at] = ref[x.at] < x.rank[x.owner[x.at]]
        # Factors: runs of windows found in one reference; the run's last window ends them.
        first = found.copy()
        first[1:] &= ~(found[:-1] & (ref[1:] == ref[:-1]) & (x.owner[1:] == x.owner[:-1]))
        begin = np.flatnonzero(first)
        last = found.copy()
        last[:-1] &= ~found[1:] | first[1:]
        end = np.flatnonzero(last) + window
        base = np.concatenate([[0], np.cumsum(x.lens)])
        cut = np.searchsorted(begin, base)
        out = []
        for k, (i, text) in enumerate(zip(x.ids, x.texts, strict=True)):
            lo, hi = cut[k], cut[k + 1]
            spans = [(int(a - base[k]), int(b - base[k]), int(r) - (1 << 63)) for a, b, r in zip(begin[lo:hi], end[lo:hi], ref[begin[lo:hi]], strict=True)] if hi > lo else []
            out.append(made(i, text.split(), spans))
        return pa.Table.from_pylist(out, schema=arrow)

    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(factor, schema)


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def kept(words: list[bytes], factors: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no factor covers."""
    out, at = [], 0
    for lo, hi, _ in factors:
        if lo > at:
            out += words[at:lo]
        at = max(at, hi)
    return out + words[at:] if factors else words


def dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, factors): the kept words joined by blanks, and the factors as first:end:reference, comma-joined."""

    def made(i, words, factors):
        return {"doc_id": i, "text": b" ".join(kept(words, factors)).decode("utf-8", "replace"), "factors": ",".join(f"{a}:{b}:{r}" for a, b, r in factors)}

    return references(spark, docs, made, "doc_id long, text string, factors string", window)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def made(i, words, factors):
        left = kept(words, factors)
        return {"doc_id": i, "n_words": len(words), "n_removed": len(words) - len(left), "kept_sha256": hashlib.sha256(b" ".join(left)).hexdigest(), "n_factors": len(factors)}

    return references(spark, docs, made, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long")


#: The same in SQL: windows as joined words, the smallest document of each, and the words that no found window covers.
SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS words FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
f AS MATERIALIZED (SELECT doc_id, i, ref FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS ref FROM g) WHERE ref < doc_id),
n AS (SELECT doc_id, count(*) FILTER (WHERE before IS NULL OR before <> i - 1 OR ref_before <> ref) AS n_factors FROM (SELECT doc_id, i, ref, lag(i) OVER o AS before, lag(ref) OVER o AS ref_before FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM f),
k AS (SELECT u.doc_id, count(*) AS n_kept, string_agg(u.word, ' ' ORDER BY u.p) AS kept FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) u ANTI JOIN c ON c.doc_id = u.doc_id AND c.p = u.p GROUP BY u.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256, coalesce(n.n_factors, 0)::BIGINT AS n_factors FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
