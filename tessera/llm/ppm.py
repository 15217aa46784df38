"""LM scoring by prediction by partial matching over bytes.

The model is the trie of all byte contexts of up to ``ORDER`` = 5 bytes in the training texts,
with the counts of the bytes that follow.  A byte is coded in its longest known context with
escape method C (a context with T counts over u symbols escapes with u / (T + u)); after an
escape the symbols of the longer context are excluded from the shorter ones.  As every context's
symbols also follow its suffixes, excluded sets are nested, so each six-byte string has one
fixed code length, from sums over its contexts.  Texts begin after five start marks (0xFE) and
end with an end mark (0xFF), neither of which occurs in UTF-8: the score is the log10
probability of the whole text, its end included, and ``score_per_byte`` that over the bytes and the
end, which sets texts apart whatever their length.

Every training text is counted whole, and nothing is sampled or capped.  Word and string counts
go through the packed key exchange: a block of documents sends its distinct keys and counts and
gets back each word's count and each string's code length.  Strings are dealt out by the three
bytes before the last, so the counts of orders 5 to 3 are sums within a slice, and a group has
the strings of one order-3 context.  Orders 2 to 0 are one sorted table of the three-byte strings
seen, at most 2**24 of 12 bytes (some tens of thousands in four languages): the only part of the
model that is on the driver and broadcast.

Held-out documents, by crc32 of the id's text modulo 5, are scored but not learned from
(a null id counts as text ``null``).  Null text is the empty text: one end token.  Repeated rows
count and are scored each.  Without training texts all counts are 0, and a string costs
log10(1/256) a symbol.  ``adaptive`` scores a text by a model that learns only from the text
itself, as it goes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER = 5
START, END = b"\xfe" * ORDER, b"\xff"
#: The strings of a block are numbered in a table of at most so many cells, or else by sorting.
CELLS = 1 << 22
WORDS, STRINGS = 0, 1
ALPHABET = 256

FIELDS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, score_per_byte double"


def is_held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 5 == 1


# --------------------------------------------------------------------------- strings of a block


def numbered(cells: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells, ascending, and each cell's place among them."""
    if n_cells <= CELLS:
        flags = np.zeros(max(n_cells, 1), bool)
        flags[cells] = True
        used = np.flatnonzero(flags)
        place = np.zeros(len(flags), np.int32)
        place[used] = np.arange(len(used))
        return used, place[cells]
    bits = max(len(cells) - 1, 0).bit_length()
    if n_cells.bit_length() + bits > 63:
        used, at = np.unique(cells, return_inverse=True)
        return used, at.astype(np.int32)
    # A cell and its position in one number: sorting values is several times faster than sorting indexes.
    packed = cells.astype(np.int64)
    packed <<= bits
    packed |= np.arange(len(cells))
    packed.sort()
    at = packed & ((1 << bits) - 1)
    packed >>= bits
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    out = np.empty(len(cells), np.int32)
    out[at] = np.cumsum(new, dtype=np.int32) - 1
    return packed[new], out


class Strings:
    """The strings of ORDER + 1 bytes of texts, one for each byte and end mark, numbered by value."""

    def __init__(self, blobs: list[bytes]):
        raw = np.frombuffer(b"".join(x for b in blobs for x in (START, b, END)), np.uint8)
        self.lens = np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1
        first = np.cumsum(self.lens + ORDER) - self.lens - ORDER
        inside = np.ones(len(raw), bool)  # a string begins here and ends in the same text
        for k in range(ORDER):
            inside[first + self.lens + k] = False
        inside = inside[: max(len(raw) - ORDER, 0)]
        pairs = raw[:-1].astype(np.uint16)
        pairs <<= np.uint16(8)
        pairs |= raw[1:]
        seen = np.zeros(1 << 16, bool)
        seen[pairs] = True
        there = np.flatnonzero(seen) if len(pairs) else np.zeros(1, np.int64)
        to = np.zeros(1 << 16, np.uint16)
        to[there] = np.arange(len(there))
        number = to[pairs]
        del pairs, raw
        n = len(inside)
        ids, values, known = number[:n], there.astype(np.uint64), len(there)
        for k in range(2, ORDER + 1, 2):  # two bytes more each time
            cells = ids.astype(np.int32 if known * len(there) < 1 << 31 else np.int64)
            cells *= len(there)
            cells += number[k : k + n]
            if k == ORDER - 1:
                cells = cells[inside]
            used, ids = numbered(cells, known * len(there))
            values = (values[used // len(there)] << np.uint64(16)) | there[used % len(there)].astype(np.uint64)
            known = len(used)
        self.ids, self.values = ids, values

    def key(self, n_slices: int) -> np.ndarray:
        """The slice of each string: its three bytes before the last, spread."""
        return (C.mix64((self.values >> np.uint64(8)) & np.uint64(0xFFFFFF)) >> np.uint64(32)).astype(np.int64) % n_slices


class Block:
    """What a block knows of its own words and strings, in an order that does not depend on that of its rows."""

    def __init__(self, table, n_slices: int):
        texts = C.utf8(table)
        self.doc_ids = table.column("doc_id")
        self.held = table.column("held").to_numpy(zero_copy_only=False).astype(bool)
        hashes, self.lens = C.token_hashes([x.lower() for x in texts])
        self.keys, word = np.unique(hashes, return_inverse=True)
        self.word = word.astype(np.int32)
        self.strings = Strings(texts)
        self.n_slices = n_slices

    def counts(self):
        """Rows (kind, slice, keys, counts in training texts)."""
        learn = ~self.held
        n = np.bincount(self.word[np.repeat(learn, self.lens)], minlength=len(self.keys)).astype(np.uint64)
        edges = C.cuts(self.keys, self.n_slices)
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if hi > lo:
                yield WORDS, k, C.pack_sorted(self.keys[lo:hi]), C.pack(n[lo:hi])
        s = self.strings
        n = np.bincount(s.ids[np.repeat(learn, s.lens)], minlength=len(s.values)).astype(np.uint64)
        of = s.key(self.n_slices)
        for k in range(self.n_slices):
            here = of == k
            if here.any():
                yield STRINGS, k, C.pack_sorted(s.values[here]), C.pack(n[here])

    def low(self) -> tuple[np.ndarray, np.ndarray]:
        """The three-byte strings of training texts, and their counts."""
        s = self.strings
        n = np.bincount(s.ids[np.repeat(~self.held, s.lens)], minlength=len(s.values))
        values, of = np.unique(s.values & np.uint64(0xFFFFFF), return_inverse=True)
        m = np.bincount(of, weights=n, minlength=len(values)).astype(np.uint64)
        return values[m > 0], m[m > 0]

    def gather(self, kind: int, answers: dict[int, np.ndarray]) -> np.ndarray:
        """The answers of all slices, aligned to the block's own words or strings."""
        if kind == WORDS:
            return np.concatenate([answers[k] for k in sorted(answers)]) if answers else np.empty(0)
        of, out = self.strings.key(self.n_slices), np.zeros(len(self.strings.values))
        for k, x in answers.items():
            out[of == k] = x
        return out


# --------------------------------------------------------------------------- the model


class Low:
    """Orders 2, 1 and 0: the sorted three-byte strings seen in training and their counts."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray):
        self.strings, self.n2 = strings.astype(np.int64), counts.astype(np.float64)
        c2, sym = self.strings >> 8, self.strings & 255
        self.n1 = np.bincount(self.strings & 0xFFFF, weights=self.n2, minlength=1 << 16)
        self.n0 = np.bincount(sym, weights=self.n2, minlength=256)
        per = lambda w: np.bincount(c2, weights=w, minlength=1 << 16)
        self.t2, self.u2 = per(self.n2), per(self.n2 > 0)
        self.x1 = per(np.where(self.n2 > 0, self.n1[self.strings & 0xFFFF], 0))  # order-1 counts of the symbols that order 2 excludes
        n1 = self.n1.reshape(256, 256)
        self.t1, self.u1 = n1.sum(1), (n1 > 0).sum(1)
        self.x0 = np.where(n1 > 0, self.n0[None], 0).sum(1)
        self.t0, self.u0 = self.n0.sum(), int((self.n0 > 0).sum())

    def order2(self, strings: np.ndarray) -> np.ndarray:
        """Counts of three-byte strings."""
        if not len(self.strings):
            return np.zeros(len(strings))
        at = np.minimum(np.searchsorted(self.strings, strings), len(self.strings) - 1)
        return np.where(self.strings[at] == strings, self.n2[at], 0.0)


def code_lengths(strings: np.ndarray, counts: np.ndarray, low: Low, order: int = ORDER) -> np.ndarray:
    """log10 probability of the last byte of each string of order + 1 bytes after the bytes before it.

    strings: distinct, with all seen strings of any order-3 context among them; counts: how often each
    was seen in training, 0 for strings that are only scored; low: the counts of orders 2 to 0.
    """
    strings = strings.astype(np.int64)
    sym, c1, c2 = strings & 255, (strings >> 8) & 255, (strings >> 8) & 0xFFFF
    levels = []  # from the longest context: a string's count, its context's total, and kinds, and the next order's counts of those kinds
    for k in range(order, 2, -1):
        values, of = np.unique(strings & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        _, context = np.unique(values >> 8, return_inverse=True)
        n = np.bincount(of, weights=counts, minlength=len(values))
        levels.append((n, of, context, values))
    out, going = np.zeros(len(strings)), np.ones(len(strings), bool)

    def code(n, total, kinds):
        nonlocal going
        known = going & (kinds > 0)  # else all is excluded or the context is new: no cost
        room = np.maximum(total + kinds, 1)
        hit = known & (n > 0)
        out[hit] += np.log10(n[hit] / room[hit])
        miss = known & ~hit
        out[miss] += np.log10(kinds[miss] / room[miss])
        going = going & ~hit

    gone_n, gone_u = np.zeros(len(strings)), np.zeros(len(strings))  # what the longer context excludes from this one
    for k, (n, of, context, values) in zip(range(order, 2, -1), levels, strict=True):
        seen = n > 0
        total, kinds = np.bincount(context, weights=n)[context][of], np.bincount(context, weights=seen)[context][of]
        code(n[of], total - gone_n, kinds - gone_u)
        shorter = values & ((1 << 8 * k) - 1)
        if k > 3:
            below_n, below_of, *_ = levels[order - k + 1]
            below = np.zeros(len(values))
            below[of] = below_n[below_of]
        else:
            below = low.order2(shorter)
        gone_n, gone_u = np.bincount(context, weights=np.where(seen, below, 0))[context][of], kinds
    code(low.order2(strings & 0xFFFFFF), low.t2[c2] - gone_n, low.u2[c2] - gone_u)
    code(low.n1[strings & 0xFFFF], low.t1[c1] - low.x1[c2], low.u1[c1] - low.u2[c2])
    code(low.n0[sym], low.t0 - low.x0[c1], low.u0 - low.u1[c1])
    out[going] -= math.log10(max(1, ALPHABET - low.u0))
    return out


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that learns from the text as it goes (same escapes and exclusion)."""
    trie: dict[bytes, dict[int, int]] = {}
    data, total = START[:order] + text + END, 0.0
    for i in range(order, len(data)):
        out: set[int] = set()
        s = data[i]
        for k in range(order, -1, -1):
            node = trie.get(data[i - k : i], {})
            seen = {x: n for x, n in node.items() if x not in out}
            if not seen:
                continue
            room = sum(seen.values()) + len(seen)
            if s in seen:
                total += math.log10(seen[s] / room)
                break
            total += math.log10(len(seen) / room)
            out |= seen.keys()
        else:
            total -= math.log10(ALPHABET - len(out))
        for k in range(order + 1):
            node = trie.setdefault(data[i - k : i], {})
            node[s] = node.get(s, 0) + 1
    return total


# --------------------------------------------------------------------------- operator


def score(spark: SparkSession, docs: DataFrame, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """FIELDS for every row of docs."""
    rows, n_blocks = C.in_blocks(docs, block_bytes)
    rows = rows.withColumn("held", is_held_out())
    n_slices = C.slices(n_blocks)

    def count(table):
        import pyarrow as pa

        C.release()
        b = Block(table, n_slices)
        block = table.column("block")[0].as_py()
        made = list(b.counts())
        made.append((2, -1, *map(C.pack, b.low())))
        ends = int((~b.held).sum())
        made.append((3, -1, C.pack(np.array([ends])), b""))
        kind, part, keys, counts = zip(*made, strict=True)
        return pa.table({"block": pa.array([block] * len(made), pa.int32()), "kind": pa.array(kind, pa.int32()), "slice": pa.array(part, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    sent = C.save(spark, rows.groupBy("block").applyInArrow(count, "block int, kind int, slice int, keys binary, counts binary"))

    # Orders 2 to 0: partial sums on the executors, then one row for each three-byte string; key -1 counts the texts learned from.
    def add_low(batches):
        import pyarrow as pa

        keys, counts, ends = [], [], 0
        for batch in batches:
            for kind, k, n in zip(batch.column("kind").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if kind == 2:
                    keys.append(C.unpack(k))
                    counts.append(C.unpack(n).astype(np.float64))
                else:
                    ends += int(C.unpack(k)[0])
            if keys:
                v, of = np.unique(np.concatenate(keys), return_inverse=True)
                keys, counts = [v], [np.bincount(of, weights=np.concatenate(counts), minlength=len(v))]
        v, n = (keys[0], counts[0]) if keys else (np.empty(0, np.uint64), np.empty(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(v.astype(np.int64), -1)), pa.array(np.append(n.astype(np.int64), ends))], names=["string", "n"])

    summed = sent.where("kind >= 2").select("kind", "keys", "counts").mapInArrow(add_low, "string long, n long").groupBy("string").agg(F.sum("n").alias("n")).toArrow()
    string, n = summed.column("string").to_numpy(), summed.column("n").to_numpy()
    ends = int(n[string < 0].sum())
    order = np.argsort(string)[int((string < 0).sum()) :]
    low = spark.sparkContext.broadcast(Low(string[order], n[order]))

    def merge(table):
        import pyarrow as pa

        C.release()
        kind, part = table.column("kind")[0].as_py(), table.column("slice")[0].as_py()
        keys, at, lens = C.merge_keys(table.column("keys").to_pylist())
        sent_counts = np.concatenate([C.unpack(x) for x in table.column("counts").to_pylist()])
        n = np.bincount(at, weights=sent_counts.astype(np.float64), minlength=len(keys))
        value = n if kind == WORDS else code_lengths(keys, n, low.value)
        back = np.split(value[at], np.cumsum(lens)[:-1])
        blocks = table.column("block").to_pylist()
        if kind == WORDS:
            packed = [C.pack(x.astype(np.uint64)) for x in back]
            blocks, packed = [*blocks, -1], [*packed, C.pack(np.array([(n > 0).sum(), n.sum()], np.uint64))]
        else:
            packed = [x.astype("<f8").tobytes() for x in back]
        return pa.table({"block": pa.array(blocks, pa.int32()), "kind": pa.array([kind] * len(blocks), pa.int32()), "slice": pa.array([part] * len(blocks), pa.int32()), "answer": pa.array(packed, pa.binary())})

    answers = C.save(spark, sent.where("kind < 2").groupBy("kind", "slice").applyInArrow(merge, "block int, kind int, slice int, answer binary"))

    def add_totals(batches):
        import pyarrow as pa

        total = np.zeros(2, np.int64)
        for batch in batches:
            for x in batch.column("answer").to_pylist():
                total += C.unpack(x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total[:1]), pa.array(total[1:])], names=["v", "n"])

    v, n_words = answers.where("block < 0").select("answer").mapInArrow(add_totals, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    v, n_all = (v or 0) + (ends > 0), (n_words or 0) + ends

    def judge(table, reply):
        import pyarrow as pa

        C.release()
        arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("score_per_byte", pa.float64())])
        if not table.num_rows:
            return arrow.empty_table()
        b = Block(table, n_slices)
        got: dict[int, dict[int, np.ndarray]] = {WORDS: {}, STRINGS: {}}
        for kind, part, x in zip(reply.column("kind").to_pylist(), reply.column("slice").to_pylist(), reply.column("answer").to_pylist(), strict=True):
            got[kind][part] = C.unpack(x).astype(np.float64) if kind == WORDS else np.frombuffer(x, "<f8")
        c = b.gather(WORDS, got[WORDS])
        room = math.log10(n_all + 0.5 * (v + 1))
        base, known = np.log10(c + 0.5) - room, (c > 0).astype(np.int64)
        owner = np.repeat(np.arange(len(b.lens)), b.lens)
        base_sum = np.bincount(owner, weights=base[b.word], minlength=len(b.lens)) + (math.log10(ends + 0.5) - room)
        n_known = np.bincount(owner, weights=known[b.word], minlength=len(b.lens)).astype(np.int64) + (ends > 0)
        s = b.strings
        cost = b.gather(STRINGS, got[STRINGS])[s.ids]
        score = np.add.reduceat(cost, np.cumsum(s.lens) - s.lens)
        return pa.table([b.doc_ids, pa.array(b.held), pa.array(b.lens + 1), pa.array(n_known), pa.array(np.full(len(b.lens), n_all)), pa.array(base_sum), pa.array(score), pa.array(s.lens - 1), pa.array(score / s.lens)], schema=arrow)

    return rows.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(judge, FIELDS)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score(spark, docs)
