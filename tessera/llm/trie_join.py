"""N-gram Jaccard join by prefix trees: near-duplicate classes of documents.

A document's set is that of its distinct five-word shingles.  Sets are ordered globally, by the
number of documents that hold a shingle and then by fingerprint, rarest first.  Two sets of
Jaccard similarity of at least 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each.

1.  The packed key exchange counts every shingle's documents.  Shingles of one document cannot
    be shared; a document with more than a fifth of them has no partner and goes no further.
2.  Equal sets are one node.  Nodes meet under their prefix shingles.  Under each, all are
    compared with one centre, the smallest node, which is the same for most shingles of a family.
3.  Links make components.  Where a shingle still holds several components, the nodes outside
    its largest one are compared with the nodes of the other components, block by block, so
    that every pair under a shingle is either compared or already in one component.

Comparisons are made in tries: a task's sets, most frequent shingle first, are sorted into a
trie, and a probe walks it once, so that sets with a common beginning share the partial
overlap; a subtree is left as soon as the overlap so far and the shingles left on either side
cannot reach what the two sizes need.

No group is emitted as pairs, no set, link or component is collected to the driver, and the
members of a hot centre or the probes of a hot block are dealt to as many parts as their count needs.

Defined cases: texts without words (or null) have an empty set and link with nothing; fewer than
five words are one shingle of the whole sequence; repeated rows have equal sets; a row without
an id takes part in links, but is no class's id unless all are null.  Sets and shingles count as
equal if their 64-bit fingerprints are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
#: Similarity of at least PART / WHOLE links.
PART, WHOLE = 80, 100
#: Sets in one trie, and in a part of the members of one centre, or of the probes of one block.
TRIE = 256
#: Nodes in a block of the second comparison.
BLOCK = 1024


def least_shared(n):
    """Shingles that a set of n must share with any partner."""
    return -(-PART * n // WHOLE)


def needed(n, m):
    """Shared shingles that sets of n and m need."""
    return -(-PART * (n + m) // (WHOLE + PART))


# --------------------------------------------------------------------------- sets


class Sets:
    """The shingle sets of a block's documents."""

    def __init__(self, table, size: int = SHINGLE):
        self.ids = table.column("doc_id").to_pylist()
        hashes, lens = C.token_hashes([x.lower() for x in C.utf8(table)])
        owner = np.repeat(np.arange(len(lens)), lens)
        g = C.gram_hashes(hashes, size)
        at = np.flatnonzero(owner[: len(g)] == owner[size - 1 : size - 1 + len(g)])
        key, doc = g[at], owner[at]
        short = np.flatnonzero((lens > 0) & (lens < size))
        if len(short):
            begin = np.cumsum(lens) - lens
            whole = np.array([C.gram_hashes(hashes[begin[k] : begin[k] + lens[k]], int(lens[k]))[0] for k in short], np.uint64)
            key, doc = np.concatenate([key, C.mix64(whole + lens[short].astype(np.uint64))]), np.concatenate([doc, short])
        self.keys, to = np.unique(key, return_inverse=True)
        # distinct (document, key)
        pair = np.unique(doc.astype(np.int64) * max(1, len(self.keys)) + to)
        self.doc, self.key = pair // max(1, len(self.keys)), pair % max(1, len(self.keys))
        self.n = np.bincount(self.doc, minlength=len(lens))


def shingle_sets(docs: DataFrame, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n, node, shared) of every row: the size of the set, its fingerprint, and its shared shingles, rarest first, if it may have a partner."""
    rows, n_blocks = C.in_blocks(docs, block_bytes)
    n_slices = C.slices(n_blocks)

    def send(table):
        import pyarrow as pa

        C.release()
        s, block = Sets(table), table.column("block")[0].as_py()
        df = np.bincount(s.key, minlength=len(s.keys)).astype(np.uint64)
        edges = C.cuts(s.keys, n_slices)
        out = [(k, C.pack_sorted(s.keys[lo:hi]), C.pack(df[lo:hi])) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
        part, keys, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"block": pa.array([block] * len(out), pa.int32()), "slice": pa.array(part, pa.int32()), "keys": pa.array(keys, pa.binary()), "n": pa.array(n, pa.binary())})

    def answer(table):
        import pyarrow as pa

        C.release()
        keys, at, lens = C.merge_keys(table.column("keys").to_pylist())
        own = np.concatenate([C.unpack(x) for x in table.column("n").to_pylist()])
        df = np.bincount(at, weights=own, minlength=len(keys)).astype(np.uint64)[at]
        return pa.table({"block": table.column("block"), "slice": table.column("slice"), "df": pa.array([C.pack(x - np.uint64(1)) for x in np.split(df, np.cumsum(lens)[:-1])], pa.binary())})

    sent = rows.groupBy("block").applyInArrow(send, "block int, slice int, keys binary, n binary")
    told = sent.groupBy("slice").applyInArrow(answer, "block int, slice int, df binary")

    def order(table, reply):
        import pyarrow as pa

        C.release()
        arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("shared", pa.list_(pa.int64()))])
        if not table.num_rows:
            return arrow.empty_table()
        s = Sets(table)
        df = np.zeros(len(s.keys), np.uint64)
        edges = C.cuts(s.keys, n_slices)
        for part, x in zip(reply.column("slice").to_pylist(), reply.column("df").to_pylist(), strict=True):
            df[edges[part] : edges[part + 1]] = C.unpack(x)
        common = df[s.key] > 0
        n_shared = np.bincount(s.doc[common], minlength=len(s.n))
        ends = np.cumsum(s.n)
        nodes, shared = [], []
        for k, (n, hi) in enumerate(zip(s.n.tolist(), ends.tolist(), strict=True)):
            own = s.key[hi - n : hi]
            keys = s.keys[own]
            nodes.append(int(C.mix64(np.add.reduce(C.mix64(keys), keepdims=True) + np.uint64(n))[0].view(np.int64)) if n else None)
            if n and n_shared[k] >= least_shared(n):
                f = df[own]
                pick = f > 0
                keys, f = keys[pick], f[pick]
                shared.append(keys[np.lexsort((keys, f))].view(np.int64))
            else:
                shared.append(None)
        return pa.table([table.column("doc_id"), pa.array(s.n), pa.array(nodes, pa.int64()), pa.array(shared, pa.list_(pa.int64()))], schema=arrow)

    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(order, "doc_id long, n long, node long, shared array<long>")


# --------------------------------------------------------------------------- tries


class Trie:
    """Sets in trie order: sorted sequences with the length of the beginning that each shares with the one before."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        """members: (node, size of the whole set, shared shingles rarest first)."""
        seqs = sorted(((np.ascontiguousarray(s[::-1]).view(np.uint64), node, n) for node, n, s in members), key=lambda x: x[0].astype(">u8").tobytes())
        self.members = seqs
        self.lcp = [0]
        for (a, *_), (b, *_) in zip(seqs, seqs[1:], strict=False):
            k = min(len(a), len(b))
            d = np.flatnonzero(a[:k] != b[:k])
            self.lcp.append(int(d[0]) if len(d) else k)

    def links(self, n: int, shingles: np.ndarray, step: int = 64) -> list[int]:
        """The nodes whose sets are similar to a set of size n with these shared shingles."""
        probe = np.sort(shingles.view(np.uint64))
        most = max((len(s) for s, *_ in self.members), default=0)
        sums = np.zeros(most + 1, np.int64)  # overlap of the current path up to each depth
        depth, out = 0, []
        for (seq, node, m), lcp in zip(self.members, self.lcp, strict=True):
            depth = min(depth, lcp)
            if WHOLE * min(n, m) < PART * max(n, m):
                continue
            need, size = needed(n, m), len(seq)
            while depth < size:
                o = int(sums[depth])
                if o + min(size - depth, len(probe) - o) < need:
                    break
                part = seq[depth : depth + step]
                at = np.searchsorted(probe, part)
                hit = probe[np.minimum(at, len(probe) - 1)] == part
                sums[depth + 1 : depth + 1 + len(part)] = o + np.cumsum(hit)
                depth += len(part)
            else:
                if int(sums[size]) >= need:
                    out.append(node)
        return out


def compare(rows: DataFrame, hold_members: bool) -> DataFrame:
    """Links (a, b) from rows (grp, member, node, n, shared): in each group every probe against every member.

    A task streams over its groups.  It holds a group's members, in tries, while probes pass; or its
    probes, while members pass, a trie at a time.  The held side must be bounded.
    """

    def run(batches):
        import pyarrow as pa

        group, held, passing, tries, links = None, [], [], [], []

        def walk(trie, probes):
            for node, n, s in probes:
                links.extend((node, other) for other in trie.links(n, s) if other != node)

        def settle():
            if hold_members:
                if not tries and held:
                    tries.extend(Trie(held[k : k + TRIE]) for k in range(0, len(held), TRIE))
                for trie in tries:
                    walk(trie, passing)
            elif passing:
                walk(Trie(passing), held)
            passing.clear()

        def flush():
            a, b = zip(*links, strict=True) if links else ((), ())
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            shared = batch.column("shared")
            values, offsets = shared.flatten().to_numpy(), shared.offsets.to_numpy() - shared.offsets[0].as_py()
            for k, (g, member, node, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "member", "node", "n")), strict=True)):
                if g != group:
                    settle()
                    held.clear(), tries.clear()
                    group = g
                (held if member == hold_members else passing).append((node, n, values[offsets[k] : offsets[k + 1]].copy()))
                if len(passing) >= TRIE:
                    settle()
            if len(links) > 10_000:
                yield flush()
        settle()
        yield flush()

    first = F.desc("member") if hold_members else F.asc("member")
    return rows.repartition("grp").sortWithinPartitions("grp", first, "node").mapInArrow(run, "a long, b long")


# --------------------------------------------------------------------------- classes


def prefixes(nodes: DataFrame) -> DataFrame:
    """(shingle, node, n): the shared shingles of each node's prefix, where two nodes or more meet."""
    length = F.col("n") - F.expr(f"ceil({PART} * n / {WHOLE}.0)") + 1 - (F.col("n") - F.size("shared"))
    rank = F.struct((F.size("shared") / F.col("n")).alias("share"), F.size("shared").alias("size"), "node", "n")
    rows = nodes.select(F.explode(F.slice("shared", F.lit(1), length.cast("int"))).alias("shingle"), "node", "n", rank.alias("rank"))
    several = rows.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("rank").alias("top")).where("lo < hi").select("shingle", F.col("top.node").alias("centre"), F.col("top.n").alias("centre_n"))
    return rows.drop("rank").join(several, "shingle")


def _dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """rows (key, node) with grp: a part of the key's rows of about TRIE nodes, as many parts as the key needs.

    Only keys with more rows than that are counted into the table of parts, so it is shorter than
    rows by that factor; it comes from files, so that Spark joins it by its size or splits a hot key.
    """
    parts = C.save(spark, rows.groupBy(key).agg(F.ceil(F.count("*") / TRIE).alias("parts")).where("parts > 1"))
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    return rows.join(parts, key, "left").select(key, "node", F.concat_ws("/", F.col(key).cast("string"), part.cast("string")).alias("grp"))


def _rows(keys: DataFrame, nodes: DataFrame, member: bool) -> DataFrame:
    return keys.join(nodes, "node").select("grp", F.lit(member).alias("member"), "node", "n", "shared")


def links(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(a, b) links of nodes, enough to connect each class."""
    nodes = C.save(spark, sets.where("shared is not null").dropDuplicates(["node"]).select("node", "n", "shared"))
    meet = C.save(spark, prefixes(nodes))

    # Every node against the centres of its prefix shingles.
    alike = F.least("n", "centre_n") * WHOLE >= F.greatest("n", "centre_n") * PART
    pairs = C.save(spark, meet.where((F.col("node") != F.col("centre")) & alike).select("centre", "node").distinct())
    members = C.save(spark, _dealt(spark, pairs, "centre"))
    centres = members.select("grp", F.col("centre").alias("node")).distinct()
    members = members.select("grp", "node")
    first = C.save(spark, compare(_rows(members, nodes, True).unionByName(_rows(centres, nodes, False)), hold_members=False))

    # Shingles that still hold several components.
    classes = C.components(spark, first)
    named = meet.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = named.groupBy("shingle", "component").count()
    split = counted.groupBy("shingle").agg(F.count("*").alias("k"), F.max(F.struct("count", "component")).alias("top")).where("k > 1").select("shingle", F.col("top.component").alias("largest"))
    rest = C.save(spark, named.join(split, "shingle"))
    # Blocks of nodes of one home, its least centre, so that a family's nodes stand together.
    homes = rest.groupBy("node").agg(F.min("centre").alias("home"))
    parts = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    block = F.concat_ws(":", "home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("string"))
    placed = C.save(spark, homes.join(parts, "home").select("node", block.alias("block")))
    under = rest.select("shingle", "node").join(placed, "node").select("shingle", "block").distinct()
    probes = C.save(spark, rest.where("component <> largest").select("shingle", "node").join(under, "shingle").select("node", "block").distinct())
    probes = C.save(spark, _dealt(spark, probes, "block"))
    held = probes.select("grp", "block").distinct().join(placed, "block").select("grp", "node")
    second = compare(_rows(held, nodes, True).unionByName(_rows(probes.select("grp", "node"), nodes, False)), hold_members=True)
    return first.unionByName(C.save(spark, second))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    sets = C.save(spark, shingle_sets(docs))
    classes = C.components(spark, links(spark, sets))
    least = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = least.join(classes, "node")
    joined = linked.groupBy("component").agg(F.min("least").alias("id"))
    # From files, so that the last join shuffles both its sides and Spark can split the copies of one text.
    of = C.save(spark, least.join(linked.join(joined, "component").select("node", "id"), "node", "left").select("node", F.coalesce("id", "least").alias("id")))
    return sets.join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("component_id"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(spark, docs)


#: The plain definition, for tables small enough to compare all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(words, i, i + 4)) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node WHERE r.low < l.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(low) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""
