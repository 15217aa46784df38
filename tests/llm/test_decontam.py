import collections
import random

import pytest

from tessera.llm import decontam as D

from .conftest import rows, sentences

ITEMS = "item_id long, text string, doc_id long"


def words(text):
    return text.encode().lower().split()


def shingles(w):
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute(data, items):
    """Best window of an item's size where a shared shingle lays the item over the document."""
    out = {}
    for i, text in data:
        w = words(text)
        for item, t in items:
            b = words(t)
            if not b or not w:
                continue
            own, best = shingles(b), None
            if len(b) < 5 or len(w) < 5:
                best = (1.0, 0) if w == b else None
            else:
                for lo in {i - j for i in range(len(w) - 4) for j in range(len(b) - 4) if w[i : i + 5] == b[j : j + 5]}:
                    x = shingles(w[max(lo, 0) : max(lo + len(b), 0)]) if lo + len(b) - max(lo, 0) >= 5 else collections.Counter()
                    both = sum((x & own).values())
                    if both:
                        s = both / (sum(x.values()) + sum(own.values()) - both)
                        best = max(best or (0, 0), (s, -max(lo, 0)))
            if best and best[0] >= 0.8:
                out[(i, item)] = max(out.get((i, item), (0, 0)), best)
    return {k: v[0] for k, v in out.items()}


def test_leaks_equal_brute_force(spark, make):
    rng = random.Random(4)
    items = [(k, t) for k, t in enumerate(sentences(12, 7, words=200, length=(10, 50)))]
    texts = sentences(40, 8, words=200, length=(20, 120))
    for k in range(40):
        t = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = "edited"
        w = texts[k].split()
        at = rng.randint(0, len(w))
        texts[k] = " ".join(w[:at] + t + w[at:]).upper() if k % 3 else " \n".join(t)
    data = [(k + 1, t) for k, t in enumerate(texts)]
    want = brute(data, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in D.leaks(spark, make(rows(*texts)), spark.createDataFrame([(*i, 0) for i in items], ITEMS)).collect()}
    assert len(want) > 10 and got == pytest.approx(want)


def test_simhash_is_the_majority_of_bits(spark):
    h = [5, 3, 1, -1]
    (r,) = spark.createDataFrame([(h,)], "h array<long>").selectExpr(D.simhash_of("h") + " AS f").collect()
    want = 0
    for b in range(64):
        if 2 * sum(x >> b & 1 for x in h) > len(h):
            want |= 1 << b
    assert r.f % (1 << 64) == want


def test_fingerprints_within_the_radius_share_a_block(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), D.RADIUS):
            b ^= 1 << k
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(f"size(array_intersect({D._blocks('a')}, {D._blocks('b')})) = 0").count() == 0


def test_words_are_split_at_blanks_only(spark):
    text = "\x0b\x0c For\x1f \tÄb\r\nfor\u00a0x f\x0b"
    (r,) = spark.createDataFrame([(text,)], "text string").selectExpr(D.words_of() + " AS w").collect()
    assert [x.encode() for x in r.w] == words(text)


def test_odd_rows(spark, odd, empty, make):
    items = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a", 1), (3, "another text under a repeated id", 9), (3, "another text under a repeated id", 9)], ITEMS)
    got = sorted(map(tuple, D.leaks(spark, odd, items).collect()), key=repr)
    assert got == [(4, 3, 0, 1.0), (4, None, 0, 1.0)]
    assert D.leaks(spark, empty, items).collect() == [] and D.leaks(spark, odd, items.limit(0)).collect() == []
    kept = D.clean(spark, odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.where("doc_id IS NULL OR doc_id <> 4").count()
