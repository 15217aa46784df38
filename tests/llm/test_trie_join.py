import random

import numpy as np
import pytest

from tessera.llm import common as C
from tessera.llm import trie_join as J

from .conftest import rows, sentences


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(data):
    sets = [shingles(t) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(data)), key=repr)


def family(seed, copies, edits, words=80):
    """Copies of a text with some words replaced."""
    rng = random.Random(seed)
    base = sentences(1, seed, length=(words, words))[0].split()
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_equal_brute_force(spark, make, seed, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "TRIE", 4)
    texts = [*family(seed, 30, 5), *family(seed + 10, 25, 3, 30), *family(seed + 20, 10, 1, 9), *sentences(40, seed, words=30, length=(0, 14)), "one two", "One TWO", "", "two one"]
    random.Random(seed).shuffle(texts)
    data = [(k + 1, t) for k, t in enumerate(texts)]
    assert sorted(map(tuple, J.query(spark, make(rows(*texts))).collect()), key=repr) == brute(data)


def test_chains_without_a_common_centre(spark, make):
    """Each text is near its neighbours only: a class held together by links alone."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k * 8 : k * 8 + 100]) for k in range(20)]
    data = [(k + 1, t) for k, t in enumerate(texts)]
    want = brute(data)
    assert {w[2] for w in want} == {1}
    assert sorted(map(tuple, J.query(spark, make(rows(*texts))).collect()), key=repr) == want


def test_the_threshold_is_exact(spark, make):
    """36 of 45 shingles is four fifths; 35 of 46 is less."""
    a = [f"w{k}" for k in range(44)]
    for cut, linked in ((36, True), (35, False)):
        b = a[: cut + 4] + [f"x{k}" for k in range(45 - 40)]
        got = J.query(spark, make(rows(" ".join(a), " ".join(b)))).collect()
        both, union = len(shingles(" ".join(a)) & shingles(" ".join(b))), len(shingles(" ".join(a)) | shingles(" ".join(b)))
        assert (100 * both >= 80 * union) == linked == (len({r.component_id for r in got}) == 1)


def test_odd_rows(spark, odd, empty):
    data = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, J.query(spark, odd).collect()), key=repr) == brute(data)
    assert J.query(spark, empty).collect() == []


def test_tries_prune_nothing_that_is_similar():
    rng = random.Random(3)
    members = [(k, n + rng.randint(0, 3), np.array(sorted(rng.sample(range(1, 60), n)), np.int64)) for k in range(120) for n in [rng.randint(1, 40)]]
    trie = J.Trie(members)
    for node, n, s in members[:40]:
        want = {m for m, size, t in members if len(set(s) & set(t)) >= J.needed(n, size) and 100 * min(n, size) >= 80 * max(n, size)}
        assert set(trie.links(n, s, step=3)) == want


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, C.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}
    assert C.components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("hub", [1, 1000])
def test_components_of_hubs_chains_and_cycles(spark, monkeypatch, hub):
    monkeypatch.setattr(C, "HUB_LINKS", hub)
    monkeypatch.setattr(C, "HUBS", 8)
    links = [(500, k) for k in range(501, 700)] + [(k, 999) for k in range(400, 499)] + [(k, k + 1) for k in range(40)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    got = {r.node: r.component for r in C.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 500 for k in range(500, 700)} | {k: 400 for k in [*range(400, 499), 999]} | {k: 0 for k in range(41)} | {900: 900, 901: 900, 902: 900}
    assert got == want
