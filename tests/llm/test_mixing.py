import collections

import pytest

from tessera.llm import mixing as X

from .conftest import sentences


def fill(sizes):
    """Targets by resharing until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: X.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        ws = sum(w[s] for s in names if s not in capped)
        share = {s: rest * w[s] / ws for s in names if s not in capped}
        over = {s: 3.0 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def rows_of(sizes, copies=1):
    data, i = [], 0
    for source, words in sizes.items():
        for k in range(copies):
            n = words // copies + (k < words % copies)
            data.append((i, " ".join(["w"] * n), None, source, None, None, None))
            i += 1
    return data


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 700, "d": 3, None: 40}, {"a": 7}, {"a": 0, "b": 10}, {"b": 1, "a": 1, "c": 1}, {"A": 1000, "a": 1, "é": 2, "z": 3, "zz": 4, "zzz": 900}, {"a": 0}])
def test_targets_equal_repeated_resharing(make, sizes):
    got = {r.source: r for r in X.targets(make(rows_of(sizes)).select("source", X.size_of(X.F.col("text")).alias("size"))).collect()}
    want = fill(sizes) if any(sizes.values()) else {"a": 0.0}
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)
    assert sum(r.target for r in got.values()) == pytest.approx(sum(sizes.values()))
    assert all(r.rate <= 3 for r in got.values())


def test_taken_words_come_near_and_reruns_agree(make):
    sizes = {"a": 20_000, "b": 9_000, "c": 30_000, "d": 2_000}
    df = make(rows_of(sizes, 1500))
    got = X.query(df).collect()
    taken, target = collections.Counter(), {}
    source = {r[0]: r[3] for r in rows_of(sizes, 1500)}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken in (k * r.size for k in range(4)) and r.source_size == sizes[source[r.doc_id]]
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in sizes)
    assert sorted(X.query(df.repartition(7)).collect()) == sorted(got)


def test_mix_emits_rows_as_often_as_taken(make):
    df = make([(k, t, "en", f"s{k % 4}", None, None, None) for k, t in enumerate(sentences(80, 2))])
    times = collections.Counter(r.doc_id for r in X.mix(df).collect())
    assert X.mix(df).columns == df.columns
    for r in X.copies(df).collect():
        assert times[r.doc_id] == r.copies


def test_odd_rows(odd, empty):
    assert X.query(odd).count() == odd.count()
    assert {r.size for r in X.query(odd).where("doc_id = 1").collect()} == {0}
    assert X.query(empty).collect() == [] and X.mix(empty).collect() == []
