import bisect
import hashlib

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import prefix_hash as H

from .conftest import rows, sentences


@given(st.text(alphabet="ab😀é", max_size=60), st.text(alphabet="ab😀é", max_size=60), st.integers(0, 60), st.integers(0, 60))
def test_common_extensions_are_those_of_the_texts(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    x, y = H.PrefixHash(H.code_points(a)), H.PrefixHash(H.code_points(b))
    assert x.common(i, y, j) == n
    assert x.equal(0, y, 0, min(len(a), len(b))) == (a[: min(len(a), len(b))] == b[: min(len(a), len(b))])


def test_span_hashes_by_arrays_are_the_single_ones():
    x = H.PrefixHash(H.code_points("some text with spans"))
    h = x.spans(slice(0, 11), slice(10, 21), 0)
    assert [int(v) for v in h] == [x.span(i, i + 10) >> 31 for i in range(11)]


def brute(data):
    """(id, n, edited sha, near pair) by sorting the rows."""
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(text) // 2
        changed = text[: len(text) - m] + after[:m]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), H.PrefixHash(H.code_points(text)).fingerprint()[0], H.PrefixHash(H.code_points(changed)).fingerprint()[0], H.PrefixHash(H.code_points(after)).fingerprint()[0]))
    return out


def check(df, data, range_bytes):
    got = {(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint): r for r in H.pairs(df, H._compare, H.FIELDS, range_bytes).collect()}
    want = brute(data)
    assert set(got) == {w[:5] for w in want}
    for w in want:
        r = got[w[:5]]
        assert r.near_edited == H.likeness(w[3], w[4]) and r.near_next == H.likeness(w[3], w[5])
        assert 0 <= r.near_next <= 1


def test_chains_over_many_ranges(make):
    texts = sentences(70, 4)
    check(make(rows(*texts)), [(k + 1, t) for k, t in enumerate(texts)], 400)
    check(make(rows(*texts)), [(k + 1, t) for k, t in enumerate(texts)], 1 << 20)


def test_odd_rows(spark, odd, empty, make):
    check(odd, [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()], 1000)
    assert H.query(spark, empty).collect() == []
    check(make(rows("alone in the table")), [(1, "alone in the table")], 1000)


def test_likeness_follows_similarity():
    a = sentences(1, 9, length=(300, 300))[0]
    f = lambda x: H.PrefixHash(H.code_points(x)).fingerprint()[0]
    near, half, other = a[:-40] + "x" * 40, a[: len(a) // 2] + sentences(1, 10, length=(150, 150))[0], sentences(1, 11, words=50, length=(300, 300))[0]
    assert H.likeness(f(a), f(a)) == 1.0
    assert H.likeness(f(a), f(near)) > 0.75 > H.likeness(f(a), f(half)) > 0.15
    assert H.likeness(f(a), f(other)) < 0.1
    assert H.likeness(f(""), f("")) == 1.0 and H.likeness(f(""), f(a)) == 0.0


def test_the_search_among_edges_is_small_however_many_there_are(spark):
    for n in (1, 2, 7, 449, 10_000):
        edges = [3 * k for k in range(n)]
        ids = [-5, 0, 1, 3 * n // 2, 3 * n - 3, 3 * n - 2, 3 * n + 9, None]
        got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", H._search(edges).alias("part"))
        assert {r.doc_id: r.part for r in got.collect()} == {i: n if i is None else n - bisect.bisect_left(edges, i) for i in ids}
