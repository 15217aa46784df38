import collections
import math
import zlib

import numpy as np
import pytest

from tessera.llm import ppm

from .conftest import rows, sentences


def held(i):
    return zlib.crc32(str("null" if i is None else i).encode()) % 5 == 1


def brute(data):
    """Counts of every context by dictionaries, and code lengths symbol by symbol with escapes and exclusion."""
    k = ppm.ORDER
    trie = collections.defaultdict(collections.Counter)
    words = collections.Counter()
    for i, text in data:
        if held(i):
            continue
        b = ppm.START + text.encode() + ppm.END
        for j in range(k, len(b)):
            for n in range(k + 1):
                trie[b[j - n : j]][b[j]] += 1
        words.update([*text.encode().lower().split(), None])
    n_all, v = sum(words.values()), len(words)
    out = []
    for i, text in data:
        b, total = ppm.START + text.encode() + ppm.END, 0.0
        for j in range(k, len(b)):
            gone = set()
            for n in range(k, -1, -1):
                seen = {s: c for s, c in trie.get(b[j - n : j], {}).items() if s not in gone}
                if not seen:
                    continue
                room = sum(seen.values()) + len(seen)
                if b[j] in seen:
                    total += math.log10(seen[b[j]] / room)
                    break
                total += math.log10(len(seen) / room)
                gone |= seen.keys()
            else:
                total -= math.log10(256 - len(gone))
        tokens = [*text.encode().lower().split(), None]
        base = sum(math.log10((words[w] + 0.5) / (n_all + 0.5 * (v + 1))) for w in tokens)
        out.append((i, held(i), len(tokens), sum(words[w] > 0 for w in tokens), n_all, base, total))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:7] == pytest.approx(b[5:7], rel=1e-9)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_scores_equal_a_dictionary_trie(spark, make, block_bytes):
    texts = [*sentences(40, 3), "", "Größe ÄÖ 漢字 😀", "THE the The", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    df = make(rows(*texts))
    got = [tuple(r)[:7] for r in ppm.score(spark, df, block_bytes).collect()]
    same(got, brute([(k + 1, t) for k, t in enumerate(texts)]))


def test_odd_rows(spark, odd, empty):
    data = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    same([tuple(r)[:7] for r in ppm.query(spark, odd).collect()], brute(data))
    assert ppm.query(spark, empty).collect() == []


def test_no_training_text(spark, make):
    ids = [i for i in range(60) if held(i)][:3]
    got = ppm.query(spark, make([(i, "ab", None, None, None, None, None) for i in ids])).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-3 * math.log10(256)) for r in got)


def test_probabilities_of_a_context_sum_to_one():
    """Over all symbols, in known and in new contexts."""
    b = ppm.START + b"abracadabra abracadabra" + ppm.END
    strings = collections.Counter(b[j - ppm.ORDER : j + 1] for j in range(ppm.ORDER, len(b)))
    low = collections.Counter(s[-3:] for s in strings.elements())
    number = lambda s: int.from_bytes(s, "big")
    for context in (b"adabr", b"zzabr", b"zzzzr", b"zzzzz"):
        every = sorted({*strings, *(context + bytes([s]) for s in range(256))})
        codes = np.array([number(s) for s in every], np.uint64)
        keys = sorted(low)
        lengths = ppm.code_lengths(codes, np.array([strings.get(s, 0) for s in every], float), ppm.Low(np.array([number(s) for s in keys]), np.array([low[s] for s in keys])))
        assert sum(10**x for s, x in zip(every, lengths, strict=True) if s[:-1] == context) == pytest.approx(1)


def test_adaptive_learns_repeats():
    once, twice = ppm.adaptive(b"some sentence here. "), ppm.adaptive(b"some sentence here. " * 2)
    assert twice - once > once / 2


def test_numbering_by_table_and_by_sorting_agree():
    cells = np.array([5, 3, 5, 9, 3, 0])
    for n in (10, ppm.CELLS + 1, 1 << 62):
        used, at = ppm.numbered(cells, n)
        assert used.tolist() == [0, 3, 5, 9] and at.tolist() == [2, 1, 2, 3, 1, 0]
