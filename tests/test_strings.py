import difflib
import random

import pytest

from tessera.functions import strings as S


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_and_partial_ratio_equal_plain_ones():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert S.lcs(a, b) == plain_lcs(a, b)
        s, t = sorted((a, b), key=len)
        if s:
            windows = [t[max(0, e - len(s)) : e] for e in range(1, len(t) + len(s))]
            want = max(2 * plain_lcs(s, w) / (len(s) + len(w)) for w in windows if w)
            if len(a) == len(b):
                want = max(want, max(2 * plain_lcs(b, a[max(0, e - len(b)) : e]) / (len(b) + len(a[max(0, e - len(b)) : e])) for e in range(1, 2 * len(a)) if a[max(0, e - len(b)) : e]))
            assert S.partial_ratio(a, b) == pytest.approx(want)


def test_known_values():
    assert S.ratio("same", "same") == 1 and S.ratio("", "") == 1 and S.ratio("a", "") == 0
    assert S.ratio("this is a test", "this is a test!") == pytest.approx(28 / 29)
    assert S.token_sort_ratio("kumar rajesh", "rajesh kumar") == 1
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert S.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro_winkler("abc", "xyz") == 0
    assert S.ratio("apex technology solutions", "apex technlogy solutns") > 0.85
    assert S.ratio("abcd", "bcde") == pytest.approx(2 * sum(b.size for b in difflib.SequenceMatcher(None, "abcd", "bcde").get_matching_blocks()) / 8)


MANY = ((S.ratios, S.ratio), (S.partial_ratios, S.partial_ratio), (S.token_sort_ratios, S.token_sort_ratio), (S.token_set_ratios, S.token_set_ratio), (S.jaro_winklers, S.jaro_winkler))


@pytest.mark.parametrize("few", [1, S.FEW])
def test_many_pairs_at_once_equal_one_by_one(monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(2)
    bag = ["".join(rng.choice("abcdeé漢😀\ud800") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    string = lambda most: " ".join(rng.choice(bag) for _ in range(rng.randint(0, most)))
    pairs = [(string(n), string(n)) for n, times in ((1, 150), (4, 150), (12, 150), (16, 150), (40, 20), (150, 6)) for _ in range(times)]
    # either end of a word of 64, of the words together, and of what is taken one by one
    edge = ["x" * 64, "x" * 65, "xy" * 32, "ab" * 32 + "c", "z" * 128, "yz" * 64 + "q", "ab" * 128, "ba" * 128 + "k", "k" * 257, "abk" * 1400]
    pairs += [(a, b) for a in edge for b in edge] + [("", ""), ("", "a"), ("a", "")]
    for many, one in MANY:
        assert many(pairs).tolist() == [one(a, b) for a, b in pairs], one.__name__
        assert len(many([])) == 0


def test_long_common_subsequence_equals_plain_one():
    rng = random.Random(3)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (700, 900))
    assert S.lcs(a, b) == plain_lcs(a, b) == S.lcs_many([(a, b)] * S.FEW)[-1]


def test_column_values():
    pairs = [(None, None), ("", ""), (None, "a"), ("a", "a"), ("a b", "b a")]
    got = S._of_column([a for a, _ in pairs], [b for _, b in pairs], (S.ratios, S.token_sort_ratios))
    assert got.tolist() == [[0, 0], [0, 0], [0, 0], [1, 1], [pytest.approx(1 / 3), 1]]


def test_names_take_their_jaro_steps_at_once(monkeypatch):
    rng = random.Random(4)
    name = lambda: " ".join("".join(rng.choice("abcdeé漢😀\ud800") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 4)))
    pairs = [(name(), name()) for _ in range(2000)] + [("martha", "marhta"), ("a", "ab"), ("ab", "a"), ("x" * 64, "x" * 63 + "y")] * S.FEW
    want = [S.jaro_winkler(a, b) for a, b in pairs]
    one, alone = S.jaro_winkler, []
    monkeypatch.setattr(S, "jaro_winkler", lambda a, b: alone.append(a) or one(a, b))
    assert S.jaro_winklers(pairs).tolist() == want
    assert len(alone) < len(pairs) / 2  # some lengths have too few pairs
