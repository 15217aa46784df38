"""String similarities (F3 to F7, F21 to F23): from their published definitions, bit-parallel.

The ratio is the normalised indel similarity 2 L / (m + n) with L the length of the longest
common subsequence, counted 64 cells and more at a time on whole numbers used as bit vectors.
One Arrow batch of pairs crosses to Python once for all values that a query asks for.  Where what two strings do
not share at their ends is short, as in names and most addresses, all pairs of the batch take a
step at once on arrays of 64-bit words; longer ones go one by one.  Both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _places(a: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _bits(a: str, b: str, at: dict[str, int]) -> int:
    full = (1 << len(a)) - 1
    row, get = full, at.get
    for k in range(0, len(b), 64):  # a step carries one bit at most beyond the vector, which is cut off now and then
        for c in b[k : k + 64]:
            u = get(c)
            if u is not None:
                u &= row
                row = row + u | row ^ u
        row &= full
    return len(a) - row.bit_count()


def _trimmed(a: str, b: str) -> tuple[int, str, str]:
    """The length of what both begin and end with, and the rest of each, the shorter one first."""
    k = _common(a, b)
    a, b = a[k:], b[k:]
    e = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - e], b[: len(b) - e]
    return (k + e, a, b) if len(a) <= len(b) else (k + e, b, a)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; what both begin or end with is part of one."""
    k, a, b = _trimmed(a, b)
    return k + (_bits(b, a, _places(b)) if a else 0)  # the shorter one is passed over, on a longer bit vector


def ratio(a: str, b: str) -> float:
    """1 for two empty strings."""
    return 1.0 if a == b else 2.0 * lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer of its length, or a shorter one at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def _best_window(a: str, b: str) -> float:
    """The best ratio of a with a window of b of its length, or a shorter one at either end."""
    m, at, best = len(a), _places(a), 0.0
    known = [0]  # letters of b up to each place that a has: no window shares more with a
    for c in b:
        known.append(known[-1] + (c in at))
    for end in range(1, len(b) + m):
        lo, hi = max(0, end - m), min(end, len(b))
        if 2.0 * min(m, known[hi] - known[lo]) / (m + hi - lo) > best:
            best = max(best, 2.0 * _bits(a, b[lo:hi], at) / (m + hi - lo))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_sets(a: str, b: str) -> tuple[float, str, str]:
    """A value that the token set ratio reaches, and two strings whose ratio it reaches as well."""
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0, "", "x"
    both, one, two = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
    if both and (not one or not two):
        return 1.0, "", "x"
    first, second = f"{both} {one}".strip(), f"{both} {two}".strip()
    # the common words begin both: their ratio to either is known
    return max(2.0 * len(both) / (len(both) + len(x)) for x in (first, second)), first, second


def token_set_ratio(a: str, b: str) -> float:
    known, first, second = _token_sets(a, b)
    return max(known, ratio(first, second))


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    left, matched = list(b), []
    for i, c in enumerate(a):
        try:
            j = left.index(c, max(0, i - reach), min(len(b), i + reach + 1))
        except ValueError:
            continue
        left[j] = None
        matched.append(c)
    k = len(matched)
    if not k:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, left, strict=True) if u is None), strict=True)) // 2
    return (k / len(a) + k / len(b) + (k - swaps) / k) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    s = jaro(a, b)
    if s <= 0.7:
        return s
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return s + same * weight * (1 - s)


# --------------------------------------------------------------------------- many pairs at once

#: Letters of the shorter string, in words of 64, and of the longer one, up to which pairs take their steps together.
WORDS, LETTERS = 4, 1024
#: Pairs that take their steps together: at most so many, and at least so many to be worth it.
LANES, FEW = 2048, 128
#: Different letters up to which their places are tabled.
ALPHABET = 128
_ONES = np.uint64((1 << 64) - 1)


def _letters(strings: Sequence[str], width: int, pad: int) -> np.ndarray:
    """Code points, a row a string, filled up with pad."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.full((len(strings), width), pad, np.uint32)
    out[np.arange(width) < lens[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _dealt(lanes: list[tuple]) -> list[list[tuple]]:
    """Lanes (size, steps, ...) in parts of one size and of steps of much the same number."""
    parts: list[list[tuple]] = []
    for lane in sorted(lanes, key=lambda x: x[:2]):
        first = parts[-1][0] if parts else None
        if first and first[0] == lane[0] and lane[1] <= 1.25 * first[1] + 8 and len(parts[-1]) < LANES:
            parts[-1].append(lane)
        else:
            parts.append([lane])
    return parts


def _row_masks(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row the places of a that hold the letter c, as words of 64 bits."""
    return np.packbits(a == c[:, None], axis=1, bitorder="little").view(np.uint64)


def _lanes(a: Sequence[str], b: Sequence[str], words: int) -> np.ndarray:
    """Lengths of the longest common subsequences of a[k], of at most 64 * words letters, and b[k]."""
    held = _letters(a, 64 * words, 0xFFFFFFFF)  # neither filling is a code point, and they differ
    passed = np.ascontiguousarray(_letters(b, max(map(len, b)), 0xFFFFFFFE).T)
    row = np.full((words, len(a)), _ONES)
    letters, number = np.unique(passed, return_inverse=True)
    number = number.reshape(passed.shape)
    known = len(letters) <= min(len(passed), ALPHABET)  # the places of every letter are looked up once, or else those of each step
    if known:
        table = np.stack([_row_masks(held, np.full(len(a), c, np.uint32)).T for c in letters])
        lane = np.arange(len(a))
    for c, n in zip(passed, number, strict=True):
        u = table[n, :, lane].T & row if known else _row_masks(held, c).T & row
        total = row + u
        over = total < u
        while words > 1 and over[:-1].any():  # carries go on to the next word
            carry = over[:-1].astype(np.uint64)
            total[1:] += carry
            over[1:] = total[1:] < carry
            over[0] = False
        row = total | (row ^ u)
    return np.bitwise_count(~row).sum(axis=0, dtype=np.int64)


def lcs_many(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """lcs of each pair."""
    out, lanes = np.zeros(len(pairs), np.int64), []
    for k, (a, b) in enumerate(pairs):
        out[k], a, b = _trimmed(a, b)
        if not a:
            continue
        if len(b) <= 64:  # one word holds either: the shorter one is passed over
            lanes.append((1, len(a), k, b, a))
        elif len(a) <= 64 * WORDS and len(b) <= LETTERS:
            lanes.append((-(-len(a) // 64), len(b), k, a, b))
        else:
            out[k] += _bits(b, a, _places(b))
    for part in _dealt(lanes):
        _, _, at, held, passed = zip(*part, strict=True)
        if len(part) < FEW:
            out[list(at)] += [_bits(a, b, _places(a)) for a, b in zip(held, passed, strict=True)]
        else:
            out[list(at)] += _lanes(held, passed, part[0][0])
    return out


def ratios(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """ratio of each pair."""
    size = np.fromiter((len(a) + len(b) for a, b in pairs), np.int64, len(pairs))
    return np.where(size > 0, 2.0 * lcs_many(pairs) / np.maximum(size, 1), 1.0)


def _windows(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """_best_window of pairs whose a have one length of at most 64."""
    m, width = len(a[0]), max(map(len, b))
    held = _letters(a, 64, 0xFFFFFFFF)
    passed = _letters(b, width, 0xFFFFFFFE)
    ends = width + m - 1
    # No letter of a on either side of b, so that every window has m places.
    masks = np.zeros((len(a), ends + m - 1), np.uint64)
    for j in range(width):
        masks[:, m - 1 + j] = _row_masks(held, passed[:, j])[:, 0]
    row = np.full((len(a), ends), _ONES)
    for s in range(m):
        u = row & masks[:, s : s + ends]
        row = (row + u) | (row ^ u)
    end = np.arange(1, ends + 1)
    size = np.minimum(end, np.fromiter(map(len, b), np.int64, len(b))[:, None]) - np.maximum(0, end - m)
    return np.where(size > 0, 2.0 * np.bitwise_count(~row) / (m + np.maximum(size, 1)), 0.0).max(axis=1)


def partial_ratios(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """partial_ratio of each pair."""
    out, lanes = np.zeros(len(pairs)), []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if not a or len(a) > 64 or len(b) > 8 * 64 or a in b:
            out[k] = partial_ratio(a, b)
            continue
        lanes.append((len(a), len(b), k, a, b))
        if len(a) == len(b):
            lanes.append((len(a), len(b), k, b, a))
    for part in _dealt(lanes):
        _, _, at, a, b = zip(*part, strict=True)
        np.maximum.at(out, list(at), _windows(a, b))
    return out


def _sorted_words(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs]


def token_sort_ratios(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """token_sort_ratio of each pair."""
    return ratios(_sorted_words(pairs))


def token_set_ratios(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """token_set_ratio of each pair."""
    known = [_token_sets(a, b) for a, b in pairs]
    return np.maximum([k for k, _, _ in known], ratios([(a, b) for _, a, b in known])) if known else np.zeros(0)


#: The lowest n bits, for n up to 64.
_LOWEST = np.array([(1 << n) - 1 for n in range(65)], np.uint64)


def _jaro_winklers(a: Sequence[str], b: Sequence[str], weight: float = 0.1) -> np.ndarray:
    """jaro_winkler of pairs of strings that are not empty, those of b of at most 64 letters."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    held = _letters(b, 64, 0xFFFFFFFF)
    passed = _letters(a, max(4, max(map(len, a))), 0xFFFFFFFE)
    left, matched = np.full(len(a), _ONES), np.zeros(passed.shape, bool)
    for i in range(passed.shape[1]):
        window = _LOWEST[np.minimum(i + reach + 1, 64)] & ~_LOWEST[np.clip(i - reach, 0, 64)]
        u = _row_masks(held, passed[:, i])[:, 0] & left & window
        matched[:, i] = u != 0
        left ^= u & (~u + np.uint64(1))  # the first place
    used = np.unpackbits((~left).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    k = matched.sum(axis=1)
    # Either side lists the matched letters of a pair in their order, as many as the other does.
    swaps = np.bincount(np.repeat(np.arange(len(a)), k), passed[matched] != held[used], len(a)).astype(np.int64) // 2
    s = np.where(k > 0, (k / la + k / lb + (k - swaps) / np.maximum(k, 1)) / 3, 0.0)
    same = np.cumprod(passed[:, :4] == held[:, :4], axis=1).sum(axis=1)
    return np.where(s > 0.7, s + same * weight * (1 - s), s)


def jaro_winklers(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """jaro_winkler of each pair."""
    out, lanes = np.zeros(len(pairs)), []
    for k, (a, b) in enumerate(pairs):
        if not a or len(a) > 64 or not b or len(b) > 64:
            out[k] = jaro_winkler(a, b)
        else:
            lanes.append((1, len(a), k, a, b))
    for part in _dealt(lanes):
        _, _, at, a, b = zip(*part, strict=True)
        out[list(at)] = [jaro_winkler(x, y) for x, y in zip(a, b, strict=True)] if len(part) < FEW else _jaro_winklers(a, b)
    return out


_NAME = {"name_fuzz_ratio": ratios, "name_fuzz_partial_ratio": partial_ratios, "name_token_sort_ratio": token_sort_ratios, "name_token_set_ratio": token_set_ratios, "name_jaro_winkler": jaro_winklers}
_ADDRESS = {"addr_fuzz_ratio": ratios, "addr_token_sort_ratio": token_sort_ratios, "addr_token_set_ratio": token_set_ratios}
FIELDS = (*_NAME, *_ADDRESS)


def _of_column(first: pd.Series, second: pd.Series, functions: tuple) -> np.ndarray:
    """A row a pair: 0 where either is empty (null is empty), 1 where they are equal, or each function's value."""
    pairs = [(a or "", b or "") for a, b in zip(first, second, strict=True)]
    out = np.zeros((len(pairs), len(functions)))
    out[[k for k, (a, b) in enumerate(pairs) if a and a == b]] = 1.0
    at = [k for k, (a, b) in enumerate(pairs) if a and b and a != b]
    if at:
        unlike = [pairs[k] for k in at]
        out[at] = np.stack([f(unlike) for f in functions], axis=1)
    return out


def _udf(function):
    @F.pandas_udf(T.DoubleType())  # no text: workers import this without a session
    def similarity(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(_of_column(first, second, (function,))[:, 0])

    return similarity


_UDFS = {field: _udf(function) for field, function in (_NAME | _ADDRESS).items()}


def metrics(name1: Column, name2: Column, addr1: Column, addr2: Column) -> dict[str, Column]:
    """The eight similarities by field; an empty name gives equality, an empty address 0.

    Each is a column of its own, so that a query makes those alone that it asks for, and texts that
    no similarity is asked of never reach Python; all of one row still cross in one batch.
    """
    return {f: _UDFS[f](name1, name2) if f in _NAME else _UDFS[f](addr1, addr2) for f in FIELDS}
