"""The five decisions of the pipeline in plain Python, for small tables.

Rows are tuples (doc_id, text, lang, source, n_chars, ...).  Of the operators only the trained field's
weights and features are used; patterns, decoding, sets, windows and shares are written out here.
"""

import collections
import hashlib
import math
import re
import unicodedata

import numpy as np

from tessera.llm import crf_secrets as S

from .test_decontam import brute as leaks
from .test_mixing import fill
from .test_trie_join import shingles


def language(rows):
    """With labelled rows in training, only texts without a letter are undecided."""
    return [r for r in rows if any(unicodedata.category(c)[0] == "L" for c in r[1] or "")]


def near_duplicates(rows):
    rows = [*dict.fromkeys(r for r in rows if shingles(r[1] or ""))] + [r for r in rows if not shingles(r[1] or "")]
    sets = [shingles(r[1] or "") for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        first.setdefault(group[k], k)
    return [rows[k] for k in sorted(first.values())]


def decontaminate(rows, items):
    return [r for k, r in enumerate(rows) if not leaks([(k, r[1] or "")], items)]


def _tags(f, text):
    """Whole chains, token by token: no cut and no batch."""
    t = S.Tokens([text.encode()])
    n = len(t.shape)
    if not n:
        return [], t
    key = t.keywords().tolist()
    e = f.score(t, *S._context(t)) + f.key1[[0, *key][:n]] + f.key2[[0, 0, *key][:n]]
    best = [[(float(e[0][c] + f.step[3][c]), [c]) for c in range(3)]]
    for i in range(1, n):
        best.append([max(((p + f.step[c][d] + e[i][d], -c, [*path, d]) for c, (p, path) in enumerate(best[-1])), key=lambda x: x[:2])[::2] for d in range(3)])
    return max(best[-1], key=lambda x: (x[0], -x[1][-1]))[1], t


def redact(text, f):
    base = [(m.start(), m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    base += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    covered = {k for a, b in base for k in range(a, b)}
    tags, t = _tags(f, text)
    spans, k = list(base), 0
    while k < len(tags):
        if tags[k] == S.OUT:
            k += 1
            continue
        j = k
        while j + 1 < len(tags) and tags[j + 1] == S.INSIDE:
            j += 1
        lo, hi = (len(text.encode()[: int(x)].decode()) for x in (t.lo[k], t.hi[j]))
        free = [p for p in range(lo, hi) if p not in covered]
        for part in np.split(np.array(free), np.flatnonzero(np.diff(free) > 1) + 1) if free else []:
            a, b = int(part[0]), int(part[-1]) + 1
            while a < b and text[a] in "\"'`([{< \t\n\v\f\r":
                a += 1
            while a < b and text[b - 1] in "\"'`)]}>.,;:!? \t\n\v\f\r":
                b -= 1
            spans += [(a, b)] if b > a else []
        k = j + 1
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secrets(rows):
    f, out = S.trained(), []
    for i, text, lang, source, n_chars, *more in rows:
        new = text if text is None else redact(text, f)
        out.append((i, new, lang, source, n_chars if new == text else len(new), *more))
    return out


def mixture(rows):
    sizes = collections.Counter()
    size = lambda r: len((r[1] or "").encode().split())
    for r in rows:
        sizes[r[3]] += size(r)
    target, out = fill(dict(sizes)), []
    for r in rows:
        rate = target[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        draw = int(hashlib.md5(f"mix-1:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    return out


def run(rows, items):
    return mixture(secrets(decontaminate(near_duplicates(language(rows)), items)))
