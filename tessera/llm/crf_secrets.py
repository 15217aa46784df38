"""Secret scans: three fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans: ``assign`` (a named value), ``access`` (an access key id) and
``hex`` (a run of hex digits), in code points, leftmost and non-overlapping per kind.  The field
tags every blank-separated token as begin, inside or outside of a secret; its features are the
token's shape (classes of characters, length), the shapes and key words of the neighbouring
tokens, and a file feature (how much of the text is code-like).  What it tags and no base span
covers is added as kind ``crf``, in parts where base spans cut it.

The field is trained here, on the driver, by its conditional likelihood (forward-backward over
all lines at once, Adam, a square penalty) on ``TRAIN_LINES`` generated lines of prose, code and
configuration whose secrets are known; its weights, a fixed size, are broadcast.

Decoding is exact and skips nothing that could change: where a token's score for outside is
above its others by more than all transitions together, and the next token's turn from inside to
begin, could give back, every best path has it outside, so chains are cut there and only the rest
is decoded token by token.  Shapes and
scores are looked up for whole batches with numpy.

Defined cases: null or empty text has no spans; a text of any length is scanned whole; rows are
independent, so repeated rows give repeated results; ties in Viterbi go to outside.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")

TRAIN_LINES = 1200
STEPS = 80
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a run of 16 or more is the same match with and without the minimum: runs are maximal either way
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# --------------------------------------------------------------------------- features

#: Bits of a byte: lower, upper, digit, assignment sign, quote, dot or at, base64 or word joint, other ASCII.  Bytes of other characters have none.
_BIT = np.zeros(256, np.uint8)
for _chars, _bit in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 4), ("=:", 8), ("\"'`", 16), (".@,;!?()", 32), ("+/_-", 64), ("#$%&*<>[]{}\\|~^", 128)):
    for _c in _chars.encode():
        _BIT[_c] = _bit
_ALNUM = (_BIT & 7) > 0
_LENGTHS = np.array([1, 4, 8, 12, 16, 20, 28, 40, 64], np.int64)
N_SHAPES = 256 * (len(_LENGTHS) + 1) * 4
#: Words before a value that make it more likely a secret, as lower-case letters only.
KEYWORDS = ("key", "secret", "token", "password", "passwd", "pwd", "auth", "authorization", "bearer", "apikey", "credential", "credentials", "private")
N_FILE = 4
_SIZES = (len(_LENGTHS) + 1) * 4
#: Inside needs begin or inside before it.
ILLEGAL = -1e6


class Tokens:
    """Tokens of many texts: byte bounds, owners and shapes, all by numpy."""

    def __init__(self, blobs: list[bytes]):
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])
        raw = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.view(np.int8), [1]]).astype(np.int8)))
        self.raw, self.lo, self.hi = raw, edge[0::2], edge[1::2]
        n = len(self.lo)
        self.owner = np.searchsorted(self.first, self.lo, side="right") - 1
        if not n:
            self.shape = self.file = np.empty(0, np.int64)
            return
        bits = np.bitwise_or.reduceat(_BIT[raw], np.column_stack([self.lo, self.hi]).ravel())[::2]  # raw ends with a blank
        size = self.hi - self.lo
        digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
        share = (digits[self.hi] - digits[self.lo]) * 4 // np.maximum(size, 1)
        self.shape = (bits.astype(np.int64) * (len(_LENGTHS) + 1) + np.searchsorted(_LENGTHS, size, side="right")) * 4 + np.minimum(share, 3)
        code = np.bincount(self.owner, weights=(bits & (8 | 16 | 64 | 128)) > 0, minlength=len(blobs)) / np.maximum(np.bincount(self.owner, minlength=len(blobs)), 1)
        self.file = np.searchsorted([0.05, 0.2, 0.5], code)[self.owner]

    def keywords(self) -> np.ndarray:
        """For each token 1 + the index of the key word that its letters end with, or 0."""
        out = np.zeros(len(self.lo), np.int64)
        hits = [(m.start(), _KEY_AT[m[0]]) for m in _KEY.finditer(self.raw.tobytes().lower())]
        if hits:
            at, which = np.array(hits).T
            out[np.searchsorted(self.lo, at, side="right") - 1] = which
        return out


_KEY = re.compile(rb"(?:" + b"|".join(w.encode() for w in sorted(KEYWORDS, key=len, reverse=True)) + rb")(?=[^a-z\x20\x09-\x0d]*+[\x20\x09-\x0d])")
_KEY_AT = {w.encode(): i + 1 for i, w in enumerate(KEYWORDS)}


class Field:
    """Weights: own shape, length and digits, shapes before and after, key words one and two tokens before, file feature with classes of characters, transitions."""

    NAMES = ("own", "size", "prev", "next", "key1", "key2", "file", "step")

    def __init__(self):
        self.own, self.prev, self.next = (np.zeros((N_SHAPES + 1, 3)) for _ in range(3))
        self.size = np.zeros((_SIZES, 3))
        self.key1, self.key2 = (np.zeros((len(KEYWORDS) + 1, 3)) for _ in range(2))
        self.file = np.zeros((N_FILE * 256, 3))
        self.step = np.zeros((4, 3))  # from the 3 tags, or the start
        self.step[[OUT, 3], INSIDE] = ILLEGAL

    def score(self, t: Tokens, prev: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        return self.own[t.shape] + self.size[t.shape % _SIZES] + self.prev[prev] + self.next[nxt] + self.file[t.file * 256 + t.shape // _SIZES]


def _context(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Shapes before and after within the text (N_SHAPES at its ends)."""
    n = len(t.shape)
    prev, nxt = np.full(n, N_SHAPES), np.full(n, N_SHAPES)
    same = t.owner[1:] == t.owner[:-1]
    prev[1:][same], nxt[:-1][same] = t.shape[:-1][same], t.shape[1:][same]
    return prev, nxt


def _viterbi(e: np.ndarray, step: np.ndarray) -> list[int]:
    """The best tags of one chain that begins and ends outside or at a text's end."""
    score, back = e[0] + step[3], []
    for row in e[1:]:
        all_ = score[:, None] + step[:3]
        best = all_.argmax(0)  # the first on ties: outside
        back.append(best)
        score = all_[best, range(3)] + row
    tag = int(score.argmax())
    tags = [tag]
    for best in reversed(back):
        tag = int(best[tag])
        tags.append(tag)
    return tags[::-1]


def decode(f: Field, t: Tokens) -> np.ndarray:
    """Tags of all tokens."""
    n = len(t.shape)
    tags = np.zeros(n, np.int8)
    if not n:
        return tags
    e = f.score(t, *_context(t)) + (f.key1[0] + f.key2[0])
    key = np.flatnonzero(words := t.keywords())
    for d, table in ((1, f.key1), (2, f.key2)):
        after = key[key + d < n]
        after = after[t.owner[after + d] == t.owner[after]]
        e[after + d] += table[words[after]] - table[0]
    # The most that three transitions could give back: with a token, an inside after it has to turn to begin.
    legal = f.step[f.step > ILLEGAL / 2]
    slack = 3 * (legal.max() - legal.min())
    turn = np.zeros(n)
    turn[:-1] = np.where(t.owner[1:] == t.owner[:-1], np.maximum(e[1:, INSIDE] - e[1:, BEGIN], 0), 0)
    open_ = np.flatnonzero(e[:, 1:].max(1) + slack + turn >= e[:, 0])
    if not len(open_):
        return tags
    cut = np.flatnonzero((np.diff(open_) > 1) | (t.owner[open_[1:]] != t.owner[open_[:-1]])) + 1
    for run in np.split(open_, cut):
        lo, hi = int(run[0]), int(run[-1]) + 1
        left = lo > 0 and t.owner[lo - 1] == t.owner[lo]
        right = hi < n and t.owner[hi] == t.owner[lo]
        lo, hi = lo - left, hi + right
        part = e[lo:hi].copy()
        if left:  # fixed outside
            part[0, 1:] = -1e9
        if right:
            part[-1, 1:] = -1e9
        tags[lo:hi] = _viterbi(part, f.step)
    return tags


# --------------------------------------------------------------------------- training


def _line(rng: random.Random) -> tuple[list[str], list[int]]:
    """A generated line: tokens and their tags."""
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def run(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    def word() -> str:
        w = run(low + "éäñüçßóo", rng.choice([rng.randint(1, 12)] * 5 + [rng.randint(12, 40)]))
        shape = rng.random()
        w = w.upper() if shape < 0.08 else w.capitalize() if shape < 0.25 else w
        return w + rng.choice(["", "", "", "", "", ",", ".", "!!", "###", "%%%", "$$$", "***", "&&&"])

    def harmless() -> list[str]:
        return rng.choice([
            lambda: [".".join(str(rng.randint(0, 255)) for _ in range(4))],
            lambda: [f"{run(low, rng.randint(3, 9))}.{run(low + dig, rng.randint(2, 8))}@{run(low, 6)}{rng.randint(0, 9)}.example.com"],
            lambda: ["+1", f"({run(dig, 3)})", f"555-{run(dig, 4)}"],
            lambda: [run(dig, rng.choice([4, 8, 13, 16]))],
            lambda: [f"https://www.{run(low, 9)}.com/{run(low, 5)}/{run(low + dig, 7)}?page={rng.randint(1, 99)}"],
            lambda: [f"{run(low, 6)}_{run(low, 7)}_{run(low, 5)}", "=", str(rng.randint(0, 999)) + ";"],
            lambda: [f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:00Z"],
            lambda: [f"{run(low, 8)}{rng.choice('-_/')}{run(low, 9)}{rng.choice('-_/')}{run(low, 8)}"],
            lambda: [run(low, rng.randint(16, 40)) + rng.choice(["", ".", ","])],
            lambda: ["".join(run(low, rng.randint(2, 7)).capitalize() for _ in range(rng.randint(3, 5)))],
            lambda: ["|"], lambda: [rng.choice(["key", "token", "password", "secret"]), word()],
            lambda: [f"<{run(low, 3)}", f'{run(low, 5)}="{run(low, 9)}">'], lambda: [f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"],
        ])()

    def secret() -> tuple[list[str], list[int]]:
        value = rng.choice([
            lambda: "ghp_" + run(low + up + dig, 36), lambda: "sk_live_" + run(low + up + dig, 24), lambda: "xoxb-" + run(dig, 12) + "-" + run(low + up + dig, 24),
            lambda: "eyJ" + run(low + up + dig, 30) + "." + run(low + up + dig + "-_", 60) + "." + run(low + up + dig + "-_", 43),
            lambda: run(low + up + dig + "+/", rng.choice([32, 40, 44])), lambda: run(low + up + dig, rng.choice([24, 32, 40])), lambda: "AIza" + run(low + up + dig + "-_", 35),
        ])()
        before = rng.choice([[], [], ["Authorization:", "Bearer"], ["private", "key"], ["credentials:"], ["auth", "="]])
        q = rng.choice(["", '"', "'"])
        after = rng.choice(["", "", ",", ";"])
        return [*before, q + value + q + after], [0] * len(before) + [BEGIN]

    def block() -> tuple[list[str], list[int]]:
        rows = [run(low + up + dig + "+/", 64) for _ in range(rng.randint(2, 6))] + [run(low + up + dig + "+/", rng.randint(20, 60)) + "=="]
        return ["-----BEGIN", "PRIVATE", "KEY-----", *rows, "-----END", "PRIVATE", "KEY-----"], [0, 0, 0, BEGIN, *[INSIDE] * (len(rows) - 1), 0, 0, 0]

    words, tags = [], []
    for _ in range(rng.randint(1, 8)):
        for _ in range(rng.randint(0, 12)):
            words.append(word())
            tags.append(OUT)
        kind = rng.random()
        w, g = (harmless(), None) if kind < 0.6 else secret() if kind < 0.75 else block() if kind < 0.8 else ([], [])
        words += w
        tags += g if g is not None else [OUT] * len(w)
    return (words, tags) if words else ([word()], [OUT])


def _marginals(e: np.ndarray, step: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag marginals (lines, tokens, 3) and summed transition marginals (4, 3) of padded chains of n tokens."""
    lines, most, _ = e.shape

    def lse(x: np.ndarray) -> np.ndarray:
        top = x.max(1, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]

    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[:, 0] = e[:, 0] + step[3]
    for i in range(1, most):
        fwd[:, i] = lse(fwd[:, i - 1, :, None] + step[None, :3]) + e[:, i]
    for i in range(most - 2, -1, -1):
        new = lse((step[:3].T[None] + (e[:, i + 1] + bwd[:, i + 1])[:, :, None]))
        bwd[:, i] = np.where((i + 1 < n)[:, None], new, 0)
    both = fwd + bwd
    z = lse(fwd[np.arange(lines), n - 1][:, :, None])[:, 0]
    tags = np.exp(both - z[:, None, None])
    moves = np.zeros((4, 3))
    moves[3] = tags[:, 0].sum(0)
    for i in range(1, most):
        on = i < n
        moves[:3] += np.exp(fwd[on, i - 1, :, None] + step[None, :3] + (e[on, i] + bwd[on, i])[:, None, :] - z[on, None, None]).sum(0)
    return tags, moves


@functools.cache
def trained(lines: int = TRAIN_LINES, steps: int = STEPS, seed: int = 7, penalty: float = 0.02, rate: float = 0.15) -> Field:
    """The field that fits the generated lines; the same in every process."""
    rng = random.Random(seed)
    data = [_line(rng) for _ in range(lines)]
    t = Tokens([" ".join(w).encode() for w, _ in data])
    prev, nxt = _context(t)
    gold = np.concatenate([g for _, g in data])
    n = np.array([len(g) for _, g in data])
    row, col = t.owner, np.arange(len(gold)) - np.repeat(np.cumsum(n) - n, n)
    key = t.keywords()
    k1, k2 = np.zeros_like(key), np.zeros_like(key)
    k1[1:], k2[2:] = np.where(col[1:] >= 1, key[:-1], 0), np.where(col[2:] >= 2, key[:-2], 0)
    at = {"own": t.shape, "size": t.shape % _SIZES, "prev": prev, "next": nxt, "key1": k1, "key2": k2, "file": t.file * 256 + t.shape // _SIZES}
    moved = np.zeros((4, 3))
    np.add.at(moved, (np.where(col > 0, np.concatenate([[3], gold[:-1]]), 3), gold), 1)
    f = Field()
    m, v = {k: np.zeros_like(getattr(f, k)) for k in f.NAMES}, {k: np.zeros_like(getattr(f, k)) for k in f.NAMES}
    e = np.zeros((lines, n.max(), 3))
    truth = np.eye(3)[gold]
    for i in range(1, steps + 1):
        e[row, col] = f.score(t, prev, nxt) + f.key1[k1] + f.key2[k2]
        tags, moves = _marginals(e, f.step, n)
        error = truth - tags[row, col]
        for k in f.NAMES:
            w = getattr(f, k)
            if k == "step":
                g = moved - moves
                g[[OUT, 3], INSIDE] = 0
            else:
                g = np.stack([np.bincount(at[k], weights=error[:, c], minlength=len(w)) for c in range(3)], 1)
            g = g - penalty * np.where(w > ILLEGAL / 2, w, 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w += rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        f.step[[OUT, 3], INSIDE] = ILLEGAL
    return f


# --------------------------------------------------------------------------- operator


def scan(texts: list[str], f: Field | None = None) -> list[list[tuple[int, int, int]]]:
    """All spans of each text as (start, kind, end), ascending."""
    f = f or trained()
    base = [base_spans(x) for x in texts]
    out = [list(x) for x in base]
    blobs = [x.encode("utf-8", "surrogatepass") for x in texts]
    t = Tokens(blobs)
    tags = decode(f, t)
    hit = np.flatnonzero(tags)
    i = 0
    while i < len(hit):
        j = i
        while j + 1 < len(hit) and hit[j + 1] == hit[j] + 1 and tags[hit[j + 1]] == INSIDE:
            j += 1
        k = int(t.owner[hit[i]])
        blob, at = blobs[k], int(t.first[k])
        lo, hi = int(t.lo[hit[i]]) - at, int(t.hi[hit[j]]) - at
        start = len(blob[:lo].decode("utf-8", "surrogatepass"))
        end = start + len(blob[lo:hi].decode("utf-8", "surrogatepass"))
        out[k] += [(s, 3, e) for s, e in _uncovered(texts[k], start, end, base[k])]
        i = j + 1
    return [sorted(x) for x in out]


def _uncovered(text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no base span covers, trimmed."""
    parts = []
    for s, _, e in base:
        if s >= end:
            break
        if s > start:
            parts.append((start, s))
        start = max(start, e)
    trimmed = (_trim(text, s, e) for s, e in [*parts, (start, end)])
    return [(s, e) for s, e in trimmed if e > s]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the quotes, marks and blanks around a value."""
    while start < end and text[start] in "\"'`([{< \t\n\v\f\r":
        start += 1
    while start < end and text[end - 1] in "\"'`)]}>.,;:!? \t\n\v\f\r":
        end -= 1
    return start, end


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_rows(docs: DataFrame, fields: str, row, keep: tuple[str, ...] = ()) -> DataFrame:
    """row(text, spans) -> the values of fields for every row, beside the columns named in keep."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("_text"), *[F.col(c).alias(f"_kept_{c}") for c in keep])
    kept = rows.columns[1:]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [fields])
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        import pyarrow as pa

        from .langmask import _parts

        kinds = {"long": pa.int64(), "string": pa.string()}
        names = [x.split() for x in fields.split(", ")]
        f = shared.value
        for whole in batches:
            C.release()
            for batch in _parts(whole):
                texts = batch.column("_text").to_pylist()
                made = [row(x, s) for x, s in zip(texts, scan(texts, f), strict=True)]
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names, strict=True)]], names=[*kept, *[n for n, _ in names]])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_kept_{c}").alias(c) for c in keep], *[x.split()[0] for x in fields.split(", ")])


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The spans of every row: ``spans`` as kind:start:end, comma-joined."""
    return scan_rows(docs, "spans string", lambda _, s: (joined(s),), keep)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by [secret]; n_chars follows where there is such a column.  A null text stays null."""
    keep = tuple(c for c in docs.columns if c != "text")
    out = scan_rows(docs.withColumn("_was_null", F.col("text").isNull()), "text string, n_spans long", lambda x, s: (redacted(x, s), len(s)), (*keep, "_was_null"))
    out = out.withColumn("text", F.when(~F.col("_was_null"), F.col("text")))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(F.col("n_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    def row(_, spans):
        base = [x for x in spans if x[1] < 3]
        return (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    return scan_rows(docs, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", row, ("doc_id",))
