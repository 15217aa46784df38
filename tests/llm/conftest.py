import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, node string"

BASE = "the cat sat on the mat while a dog slept under the old oak tree near the river bank and dreamed of bones"


def rows(*texts, first=1):
    """Documents with clashing extra columns."""
    return [(first + k, t, "en", f"s{k % 3}", None if t is None else len(t), "x", None) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    return lambda data: spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    data = rows(None, "", "   \t\n", "a", BASE, BASE, "ünïcödé ß 漢字 😀 text", long, long + " end", "x" * 5000)
    data += [data[4], (None, BASE, None, None, None, None, None), (None, None, None, None, None, None, None), (4, "another text under a repeated id", "fr", None, 3, None, "n")]
    return make(data)


@pytest.fixture(scope="session")
def empty(make):
    return make([])


def sentences(n: int, seed: int = 0, words: int = 400, length: tuple[int, int] = (1, 60)) -> list[str]:
    rng = random.Random(seed)
    bag = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    return [" ".join(rng.choice(bag) for _ in range(rng.randint(*length))) for _ in range(n)]
