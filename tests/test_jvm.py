"""Similarities of whole texts in the JVM are those of Python, and in rounds no address goes to Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import jvm as J
from tessera.functions import strings as S
from tessera.operators import features as X


def some_pairs():
    rng = random.Random(2)
    bag = ["".join(rng.choice("abcdeé漢😀！12٣") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    string = lambda most: " ".join(rng.choice(bag) for _ in range(rng.randint(0, most)))
    out = [("", ""), ("", "a"), ("a", ""), ("a", "a"), ("a b", "b a"), ("x" * 64, "x" * 65), ("a b c", "a b"), ("12 a 12", "12 b")]
    for _ in range(40):
        a = string(rng.choice([1, 3, 20, 200]))
        out += [(a, " ".join(rng.choice([string(1), string(12), string(100), string(300), a, a + " x", a[: len(a) // 2]]).split())) for _ in range(rng.randint(1, 9))]
    many = " ".join(f"w{k}" for k in range(0x6000 + 9))  # numbers of words that take two letters
    return [*out, ("w1 w24577 zz", many), ("w1 w24577 zz", "w2 zz")]


def plain(pairs):
    ratios = S._of_column([a for a, _ in pairs], [b for _, b in pairs], (S.ratios, S.token_sort_ratios, S.token_set_ratios)).tolist()
    for (a, b), values in zip(pairs, ratios, strict=True):
        x, y = set(a.split()), set(b.split())
        n, m = ({w for w in z if w.isdecimal()} for z in (x, y))
        yield (*values, len(x), len(y), len(x & y), len(n), len(m), len(n & m))


@pytest.mark.parametrize("vectors", [True, False])
def test_values_are_those_of_python(spark, monkeypatch, vectors):
    if not vectors:
        monkeypatch.delattr(spark.sparkContext, "_tessera_jar", raising=False)
        compiled = J._compiled
        monkeypatch.setattr(J, "_compiled", lambda jvm, _: compiled(jvm, False))
    pairs = some_pairs()
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").coalesce(2)
    got = dict((r[0], tuple(r)[1:]) for r in J.likeness(J.packed(J.packed(df, "a"), "b"), "a", "b").collect())
    assert [got[k] for k in range(len(pairs))] == list(plain(pairs))


def test_rounds_take_no_address_to_python(spark, monkeypatch):
    from tessera.functions import text as T

    rows = [("S1-1", "Apex Technology", "123 Main Street", "US"), ("S2-1", "Apex Technlogy", "9 Elm Way", "US")]
    pre = T.preprocess(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"))
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string")
    plans, write = [], X.saved
    monkeypatch.setattr(X, "saved", lambda *parts: plans.append(parts[-1]._jdf.queryExecution().optimizedPlan().toString()) or write(*parts))
    made = X.features_in_rounds(pairs, pre, pre)
    python = [x for x in plans[-1].splitlines() if "similarity(" in x and "EvalPython" in x]
    assert len(python) == 1 and python[0].count("similarity(") == 5 and "addr_normalized" not in python[0]
    want = X.features(X.paired(pairs, pre, pre)).select(*made.columns)
    assert made.collect() == want.collect() and made.where(F.col("addr_fuzz_ratio") > 0).count() == 1
