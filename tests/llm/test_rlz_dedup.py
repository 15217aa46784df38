import hashlib
import random

import duckdb
import pandas as pd
import pytest

from tessera.llm import rlz_dedup as R

from .conftest import rows, sentences


def brute(data, window=R.WINDOW):
    first = {}
    words = [(i, t.encode().split()) for i, t in data]
    big = float("inf")
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if i is None else i):
                gone |= set(range(k, k + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=repr)


def overlapping(seed):
    rng, base = random.Random(seed), sentences(12, seed, length=(20, 90))
    texts = []
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(base).split()
            lo = rng.randint(0, len(w) - 1)
            parts.append(" ".join(w[lo : lo + rng.randint(5, 40)]))
        texts.append((" \n".join(parts)) + rng.choice(["", " ", "\t"]))
    return texts


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
@pytest.mark.parametrize("seed", [1, 2])
def test_removed_words_equal_brute_force(spark, make, seed, block_bytes):
    texts = overlapping(seed)

    def made(i, words, factors):
        left = R.kept(words, factors)
        return {"doc_id": i, "n_words": len(words), "n_removed": len(words) - len(left), "sha": hashlib.sha256(b" ".join(left)).hexdigest()}

    got = R.references(spark, make(rows(*texts)), made, "doc_id long, n_words long, n_removed long, sha string", block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(k + 1, t) for k, t in enumerate(texts)])


def test_odd_rows(spark, odd, empty):
    data = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:4] for r in R.query(spark, odd).collect()), key=repr) == brute(data)
    assert R.query(spark, empty).collect() == []


def test_factors_name_their_reference(spark, make):
    passage = " ".join(f"p{k}" for k in range(20))
    got = sorted(R.dedup(spark, make(rows("start " + passage, "x y " + passage + " z", passage))).collect())
    assert [(r.text, r.factors) for r in got] == [("start " + passage, ""), ("x y z", "2:22:1"), ("", "0:20:1")]
    # a chain of overlapping windows of two references leaves nothing at their boundary
    one, two = " ".join(f"a{k}" for k in range(13)) + " b0", " ".join(f"a{k}" for k in range(1, 13)) + " b0 b1"
    got = sorted(R.dedup(spark, make(rows(one, two, " ".join(f"a{k}" for k in range(13)) + " b0 b1"))).collect())
    assert got[2].text == "" and got[2].factors == "0:14:1,2:15:2"


def test_negative_and_huge_ids(spark, make):
    p = " ".join(f"p{k}" for k in range(13))
    data = [(i, p, None, None, None, None, None) for i in (-(1 << 62), 5, (1 << 62), -7)]
    assert sorted((tuple(r)[:4] for r in R.query(spark, make(data)).collect()), key=repr) == brute([(r[0], p) for r in data])


def test_sql_equals_brute_force():
    """The SQL beside the query is held against plain Python, apart from the operator."""
    data = list(enumerate(overlapping(3) + ["", "a", " \t\n", None], 1))
    documents = pd.DataFrame(data, columns=["doc_id", "text"])
    db = duckdb.connect()
    db.register("documents", documents)
    got = db.execute(R.SQL).fetchall()
    assert sorted((r[:4] for r in got), key=repr) == brute([(i, t or "") for i, t in data])


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    df = R.query(spark, spark.read.parquet(path))
    assert sorted(map(tuple, df.collect())) == sorted(db.execute(R.SQL).fetchall())
