import random

import pytest

from tessera.operators import evaluation as A
from tessera.operators import pairs as L


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = [(f"a{k}", f"b{k}", int(rng.random() < 0.3), rng.choice([rng.random(), 0.5, 0.02, 0.975, 0.3])) for k in range(400)]
    return rows, spark.createDataFrame(rows, "s1_id string, cand_id string, label int, prob double")


def test_threshold_sweep_equals_a_loop(scored):
    rows, df = scored
    got = {round(r.threshold * 1000): r for r in A.threshold_sweep(df).collect()}
    assert sorted(got) == list(range(20, 980, 5))
    best = (0.0, 0.5)
    for k in sorted(got):
        t = k / 1000
        tp, fp, fn = (sum(cond(p >= t, y) for _, _, y, p in rows) for cond in (lambda h, y: h and y, lambda h, y: h and not y, lambda h, y: not h and y))
        assert (got[k].tp, got[k].fp, got[k].fn) == (tp, fp, fn)
        p, r = tp / (tp + fp) if tp + fp else 0, tp / (tp + fn)
        f = 1.25 * p * r / (0.25 * p + r) if p + r else 0
        assert got[k].f05 == pytest.approx(f)
        best = max(best, (f, -t)) if f > 0 else best
    (b,) = A.best_threshold(df).collect()
    assert (b.f05, b.threshold) == pytest.approx((best[0], -best[1]))


def test_average_precision_is_the_step_sum(scored, spark):
    rows, df = scored
    total, out, seen, tp = sum(r[2] for r in rows), 0.0, 0, 0
    for score in sorted({r[3] for r in rows}, reverse=True):
        here = [r[2] for r in rows if r[3] == score]
        seen, tp = seen + len(here), tp + sum(here)
        out += sum(here) / total * tp / seen
    assert A.average_precision(df).first()[0] == pytest.approx(out)
    assert A.average_precision(df.where("label = 0")).first()[0] == 0
    assert tuple(A.best_threshold(df.where("label = 0")).first()) == (0.5, 0.0)


def test_confusion_without_division_by_zero(spark):
    df = spark.createDataFrame([(0, 0.1)], "label int, prob double")
    (r,) = A.confusion(df, 0.5).collect()
    assert (r.tp, r.tn, r.precision, r.recall, r.f1, r.f05) == (0, 1, 0, 0, 0, 0)


def test_split_and_sample_sizes(spark):
    ids = spark.createDataFrame([(f"S1-{k}",) for k in range(501)], "s1_id string")
    split = {r.s1_id: r.is_train for r in L.group_split(ids.union(ids)).collect()}
    assert len(split) == 501 and sum(split.values()) == 400
    assert split == {r.s1_id: r.is_train for r in L.group_split(ids.repartition(5)).collect()}
    pairs = spark.createDataFrame([(f"a{k}", f"b{k}", int(k < 7)) for k in range(300)], "s1_id string, cand_id string, label int")
    got = L.subsample_negatives(pairs, 10).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {1: 7, 0: 70}
    assert L.subsample_negatives(pairs, None).count() == 300 and L.subsample_negatives(pairs.where("label = 1"), 10).count() == 7


def test_truth_parsing(spark):
    df = spark.createDataFrame([("S1-1", " S2-1 ,,S3-2 ,"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, L.parse_truth(df).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
