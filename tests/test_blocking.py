import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocking as B
from tessera.operators import evaluation as A
from tessera.operators import keys as K

SCHEMA = "entity_id string, business_name string, business_address string, country string"
TARGETS = [
    ("S2-001", "Zephay Labs Inc", "2621 Cotten Road, Tyler, TX", "US"), ("S2-002", "Brahma Infosoft Pvt Ltd", "Coimbatore Colony, Hunsur, Mysore, Karnataka", "India"),
    ("S2-003", "Marina Ecole France Sarl", "63 R. DE DIEPPE, LILLE, Hauts-de-France", "France"), ("S2-004", "एसएस फूड", "AF 684 Nandgram Near Mother India School, Ghaziabad", "India"),
    ("S2-005", "मॉडर्न फाइनेंस प्राइवेट लिमिटेड", "", "India"), ("S2-006", "Generic Retail Store", "", "US"), ("S2-007", "Apple Inc", "1 Infinite Loop, Cupertino, CA", "US"),
    ("S2-008", "Dahlia Ponr Reliable Scientific", "630 45th Ter, Kansas City, MO", "US"),
]


@pytest.fixture(scope="module")
def look(spark):
    def run(queries, targets=None, options=B.Options(max_candidates=10), limits=K.Limits()):
        q = [(f"S1-{k}", *r) for k, r in enumerate(queries)]
        pre = lambda rows: T.preprocess(spark.createDataFrame(rows, SCHEMA))
        out = {}
        for r in B.candidates(pre(q), pre(targets or TARGETS), "S2", options, limits).orderBy("source1_entity_id", "rn").collect():
            out.setdefault(int(r.source1_entity_id[3:]), []).append((r.candidate_entity_id, r.blocking_methods, r.score))
        return out

    return run


def test_links(look):
    got = look([
        ("Zephay Labs Corporation", "Tyler, Texas", "US"), ("Brahma Infosoft Technologies", "", "India"), ("Dahlia Power Solutions", "", "US"), ("SS Food Company", "Plot 12, Nandgram, Ghaziabad, UP", "India"),
        ("Unrelated Something", "", "US"), ("", "Cupertino, CA", "US"), ("Brahma Infosoft", "", "US"), ("Marina École France", "", "France"), ("मॉडर्न फाइनेंस", "", "India"), TARGETS[0][1:],
    ])
    has = lambda k, target, method=None: any(c == target and (method is None or method in m) for c, m, _ in got.get(k, []))
    assert has(0, "S2-001", "exact_name") and has(1, "S2-002", "name_token") and has(2, "S2-008") and has(3, "S2-004", "addr_token")
    assert 4 not in got and not any("exact_name" in m for _, m, _ in got.get(5, []))
    assert not has(6, "S2-002") and has(7, "S2-003", "exact_name") and has(8, "S2-005")
    assert len(got[9]) == 1 and {"exact_name", "name_token", "addr_token"} <= set(got[9][0][1])


def test_pruning_caps_and_other_passes(look, spark):
    many = [(f"S2-{k}", f"Universal Venture {k}", "", "US") for k in range(5)]
    got = look([("Universal Trading", "", "US")], many, options=B.Options(passes=(K.NAME,)), limits=K.Limits(name=2))
    assert got == {}
    assert len(look([("Universal Venture", "", "US")], many, B.Options(max_candidates=2))[0]) == 2
    assert "sorted_name" in look([("Kumar Rajesh Trading", "", "India")], [("S2-1", "Rajesh Kumar Trading Co", "", "India")])[0][0][1]
    apex = [("S2-1", "Apex Global Healthcare Enterprises", "", "US"), ("S2-2", "Apex Other", "", "US"), ("S2-3", "Global Other", "", "US")]
    got = look([("Apex Global Solutions LLC", "", "US")], apex, limits=K.Limits(name=1))
    assert [c for c, m, _ in got[0] if "name_bigram" in m] == ["S2-1"]
    assert "addr_token" in look([("X Y", "729 Cr 11, Tiffin, OH", "US")], [("S2-9", "Other", "729 CR 11, Clinton, OH", "US")])[0][0][1]


def test_repeated_tokens_count_twice(look):
    """Frequencies and scores are of rows under a key, not of records."""
    got = look([("Alpha Alpha", "", "US")], [("S2-1", "Alpha Alpha Beta", "", "US")], options=B.Options(passes=(K.NAME,)))
    assert got[0] == [("S2-1", ["name_token"], 4 * (35 - 1))]
    assert look([("Alpha Alpha", "", "US")], [("S2-1", "Alpha Alpha Beta", "", "US")], B.Options(passes=(K.NAME,)), K.Limits(name=1)) == {}


def test_recall_and_losses(spark):
    pre = lambda rows: T.preprocess(spark.createDataFrame(rows, SCHEMA))
    q = pre([("S1-1", "Omega Robotics Corp", "", "US")])
    pairs = B.merged(B.hits(q, pre([("S2-1", "Omega Robotics Inc", "", "US"), ("S2-2", "Omega Robotics Labs", "", "US")])))
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], "s1_id string, cand_id string")
    (r,) = A.recall(truth, pairs, (1,)).collect()
    assert (r.total, r.retrieved, r.lost_to_cap, r.lost_to_blocking, r.recall_pct, r.uncapped_recall_pct) == (2, 1, 1, 0, 50.0, 100.0)


def test_scores_are_whole_and_exact(spark):
    import math

    rows = [(p, 0, df) for p in (K.BIGRAM, K.NAME, K.ADDRESS) for df in (1, 2, 3, 4, 5, 8, 9, 255, 256, 257, 500)]
    got = spark.createDataFrame(rows, "pass string, base int, df long").withColumn("s", B.score()).collect()
    for r in got:
        least, most = B.SCORES[r["pass"]]
        assert r.s == max(least, most - math.ceil(math.log2(max(2, r.df))))


def test_sorted_names_are_cut_and_not_dropped(spark):
    rows = [(f"S2-{k}", "Beta Alpha" if k % 2 else "Alpha Beta", "", "US") for k in range(6)]
    keys = K.target_keys(T.preprocess(spark.createDataFrame(rows, SCHEMA)), limits := K.Limits(block=4))
    kept = K.first_of_sorted(keys, limits).where(F.col("pass") == K.SORTED)
    assert sorted(r.entity_id for r in kept.collect()) == ["S2-0", "S2-1", "S2-2", "S2-3"]
    assert K.document_frequencies(keys, limits).where(F.col("pass") == K.SORTED).first().df == 4


def test_a_filter_of_keys_loses_no_wanted_row(spark):
    keys = spark.range(4000).selectExpr(f"'{K.NAME}' AS pass", "if(id % 2 = 0, 'US', 'India') AS country", "concat('k', id) AS key", "id")
    rows, wanted = keys.unionByName(keys), keys.where("id % 100 = 7").drop("id")
    left = K.likely(rows, wanted)
    assert left.columns == rows.columns and left.join(wanted, list(K.KEY), "left_semi").count() == 80
    assert left.count() < 2000
    assert K.likely(rows, wanted.limit(0)).count() == 0
    assert sorted(r.id for r in K.joined(rows, wanted).collect()) == sorted(2 * list(range(7, 4000, 100)))


def test_no_address_goes_along_with_keys_of_names(spark):
    pre = T.preprocess(spark.createDataFrame(TARGETS, SCHEMA))
    for keys in (K.target_keys(pre), B.probe_keys(pre)):
        plan = keys._jdf.queryExecution().optimizedPlan().toString().splitlines()
        families = [x for x in plan if "Generate" in x and "name_token" in x]
        assert families and not any("addr_tokens" in x or K.ADDRESS in x for x in families)


def test_ranks_by_bits_are_those_by_names(spark):
    rows = [("a", f"c{k}{n}", p, 10) for k, passes in enumerate([(p,) for p in K.PASSES] + [(p, q) for p in K.PASSES for q in K.PASSES if p < q]) for p in passes for n in range(2)]
    hits = spark.createDataFrame(rows, "s1_id string, cand_id string, pass string, score long")
    named, bits = B.ranked(B.merged(hits)), B.ranked(B.merged(hits, named=False))
    got = bits.select("s1_id", "cand_id", "score", B.passes_of("mask").alias("methods"), "rn")
    assert sorted(map(str, got.collect())) == sorted(map(str, named.collect())) and got.count() == 56
