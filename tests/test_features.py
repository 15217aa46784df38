import pytest

from tessera.functions import text as T
from tessera.operators import features as X

SCHEMA = "entity_id string, business_name string, business_address string, country string"
BASE = ("S1-1", "Apex Technology Solutions Inc", "123 Main Street, Suite 400, Seattle, WA", "US")


@pytest.fixture(scope="module")
def feats(spark):
    def run(base, others, methods=None, score=0):
        pre = lambda rows: T.preprocess(spark.createDataFrame(rows, SCHEMA))
        rows = [(base[0], f"S2-{k}", methods, score) for k in range(len(others))]
        pairs = spark.createDataFrame(rows, "s1_id string, cand_id string, methods array<string>, score long")
        out = X.features(X.paired(pairs, pre([base]), pre([(f"S2-{k}", *o) for k, o in enumerate(others)])))
        return [r.asDict() for r in out.orderBy("cand_id").collect()]

    return run


def test_the_list_is_complete_and_names_no_id(feats):
    (r,) = feats(BASE, [BASE[1:]])
    assert len(X.NAMES) == 45 and set(X.NAMES) <= set(r)
    assert not any("entity_id" in n or "id" in n.split("_") for n in X.NAMES)
    assert r["name_exact_norm"] == r["name_exact_cons"] == r["name_fuzz_ratio"] == r["country_match"] == r["addr_exact_norm"] == 1.0


def test_names_and_legal_forms(feats):
    typo, corp, full = feats(BASE, [("Apex Technlogy Solutns Inc", "", "US"), ("Apex Technology Solutions Corporation", "", "US"), ("Apex Technology Solutions Incorporated", "", "US")])
    assert typo["name_exact_norm"] == 0 and typo["name_fuzz_ratio"] > 0.85 and typo["name_jaro_winkler"] > 0.9
    assert (corp["suffix_mismatch"], corp["suffix_exact_match"], full["suffix_exact_match"]) == (1, 0, 1)
    (r,) = feats(("S1-1", "Kumar Rajesh Enterprises", "", "India"), [("Rajesh Kumar Enterprises", "", "India")])
    assert r["name_sorted_token_equal"] == r["name_token_sort_ratio"] == r["name_token_set_ratio"] == 1.0


def test_addresses(feats):
    (r,) = feats(("S1-1", "A B", "", "US"), [("A B", None, "US")])
    assert r["addr_s1_empty"] == r["addr_cand_empty"] == r["addr_either_empty"] == r["addr_both_empty"] == 1
    assert r["addr_fuzz_ratio"] == r["addr_token_jaccard"] == r["addr_exact_norm"] == 0
    (r,) = feats(("S1-1", "A B", "Shop 314, 2nd Floor, Brigade Road, Bengaluru", "India"), [("A B", "314 Brigade Road", "India")])
    assert r["addr_numeric_shared_count"] >= 1 and r["addr_numeric_jaccard"] >= 0.5
    (r,) = feats(BASE, [(BASE[1], "9 Elm Way, Boston, MA", "US")])
    assert r["name_match_addr_conflict"] == 1 and r["name_addr_high_agreement"] == 0


def test_provenance(feats):
    (r,) = feats(BASE, [BASE[1:]], ["exact_name", "name_token", "addr_token"], 145)
    assert (r["prov_exact_name"], r["prov_name_bigram"], r["prov_num_passes"]) == (1, 0, 3) and r["prov_blocking_score"] == pytest.approx(145 / 150)
    (r,) = feats(BASE, [BASE[1:]])
    assert r["prov_num_passes"] == 5 and r["prov_blocking_score"] == r["name_fuzz_ratio"] and r["prov_exact_conservative"] == 1
    (r,) = feats(BASE, [BASE[1:]], [], 0)
    assert r["prov_num_passes"] == r["prov_exact_name"] == r["prov_blocking_score"] == 0


def test_vectors(spark, feats):
    pre = T.preprocess(spark.createDataFrame([BASE, ("S2-1", *BASE[1:])], SCHEMA))
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string")
    (r,) = X.vectors(X.features(X.paired(pairs, pre, pre))).collect()
    assert len(r.features) == 45


def test_a_similarity_of_names_takes_no_address_to_python(spark):
    pre = T.preprocess(spark.createDataFrame([BASE, ("S2-1", "Apex Technlogy", "9 Elm Way", "US")], SCHEMA))
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string")
    all_of = X.features(X.paired(pairs, pre, pre))
    python = lambda df: [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "similarity(" in x and "EvalPython" in x]
    (node,) = python(all_of.select("name_fuzz_ratio"))
    assert node.count("similarity(") == 1 and "addr" not in node
    (node,) = python(all_of)
    assert node.count("similarity(") == 8
    (r,) = all_of.collect()
    assert all_of.select("name_fuzz_ratio").first()[0] == r["name_fuzz_ratio"]


def test_rounds_give_what_one_join_gives(spark, monkeypatch):
    names = ["Apex Tech Inc", "Apex Technology", "Blue Sky 12", "Blue Skies", "Café Noir"]
    rows = [(f"{s}-{k}", n, a, "US") for s in ("S1", "S2") for k, (n, a) in enumerate(zip(names, ["1 Main St 4 4", "1 Main St", "", "Oak 7 7 oak", "rue 9"], strict=True))]
    pre = T.preprocess(spark.createDataFrame(rows, SCHEMA))
    queries, targets = pre.where("entity_id LIKE 'S1%'"), pre.where("entity_id LIKE 'S2%'")
    pairs = spark.createDataFrame([(f"S1-{a}", f"S2-{b}", ["name_token"], 12) for a in range(5) for b in range(5)] + [("S1-1", "none", ["name_token"], 12)], "s1_id string, cand_id string, methods array<string>, score long")
    written = []
    write = X.saved
    monkeypatch.setattr(X, "saved", lambda *parts: written.append(len(parts)) or write(*parts))
    monkeypatch.setattr(X, "PAIRS_A_RECORD", 1)
    for similarities in (True, False):
        whole = X.features(X.paired(pairs, queries, targets), similarities)
        made = X.features_in_rounds(pairs, queries, targets, similarities)
        assert made.columns == whole.columns and written[-1] == 3
        assert sorted(map(str, made.collect())) == sorted(map(str, whole.collect())) and made.count() == 25


def test_no_whole_address_goes_along_without_similarities(spark):
    pre = T.preprocess(spark.createDataFrame([BASE, ("S2-1", *BASE[1:])], SCHEMA))
    pairs = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string")
    plan = X.features(X.paired(pairs, pre, pre), similarities=False)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "a_addr_normalized#" in x or "b_addr_normalized#" in x]
    assert not joins and "a_addr_words#" in plan


def test_f7_has_every_capped_pair_and_keeps_no_whole_address(spark, monkeypatch):
    from tessera.functions import strings as S
    from tessera.operators import blocking as B
    from tessera.plans import registry
    from tessera.sources import tables

    written, write = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda *parts: written.append(parts[0].columns) or write(*parts))
    got = {(r.s1_id, r.cand_id): r.jw for r in registry.queries()["f7_jaro_winkler"](spark, "/root/testdata/sf0.001").collect()}
    assert written and not any("addr_conservative" in columns for columns in written)
    d = registry.Data(spark, "/root/testdata/sf0.001")
    names = {r.entity_id: r.name_normalized for r in d.records.select("entity_id", "name_normalized").collect()}
    want = {(r.s1_id, r.cand_id): S.jaro_winkler(names[r.s1_id], names[r.cand_id]) if names[r.s1_id] and names[r.cand_id] else 0.0 for r in B.ranked(d.pairs(), 50).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
