import subprocess
import sys
from pathlib import Path

from tessera.plans import registry
from tessera.sources import adapters, tables

ROOT = Path(__file__).resolve().parents[1]


def test_tsv_keeps_names_that_look_missing(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\tUS\nS1-2\t"a ""b"" c"\t x \tIndia\n', encoding="utf-8")
    got = {r.entity_id: r for r in tables.read_records(spark, str(path)).collect()}
    assert got["S1-1"].business_name == "NA" and got["S1-1"].business_address == "" and got["S1-2"].business_name == 'a "b" c'
    assert tables.read_tsv(spark, str(path), na_values=["NA"]).where("entity_id = 'S1-1'").first().business_name == ""
    assert tables.read_records(spark, str(path), country="India", max_rows=5).count() == 1


def test_records_reports_and_measures(spark, tmp_path):
    df = tables.from_records(spark, [{"entity_id": "S1-1", "business_name": "x"}])
    assert df.first().country is None
    tables.write_report(["é", "b"], str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text(encoding="utf-8") == "é\nb\n"
    tables.write_metadata({"a": [1]}, str(tmp_path / "m.json"))
    tables.write_json(df, str(tmp_path / "j"))
    with tables.measured(got := {}):
        pass
    assert got["seconds"] >= 0 and spark.read.json(str(tmp_path / "j")).count() == 1


def test_the_rest_stands_without_the_optional_part(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tessera.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "q10_candidates" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_whole_texts_and_all_sources_reach_the_flagship_query(spark, tmp_path):
    tail = [f"tailword{k}" for k in range(30)]
    text = lambda p: " ".join([f"{p}word{k}" for k in range(12)] + tail)
    spark.createDataFrame([(0, text("a"), "en"), (1, text("b"), "en"), (2, text("c"), "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = {r.entity_id: r.business_address for r in adapters.sources(spark, str(tmp_path)).collect()}
    assert whole["S3-2"] == " ".join([f"cword{k}" for k in range(4, 12)] + tail)
    got = {(r.source1_entity_id, r.candidate_entity_id, r.candidate_source) for r in registry.flagship(spark, str(tmp_path)).collect()}
    assert {("S1-0", "S2-1", "S2"), ("S1-0", "S3-2", "S3")} <= got
