from tessera.functions import text as T
from tessera.operators import blocking as B
from tessera.sources import adapters, tables
from tessera.streaming import index

DIR = "/root/testdata/sf0.001"


def test_a_streamed_index_answers_as_a_built_one(spark, tmp_path):
    src = adapters.sources(spark, DIR)
    targets = src.where("source = 'S2'").select(*tables.RECORD_SCHEMA.names)
    targets.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tables.RECORD_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index.grow(stream, str(tmp_path / "index"), str(tmp_path / "log")).awaitTermination()
    queries = T.preprocess(src.where("source = 'S1'"))
    got = B.merged(index.hits(queries, index.read(spark, str(tmp_path / "index"))))
    want = B.merged(B.hits(queries, T.preprocess(targets)))
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
