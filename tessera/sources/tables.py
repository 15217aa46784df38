"""Sources and sinks (S1 to S12): tab-separated records, ground truth, reports and metrics."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA, na_values: Iterable[str] = ()) -> DataFrame:
    """A tab-separated file of strings with a header; missing values are empty strings, and so are those in na_values (none by default: a company called NA keeps its name)."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "\u0000").csv(path)
    missing = list(na_values)
    value = lambda c: F.coalesce(F.when(F.col(c).isin(*missing), "").otherwise(F.col(c)) if missing else F.col(c), F.lit(""))
    return df.select(*[value(f.name).alias(f.name) for f in schema.fields])


def read_records(spark: SparkSession, path: str, country: str | None = None, max_rows: int | None = None, **options) -> DataFrame:
    """Records of one country, if it is named, and at most max_rows of them."""
    df = read_tsv(spark, path, **options)
    df = df if country is None else df.where(F.col("country") == country)
    return df if max_rows is None else df.limit(max_rows)


def from_records(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    names = RECORD_SCHEMA.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RECORD_SCHEMA)


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first n rows in order of key (a top-k sort: no full sort, no single-task window)."""
    return df.orderBy(key).limit(n)


def wanted_records(records: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Records whose id is among ids (column key)."""
    return records.join(ids.select(key), key, "left_semi")


def write_report(lines: Iterable[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def write_json(df: DataFrame, path: str) -> None:
    """A table of metrics as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_metadata(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2, ensure_ascii=False)


def show(df: DataFrame, n: int = 5) -> None:
    df.show(n, truncate=False)


@contextmanager
def measured(into: dict):
    """Wall-clock seconds, and the driver's peak memory in MB, of a block."""
    import resource

    began = time.perf_counter()
    yield into
    into["seconds"] = time.perf_counter() - began
    into["peak_mb"] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


#: Rows up to which a table is dealt out anew over all cores; a larger one has splits enough of its own.
FEW_ROWS = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has so few rows that its file may be one split; a larger table is left as it is and never shuffled for this."""
    if df.limit(FEW_ROWS + 1).count() > FEW_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one under the warehouse is set only where none is."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Spark removes the shuffle files of a plan at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> None:
    """df to Parquet files; what its plan shuffled is removed then, since later plans begin at the files."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def saved(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, one part after the other, from Parquet files in the shared folder: later plans begin there, read only the columns they name, and survive lost executors."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    for df in parts:
        _written(df, path)
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder, for small tables and plans that a fit reads again and again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
