"""An index that grows with a stream of records.

Each micro-batch appends its records' blocking keys; frequencies are counted when the index is
read, so pruning does not depend on the order of arrival, and a batch that is run again replaces
its own partition.  Keys are stored by pass, so that a probe of some passes reads only those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import blocking as B
from ..operators import keys as K
from ..sources.tables import saved


def append(batch: DataFrame, batch_id: int, path: str) -> None:
    """The keys of a micro-batch of raw records, under its own folder: writing it twice gives the same."""
    K.target_keys(T.preprocess(batch)).withColumn("ordinal", F.col("ordinal").cast("string")).write.mode("overwrite").partitionBy("pass").parquet(f"{path}/batch={batch_id}")


def grow(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start to append a stream of raw records to the index under path, all that is there now and then stop."""
    return records.writeStream.foreachBatch(lambda df, n: append(df, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("pass", "country", "key", "entity_id", "ordinal")


def hits(queries: DataFrame, index: DataFrame, options: B.Options = B.Options(), limits: K.Limits = K.Limits()) -> DataFrame:
    """Hits of preprocessed queries in a stored index, as blocking.hits gives from records."""
    return B.look_up(B.probe_keys(queries, options, limits), index, saved(K.key_counts(index)), options, limits)
