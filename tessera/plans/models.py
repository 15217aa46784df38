"""Match classifiers (M1 to M4) on Spark ML.

Both weigh classes by n / (2 n_class).  The boosting is an analogue: trees of bounded depth
without a penalty on leaves, where a histogram method grows them best first with one.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking as B
from ..operators import evaluation as A
from ..operators import features as X
from ..operators import pairs as L
from ..sources.tables import cut

SEED = 42
#: A fit is a job for each iteration: tasks are no smaller than this.
ROWS_A_TASK = 20_000


def dataset(d, ratio: int | None = 10, held: bool = True) -> DataFrame:
    """Labelled pairs with features and is_train: whole source-1 records on one side, negatives thinned on the training side.

    What several counts and joins read is cut from its plan: the capped pairs, and the features, which
    a fit reads once for each of its iterations (the records are files already).  Without held the
    held-out pairs, which are not thinned, are left out before their features are made.
    """
    queries, targets, truths = d.queries, d.targets(), d.truths
    kept = cut(B.ranked(B.merged(B.hits(queries, targets)), 50).drop("rn").withColumn("raw_candidate_count", F.lit(0).cast("long")))
    pairs = L.labelled(kept, truths).unionByName(L.recovered(kept, truths, targets))
    split = L.group_split(queries.select(F.col("entity_id").alias("s1_id")))
    both = cut(pairs.join(split, "s1_id"))
    thinned = L.subsample_negatives(both.where("is_train"), ratio)
    return X.features_in_rounds(thinned.unionByName(both.where("NOT is_train")) if held else thinned, queries, targets)


def weighted(df: DataFrame) -> DataFrame:
    n, pos = df.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    per = lambda k: n / (2.0 * k) if k else 0.0
    return df.withColumn("weight", F.when(F.col("label") == 1, per(pos)).otherwise(per(n - pos)))


def fit(train: DataFrame, kind: str = "logistic") -> PipelineModel:
    """A fitted pipeline from feature columns to prediction; train is read several times, so it is kept while fitting."""
    rows = weighted(train)
    n = rows.count()
    rows = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), -(-n // ROWS_A_TASK)))).persist()
    vector = VectorAssembler(inputCols=list(X.NAMES), outputCol="vector")
    if kind == "logistic":
        stages = [
            vector,
            StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True),
            LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=1000, tol=1e-4, regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False),
        ]
    else:
        stages = [vector, GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=20, maxDepth=5, minInstancesPerNode=30, maxBins=256, stepSize=0.1, seed=SEED)]
    model = Pipeline(stages=stages).fit(rows)
    rows.unpersist()
    return model


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select("s1_id", "cand_id", "label", F.element_at(vector_to_array("probability"), 2).alias("prob"))


def evaluate(model: PipelineModel, held: DataFrame) -> DataFrame:
    """One row: the tuned threshold, and metrics at it, on held-out pairs (the threshold is tuned on them too, so its F0.5 is optimistic)."""
    scored = cut(probabilities(model, held))
    threshold = A.best_threshold(scored).first()[0]
    out = A.confusion(scored, threshold).withColumn("threshold", F.lit(threshold))
    return out.crossJoin(F.broadcast(A.average_precision(scored)))  # single rows


def coefficients(d, n: int = 15) -> DataFrame:
    """(feature, coefficient) of the logistic model, the n largest by size."""
    model = fit(dataset(d, held=False), "logistic")
    rows = list(zip(X.NAMES, map(float, model.stages[-1].coefficients), strict=True))
    return d.spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")), "feature").limit(n)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
