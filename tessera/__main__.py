"""python -m tessera: link records of tab-separated sources, train a classifier, and write a report.

    python -m tessera S1.tsv S2.tsv TRUTH.tsv OUT --num_queries 5000 --candidate_cap 50
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import blocking as B
from .operators import features as X
from .operators import pairs as L
from .plans import models as M
from .plans import reports
from .sources import tables


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__.splitlines()[0])
    for name in ("source1", "source2", "truth", "out"):
        p.add_argument(name)
    p.add_argument("--num_queries", type=int, default=5000)
    p.add_argument("--candidate_cap", type=int, default=50)
    p.add_argument("--train_ratio", type=float, default=0.8)
    p.add_argument("--neg_ratio", type=int, default=10)
    p.add_argument("--seed", type=int, default=L.SEED)
    p.add_argument("--model", choices=("logistic", "boosting"), default="logistic")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()

    with tables.measured(used := {}):
        truth = tables.first_rows(tables.read_tsv(spark, args.truth, tables.TRUTH_SCHEMA), args.num_queries, "source1_entity_id")
        ids = truth.select(F.col("source1_entity_id").alias("entity_id"))
        queries = T.preprocess(tables.wanted_records(tables.read_records(spark, args.source1), ids)).persist()
        targets = T.preprocess(tables.read_records(spark, args.source2)).persist()
        prefix = targets.select(F.substring("entity_id", 1, 3)).first()[0]
        truths = L.of_source(L.parse_truth(truth), prefix).persist()
        merged = B.merged(B.hits(queries, targets)).persist()
        kept = B.ranked(merged, args.candidate_cap).drop("rn").withColumn("raw_candidate_count", F.lit(0).cast("long"))
        pairs = L.labelled(kept, truths).unionByName(L.recovered(kept, truths, targets))
        both = pairs.join(L.group_split(queries.select(F.col("entity_id").alias("s1_id")), args.train_ratio, args.seed), "s1_id")
        thinned = L.subsample_negatives(both.where("is_train"), args.neg_ratio, args.seed).unionByName(both.where("NOT is_train"))
        data = X.features(X.paired(thinned, queries, targets)).persist()
        model = M.fit(data.where("is_train"), args.model)
        metrics = M.evaluate(model, data.where("NOT is_train"))
        M.save(model, f"{args.out}/model")
        tables.write_json(metrics, f"{args.out}/metrics")
        report = [*reports.blocking_report(queries, truths, merged, (args.candidate_cap,)), *reports.lines("Classifier", metrics)]
    tables.write_metadata({"arguments": vars(args), **used}, f"{args.out}/metadata.json")
    tables.write_report([*report, f"{used['seconds']:.1f} s"], f"{args.out}/report.txt")


if __name__ == "__main__":
    main()
