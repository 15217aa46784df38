from pyspark.sql import functions as F

from tessera.plans import models as M
from tessera.plans import registry

DIR = "/root/testdata/sf0.001"


def test_the_training_side_alone_has_the_same_pairs_and_fewer_features_to_make(spark, monkeypatch):
    made = []
    whole = M.X.features_in_rounds
    monkeypatch.setattr(M.X, "features_in_rounds", lambda pairs, *rest: made.append(pairs.count()) or whole(pairs, *rest))
    d = registry.Data(spark, DIR)
    every, train = M.dataset(d), M.dataset(d, held=False)
    key = ["s1_id", "cand_id", "label", "name_fuzz_ratio"]
    rows = lambda df: sorted(map(tuple, df.select(*key).collect()))
    assert rows(train) == rows(every.where("is_train")) and rows(train)
    assert made[1] < made[0] and train.where(~F.col("is_train")).count() == 0
