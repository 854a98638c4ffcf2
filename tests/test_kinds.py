import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import metrics, models, synthetic
from test_rankers import table


def test_every_kind_fits_and_predicts(spark, tmp_path):
    _, df = table(spark, np.random.default_rng(0), 6, 8, 14)
    df = df.drop("m").withColumn("model_key", F.col("qid") % 2)
    train, test = df.where("doc_id % 4 <> 0"), df.where("doc_id % 4 = 0")
    few = {"lambdamart": {"rounds": 2}, "mart": {"rounds": 2}, "forest": {"n_trees": 3}, "adarank": {"rounds": 2}, "rankboost": {"rounds": 2}, "coordinate_ascent": {"sweeps": 1, "restarts": 1, "n_steps": 1}, "rtr_card": {"rounds": 2, "sample": 0.5}, "mixed_rtr_card": {"rounds": 2, "sample": 0.5}}
    n = test.count()
    for kind in models.KINDS:
        got = models.Model(kind, few.get(kind, {}), ["model_key"]).fit(train).predict(test)
        assert got.columns == [*test.columns, "score"] and got.where("score is not null").count() == n, kind


def test_settings_logs_and_files(spark, tmp_path):
    c = models.config_of({"sdt_depth": 3, "pdt_depth": None, "n_neighbors": 4, "feature_diff": False})
    assert (c.depth, c.distance_depth, c.k, c.use) == (3, None, 4, ("pair",))
    assert models.config_of({"pdt_depth": 1, "rounds": 4}, True, True).card.rounds == 4
    _, df = table(spark, np.random.default_rng(1), 4, 6, 9)
    m = models.Model("tree", {"sdt_depth": 2}, ["m"]).fit(df)
    m.save(f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == m.fitted.count()
    assert {(r.model, r.conf_sdt_depth) for r in m.log(m.predict(df)).collect()} == {("tree", 2)}
    for wrong in (lambda: models.Model("other"), lambda: models.Model("tree").predict(df), lambda: models.Model("random").fit(df).save("x")):
        with pytest.raises(ValueError):
            wrong()


def test_hidden_linear_lists(spark):
    df = synthetic.hidden_linear(spark, 5, 12, 4)
    got = df.groupBy("qid").agg(F.sort_array(F.collect_list("relevance")).alias("r")).collect()
    assert len(got) == 5 and all(r.r == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3, 4, 4] for r in got)
    assert metrics.ndcg(df.withColumn("y", F.col("relevance").cast("double")), "linear_score", 10).agg(F.min("ndcg")).first()[0] == 1.0
