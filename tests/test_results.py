import json

from pyspark.sql import functions as F

from rankloom.operators import rtr, splits
from rankloom.sources import results as R
from test_models import table


def test_selection_files(spark, tmp_path):
    rows = [{"qxm": 2, "query": [1, 2], "configs": [{"depth": 2, "k": 3}, {"depth": 3, "k": None}], "idx_best": 1, "results": [0.5, 0.75]}, {"qxm": 2, "query": [3], "configs": [{"depth": 2, "k": 3}], "idx_best": 0, "results": [0.25]}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    s = R.read_selection(spark, str(tmp_path / "s.json"), "depth: int, k: int")
    got = sorted(((r.dataset, r.query, r.depth, r.k, r.ndcg) for r in R.config_results(s, "D", "M").collect()), key=str)
    assert got == [("D", [1, 2], 2, 3, 0.5), ("D", [1, 2], 3, None, 0.75), ("D", [3], 2, 3, 0.25)]
    groups = R.query_configs(s).first().groups
    assert [(g.query, g.config.depth) for g in groups] == [([1, 2], 3), ([3], 2)]
    R.write_json(s, f"{tmp_path}/out")
    assert R.read_selection(spark, f"{tmp_path}/out", "depth: int, k: int", multi_line=False).count() == 2
    (tmp_path / "b.json").write_text(json.dumps([{"qxm": 1, "eval_k": 5, "result": [1.0, 0.5, 0.25]}, {"qxm": 1, "eval_k": 10, "result": [0.9]}]))
    assert [tuple(r) for r in R.read_best_results(spark, str(tmp_path / "b.json")).collect()] == [(1, 10, 0.9, None, None), (1, 5, 1.0, 0.5, 0.25)]


def test_saved_rankers_predict_the_same(spark, tmp_path):
    _, df = table(spark, 8, 3, 20)
    df = splits.query_kfold(df, 4).withColumn("model_key", F.col("qid"))
    train, test = df.where("fold <> 0"), df.where("fold = 0")
    r = rtr.fit(train, rtr.Config())
    R.save_ranker(r, f"{tmp_path}/m")
    a, b = (sorted((x.qid, x.doc_id, x.full) for x in m.predict(test).collect()) for m in (r, R.load_ranker(spark, f"{tmp_path}/m")))
    assert a == b
