import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import experiments as X
from rankloom.operators import rtr, trees
from rankloom.sources import ltr


def lists(spark, queries=6, docs=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(queries * docs, 2))
    y = np.clip(np.round(x[:, 0] + 0.2 * rng.normal(size=len(x)) + 1.5), 0, 4)
    return ltr.from_arrays(spark, x.tolist(), y.tolist(), [10 * (i // docs) for i in range(len(x))])


def test_six_significant_digits(spark):
    values = [0.0, 1.0, -1.5, 123456.789, 1234567.0, 1.23456789e-05, 0.0001, 0.00012345678, 100000.0, 1e6, 1e22, -3.25e-10, 0.1 + 0.2, 5e-300, 99999.96, 999999.7]
    df = spark.createDataFrame([(1.0, 7, values)], "y double, qid long, features array<double>")
    cells = df.select(ltr.letor_line().alias("v")).first().v.split(" ")[2:]
    assert cells == [f"{i + 1}:{v:.6g}" for i, v in enumerate(values)]
    assert df.select(ltr.letor_line(3).alias("v")).first().v.split(" ")[5] == "4:123456.789"


def test_tables_from_arrays_wide_rows_and_ranges(spark):
    df = ltr.from_arrays(spark, [[3, 0], [1, 2], [5, 6]], [0, 2, 1], [2, 1, 1])
    assert sorted((r.qid, r.doc_id, r.y, r.features) for r in df.collect()) == [(1, 1, 2.0, [1.0, 2.0]), (1, 2, 1.0, [5.0, 6.0]), (2, 0, 0.0, [3.0, 0.0])]
    with pytest.raises(ValueError, match="differ"):
        ltr.from_arrays(spark, [[1]], [1, 2], [1])
    wide = spark.createDataFrame([(1, 5, 0.1, 0.2), (0, 5, 0.3, 0.4)], "label int, qid int, `1` double, `2` double")
    assert [(r.qid, r.doc_id, r.y, r.features) for r in ltr.from_wide(wide).orderBy("doc_id").collect()] == [(5, 1, 1.0, [0.1, 0.2]), (5, 2, 0.0, [0.3, 0.4])]
    assert [(q, part.count()) for q, part in ltr.each_query(df)] == [(1, 2), (2, 1)]
    assert [(r.qid, r.doc_id) for r in ltr.rows_at(df, [-1, 0]).orderBy("qid").collect()] == [(1, 1), (2, 0)]
    assert ltr.query_range(df, high=1).count() == 2 and ltr.query_range(df, low=2).count() == 1


def test_batches_and_their_configurations(spark):
    df = lists(spark)
    groups = X.query_groups(df, [1, 4])
    assert {(r.qxm, r.batch) for r in groups.collect()} == {(1, b) for b in range(6)} | {(4, 0), (4, 1)}
    with pytest.warns(UserWarning, match="batches"):
        X.check_groups(df, groups.where("qxm = 4").withColumn("batch", F.col("qid")))
    with pytest.raises(ValueError, match="not in the data"):
        X.check_groups(df, spark.createDataFrame([(1, 0, 999)], "qxm long, batch long, qid long"))
    two = [rtr.Config(depth=1, distance_depth=None, k=2), rtr.Config(depth=2, distance_depth=1, k=1)]
    one = groups.where("qxm = 1").select("batch", "qid")
    with pytest.raises(ValueError, match="idx"):
        X.fit_batches(df, one, two)
    fitted = X.fit_batches(df, one.withColumn("idx", (F.col("batch") % 2).cast("int")), two)
    got = {(r.qid, r.doc_id): r.full for r in fitted.predict(df, euclid=False).collect()}
    # A batch's predictions are those of a ranker of its own with its configuration.
    for batch, config in ((2, two[0]), (3, two[1])):
        own = df.where(F.col("qid") == 10 * batch).withColumn("batch", F.lit(batch).cast("long"))
        alone = rtr.fit(own, config, ["batch"]).predict(own, euclid=False).collect()
        assert len(alone) == 12 and all(abs(got[r.qid, r.doc_id] - r.full) < 1e-9 for r in alone)
    with pytest.raises(ValueError, match="without a model"):
        fitted.predict(df.withColumn("qid", F.lit(5).cast("long")))


def test_selection_retraining_and_log(spark):
    df = lists(spark, queries=4, docs=20)
    train, test = df.where("doc_id % 4 <> 0"), df.where("doc_id % 4 = 0")
    configs = [rtr.Config(depth=1, distance_depth=None, k=1), rtr.Config(depth=3, distance_depth=None, k=3)]
    table = X.model_selection(train, [2], configs)
    rows = table.collect()
    assert len(rows) == 2 and all(len(r.results) == 2 and r.results[r.idx_best] == max(r.results) and len(r["query"]) == 2 for r in rows)
    out = X.retrain(train, test, table, configs, (5,), ("score", "full", "euclid")).collect()
    assert {(r.qxm, r.model, r.k) for r in out} == {(2, c, 5) for c in ("score", "full", "euclid")} and all(0 < r.mean <= 1 for r in out)
    # One configuration for all batches of a size.
    fixed = X.retrain(train, test, table, configs, (5,), only={2: 1}).first()
    plain = X.evaluate(X.train_sizes(train, [2], configs[1]).predict(test), ("full",), (5,)).first()
    assert abs(fixed.mean - plain.mean) < 1e-9
    log = X.timed(lambda: X.evaluate(X.train_sizes(train, [1, 2], configs[0]).predict(test)), {"k": 1}, model="m")
    assert log.count() == 2 and set(log.columns) >= {"seconds", "conf_k", "model"}
    assert X.timing_stats(log.drop("model").withColumn("name", F.lit("a")), ["name"]).first().runs == 2


def test_values_in_ranges_give_the_same_splits(spark):
    rng = np.random.default_rng(3)
    rows = [(1, [float(v) for v in x], float(t)) for x, t in zip(np.c_[rng.exponential(size=400) ** 3, rng.integers(0, 3, 400), np.ones(400)], rng.normal(size=400), strict=True)]
    df = spark.createDataFrame(rows, "node long, features array<double>, target double")
    want = trees.best_splits(df, [], ranges=1).collect()
    assert len(want) == 1
    for ranges in (2, 7, 512):
        assert trees.best_splits(df, [], ranges=ranges).collect() == want


def test_configurations_with_one_first_stage_grow_its_trees_once(spark, monkeypatch):
    rows = [(q, d, float((q + d) % 3), [float(d % 5), float(d)]) for q in range(2) for d in range(12)]
    df = spark.createDataFrame(rows, "qid long, doc_id long, y double, features array<double>")
    grown, real = [], rtr.T.grow
    monkeypatch.setattr(rtr.T, "grow", lambda *a, **k: grown.append(1) or real(*a, **k))
    configs = [rtr.Config(depth=1, distance_depth=None, k=2, use=use) for use in (("abs_diff",), ("sq_diff",))]
    scores = X._scores(df.withColumn("m", F.lit(1)), df.withColumn("m", F.lit(1)), configs, ["m"], 5).collect()
    assert len(grown) == 1 and len({(r.idx, r.qid) for r in scores}) == 4
    assert len({(r.qid, round(r.ndcg, 9)) for r in scores}) == 2
