import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import blocks
from rankloom.operators import boosting as B
from rankloom.operators import trees as T


def facts(df, *keys):
    return {tuple(r[k] for k in (*keys, "node")): (r.feature, r.threshold and round(r.threshold, 9), round(r.prediction, 9), r.n, r.path) for r in df.collect()}


def rows_of(rng, n, d=3):
    x = np.round(rng.normal(size=(n, d)), 2)
    return [(i % 7, i, float(t), v.tolist()) for i, (v, t) in enumerate(zip(x, x[:, 0] * x[:, 1] + rng.normal(size=n), strict=True))]


@pytest.mark.parametrize("bins", [2, 16, T.BINS])
def test_forest_over_blocks_equals_that_of_tasks(spark, bins, monkeypatch):
    df = spark.createDataFrame(rows_of(np.random.default_rng(3), 500), "qid long, doc_id long, y double, features array<double>").repartition(3)
    used = []
    plain = blocks.grow
    monkeypatch.setattr(blocks, "grow", lambda *a, **k: used.append(1) or plain(*a, **k, block=100))
    large, small = B.grow_forest(df, 5, 3, 2, cells=0, bins=bins), B.grow_forest(df, 5, 3, 2)
    assert used == [1] and facts(large, "tree_no") == facts(small, "tree_no") and large.columns == small.columns
    a, b = ({(r.qid, r.doc_id): r.score for r in B.forest_scores(df, f, out_of_bag=True).collect()} for f in (large, small))
    assert len(a) == 500 and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in a)


def test_out_of_bag_scores_equal_those_of_copies(spark):
    rows = rows_of(np.random.default_rng(4), 120)
    df = spark.createDataFrame([*rows, rows[3], (0, 900, 1.0, None), (0, 901, 1.0, [0.1, None, 0.2])], "qid long, doc_id long, y double, features array<double>")
    forest = B.grow_forest(df.where("doc_id < 900"), 4, 3, 2)
    for oob in (True, False):
        copies = df.crossJoin(forest.select("tree_no").distinct())
        each = T.apply(copies, forest, ["tree_no"], "_p", "_leaf")
        own = F.when(B.bootstrap_weight(F.col("tree_no"), "qid", "doc_id") == 0, F.col("_p")) if oob else F.col("_p")
        want = {(r.qid, r.doc_id): r.s for r in each.groupBy("qid", "doc_id").agg(F.avg(own).alias("s")).collect()}
        got = {(r.qid, r.doc_id): r.score for r in B.forest_scores(df, forest, out_of_bag=oob).collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in want.items())


@pytest.mark.parametrize("min_split", [2, 40])
def test_one_large_tree_grows_over_blocks(spark, min_split, monkeypatch):
    df = spark.createDataFrame(rows_of(np.random.default_rng(5), 400), "qid long, doc_id long, target double, features array<double>").repartition(3)
    used = []
    plain = blocks.grow
    monkeypatch.setattr(blocks, "grow", lambda *a, **k: used.append(1) or plain(*a, **k, block=64))
    large = T.grow(df, [], 3, min_split=min_split, cells=0, bins=8)
    assert used and facts(large) == facts(T.grow(df, [], 3, min_split=min_split))
    # Rows that are no numbers take the other way.
    some = df.unionByName(spark.createDataFrame([(0, 1000, None, [1.0, 2.0, 3.0])], df.schema))
    T.grow(some, [], 1, cells=0)
    assert len(used) == 1


def test_linear_rankers_over_blocks_equal_the_others(spark):
    from rankloom.operators import linear, pairwise

    rng = np.random.default_rng(6)
    rows = [(q, d, float(np.clip(d % 4 - (q % 3), 0, 3)), [float(v) for v in np.round(rng.normal(size=2), 1)]) for q in range(15) for d in range(1 + q)]
    df = spark.createDataFrame(rows, "qid long, doc_id long, y double, features array<double>").repartition(3)
    a, b = (pairwise.coordinate_ascent(df, 1, 2, 2, k=3, cells=n).first() for n in (10**6, 0))
    assert np.allclose(a.weights, b.weights, atol=1e-12) and abs(a.ndcg - b.ndcg) < 1e-9
    small, large = ({(r.rate, r.epoch): r.weights for r in linear.listnet(df, [0.1, 1.0], [1, 3], cells=n).collect()} for n in (10**6, 20))
    assert small.keys() == large.keys() and all(np.allclose(small[k], large[k], atol=1e-9) for k in small)


def test_short_numbers_have_the_texts_of_formats(spark):
    from rankloom.sources import ltr

    rng = np.random.default_rng(7)
    values = [0.0, -0.0, 1e-3, 0.001234567, 0.00012, 0.04, 0.1, 1.0, -2.5, 50.0, 2526.0, 99999.5, 999999.0, 999999.5, 1e6, 1234567.0, 1e7, 123.4565, 0.00005, 1.00005, 2.34565, 1e9, -1e-9, *np.round(rng.normal(size=60) * 10.0 ** rng.integers(-6, 8, 60), 5).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(2)
    for r in df.select("v", ltr.significant(F.col("v")).alias("g"), ltr.fixed(F.col("v"), 4).alias("f"), F.format_string("%.4f", "v").alias("w")).collect():
        assert r.f == r.w
        if len(repr(r.v).replace(".", "").replace("-", "").lstrip("0")) <= 6:
            assert r.g == f"{r.v:g}", r.v


def test_given_pairs_meet_documents_and_no_pairs(spark):
    from rankloom.operators import pairs

    df = spark.createDataFrame([(q, d, float(d * q)) for q in range(4) for d in range(q + 1)], "qid long, doc_id long, v double")
    given = pairs.pairs(df, ["qid"]).select("qid", "doc_id_a", "doc_id_b", (F.col("v_a") - F.col("v_b")).alias("target"))
    found = pairs.given_pairs(df, given, ["qid"])
    assert sorted(map(tuple, found.collect())) == sorted((q, a, b, float((a - b) * q)) for q in range(4) for a in range(q + 1) for b in range(q + 1))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_lambdas_of_many_queries_at_once_and_small_batches_of_blocks(spark):
    rng = np.random.default_rng(8)
    size = np.array([1, 5, 30, 2, 12, 3])
    first = np.append(0, np.cumsum(size))
    s, y = np.round(rng.normal(size=first[-1]), 1), rng.integers(0, 4, first[-1]).astype(float)
    y[first[3] : first[4]] = 0
    lam, weight = B.list_lambdas(s, y, first, 4)
    for u, v in zip(first[:-1], first[1:], strict=True):
        order, ideal = sorted(range(u, v), key=lambda i: (-s[i], i)), sum(g / np.log2(j + 2) for j, g in enumerate(sorted(y[u:v], reverse=True)[:4]))
        disc = {i: 1 / np.log2(j + 2) if j < 4 else 0.0 for j, i in enumerate(order)}
        want = {i: [0.0, 0.0] for i in order}
        for i in order:
            for j in order:
                if y[i] > y[j] and (disc[i] or disc[j]):
                    delta, rho = (y[i] - y[j]) * abs(disc[i] - disc[j]) / ideal, 1 / (1 + np.exp(s[i] - s[j]))
                    want[i][0] += delta * rho
                    want[j][0] -= delta * rho
                    for k in (i, j):
                        want[k][1] += delta * rho * (1 - rho)
        assert np.allclose([*zip(lam[u:v], weight[u:v], strict=True)], [want[i] for i in range(u, v)], atol=1e-12)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "256m")
        blocks.small_batches(spark)
        assert int(spark.conf.get(name)) == blocks.BATCH
    finally:
        spark.conf.set(name, before)
