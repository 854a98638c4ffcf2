import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import boosting as B
from rankloom.operators import linear as L
from rankloom.operators import metrics, pairs

LTR = "m long, qid long, doc_id long, y double, features array<double>"


def table(spark, rng, queries=20, least=3, most=25, d=3):
    rows = []
    for q in range(queries):
        x = rng.normal(size=(rng.integers(least, most), d))
        y = np.clip(np.round(1 + x[:, 0] + 0.5 * x[:, 1] + 0.4 * rng.normal(size=len(x))), 0, 4)
        rows += [(q % 2, q, i, float(t), v.tolist()) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return rows, spark.createDataFrame(rows, LTR).repartition(3)


def plain_lambdas(s, y, k):
    """By all pairs of a query."""
    order = sorted(range(len(s)), key=lambda i: (-round(s[i], 9), i))
    disc = {i: 1 / np.log2(r + 2) if r < k else 0.0 for r, i in enumerate(order)}
    ideal = sum(v / np.log2(r + 2) for r, v in enumerate(sorted(y, reverse=True)[:k]))
    lam, w = np.zeros(len(s)), np.zeros(len(s))
    for i, j in itertools.permutations(range(len(s)), 2):
        if y[i] > y[j] and ideal > 0:
            delta = (y[i] - y[j]) * abs(disc[i] - disc[j]) / ideal
            rho = 1 / (1 + np.exp(s[i] - s[j]))
            lam[i] += delta * rho
            lam[j] -= delta * rho
            w[[i, j]] += delta * rho * (1 - rho)
    return lam, w


def test_lambdas_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows, df = table(spark, rng, 12)
    rows = [(*r, float(np.round(rng.normal(), 1))) for r in rows] + [(0, 50, i, 0.0, [0.0] * 3, float(i)) for i in range(4)] + [(0, 51, 0, 2.0, [0.0] * 3, 1.0)]
    got = {(r.qid, r.doc_id): (r.lam, r.weight) for r in B.lambdas(spark.createDataFrame(rows, LTR + ", s double").repartition(4), 4).collect()}
    assert len(got) == len(rows)
    for q in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == q]
        s, y = np.array([r[5] for r in own]), np.array([r[3] for r in own])
        for found in (B.query_lambdas(s, y, 4), ([got[(q, i)][0] for i in range(len(own))], [got[(q, i)][1] for i in range(len(own))])):
            assert np.allclose(found, plain_lambdas(s, y, 4), atol=1e-9)


@pytest.mark.parametrize("objective", ["ndcg", "squared"])
def test_rounds_in_a_task_and_in_spark_are_the_same(spark, objective):
    rows, df = table(spark, np.random.default_rng(1))
    c = B.Boost(rounds=3, rate=0.3, depth=2, k=5, objective=objective)
    whole, rounds = (B.predict(df, B.fit(df, c, ["m"], cells=n), ["m"]) for n in (10**6, 0))
    a, b = ({(r.qid, r.doc_id): r.score for r in x.collect()} for x in (whole, rounds))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-7 for k in a)


def test_lambdamart_and_mart_against_plain_loops_and_a_stump(spark):
    rows, df = table(spark, np.random.default_rng(2), 20, 10)
    train, test = df.where("doc_id % 3 <> 0"), df.where("doc_id % 3 = 0")
    c = B.Boost(rounds=20, rate=0.2, k=5)
    model = B.fit(train, c)
    from rankloom.operators import trees as T

    own = sorted(r for r in rows if r[2] % 3)
    own.sort(key=lambda r: (r[1], r[2]))
    x, y, q = np.array([r[4] for r in own]), np.array([r[3] for r in own]), np.array([r[1] for r in own])
    s = np.zeros(len(y))
    for _ in range(c.rounds):
        lam, w = np.zeros(len(y)), np.zeros(len(y))
        for k in np.unique(q):
            lam[q == k], w[q == k] = plain_lambdas(s[q == k], y[q == k], 5)
        _, leaf = T.grow_arrays(x, lam, np.ones(len(y)), np.zeros(len(y), np.int64), c.depth)
        s = s + np.array([c.rate * lam[leaf == n].sum() / w[leaf == n].sum() for n in leaf])
    got = {(r.qid, r.doc_id): r.score for r in B.predict(train, model).collect()}
    assert all(abs(got[(r[1], r[2])] - v) < 1e-6 for r, v in zip(own, s, strict=True))
    ndcg = lambda ensemble: metrics.ndcg(B.predict(test, ensemble), "score", 5).agg(F.avg("ndcg")).first()[0]
    assert ndcg(model) > ndcg(B.fit(train, B.Boost(rounds=1, depth=1, k=5))) + 0.02
    error = lambda n: B.predict(train, B.fit(train, B.Boost(rounds=n, objective="squared"))).agg(F.avg(F.pow(F.col("y") - F.col("score"), 2))).first()[0]
    assert error(30) < 0.5 * error(0)
    with pytest.raises(ValueError, match="objective"):
        B.Boost(objective="other")


def test_forest_samples_and_out_of_bag(spark):
    rows, df = table(spark, np.random.default_rng(3), 30, 10)
    forest = B.grow_forest(df, 12, 4, 2, ["m"])
    assert forest.select("m", "tree_no").distinct().count() == 24
    n = forest.where("path = 'R'").agg(F.avg("n")).first()[0]
    assert abs(n / (len(rows) / 2) - 0.632) < 0.06
    scores = B.forest_scores(df, forest, ["m"], out_of_bag=True)
    met = df.join(scores, ["m", "qid", "doc_id"]).where("score is not null")
    assert met.count() >= 0.95 * len(rows)
    plain = met.agg(F.var_pop("y")).first()[0]
    assert met.agg(F.avg(F.pow(F.col("y") - F.col("score"), 2))).first()[0] < 0.7 * plain
    large = B.grow_forest(df, 2, 2, 2, ["m"], cells=0)
    facts = lambda f: {(r.m, r.tree_no, r.path): (r.feature, r.n, round(r.prediction, 8)) for r in f.where("tree_no < 2").collect()}
    assert facts(large) == facts(B.grow_forest(df, 2, 2, 2, ["m"]))


def test_listnet_gradient_sweep_and_selection(spark):
    rng = np.random.default_rng(4)
    rows, df = table(spark, rng, 16, 6)
    x, y, first = rng.normal(size=(30, 3)), rng.integers(0, 4, 30).astype(float), np.array([0, 4, 5, 17])
    w = rng.normal(size=3)
    for i in range(3):
        e = 1e-6 * np.eye(3)[i]
        slope = (L.listnet_loss(w + e, x, y, first) - L.listnet_loss(w - e, x, y, first)) / 2e-6
        assert abs(slope - L.listnet_gradient(w[:, None], x, y, first)[i, 0]) < 1e-6
    whole, epochs = ({(r.m, r.rate, r.epoch): r.weights for r in L.listnet(df, [0.5, 0.05], [1, 3], ["m"], n).collect()} for n in (10**6, 0))
    assert whole.keys() == epochs.keys() and len(whole) == 8 and all(np.allclose(whole[k], epochs[k], atol=1e-9) for k in whole)
    parts = {n: df.where(F.col("doc_id") % 3 == i) for i, n in enumerate(("train", "valid", "test"))}
    best = L.listnet_selection(parts, [0.5, 0.01], [1, 20], ["m"], 5).collect()
    models = L.listnet(parts["train"], [0.5, 0.01], [1, 20], ["m"])
    each = metrics.ndcg(L.listnet_scores(parts["valid"], models, ["m"]), "score", 5, ["m", "rate", "epoch", "qid"]).groupBy("m", "rate", "epoch").agg(F.avg("ndcg").alias("v")).collect()
    assert len(best) == 2 and all(abs(r.valid - max(e.v for e in each if e.m == r.m)) < 1e-9 and r.test > 0 for r in best)


def test_adarank_equals_plain_loops(spark):
    rng = np.random.default_rng(6)
    rows, df = table(spark, rng, 10, 5)
    got = {(r.m, r.round): (r.feature, r.alpha) for r in L.adarank(df, 3, 4, ["m"]).collect()}

    def ndcg(s, y):
        return metrics_by_hand(np.asarray(s), np.asarray(y), 4)

    for m in (0, 1):
        lists = {}
        for k, q, _, y, x in rows:
            if k == m:
                lists.setdefault(q, []).append((y, x))
        p = {q: 1 / len(lists) for q in lists}
        total = {q: np.zeros(len(v)) for q, v in lists.items()}
        for r in (1, 2, 3):
            e = [sum(p[q] * ndcg([x[f] for _, x in v], [y for y, _ in v]) for q, v in lists.items()) for f in range(3)]
            f = int(np.argmax(np.round(e, 9)))
            alpha = 0.5 * np.log((1 + e[f]) / (1 - e[f]))
            assert got[(m, r)][0] == f and abs(got[(m, r)][1] - alpha) < 1e-8
            for q, v in lists.items():
                total[q] = total[q] + alpha * np.array([x[f] for _, x in v])
            z = {q: np.exp(-ndcg(np.round(total[q], 9), [y for y, _ in v])) for q, v in lists.items()}
            p = {q: z[q] / sum(z.values()) for q in z}


def metrics_by_hand(s, y, k):
    disc = 1 / np.log2(np.arange(2, k + 2))
    order, ideal = np.argsort(-s, kind="stable")[:k], np.sort(y)[::-1][:k]
    if len(y) == 1:
        return 1.0
    best = (ideal * disc[: len(ideal)]).sum()
    return (y[order] * disc[: len(order)]).sum() / best if best else 0.0


def test_least_squares(spark):
    rows, df = table(spark, np.random.default_rng(7), 12, 8)
    for r in L.least_squares(df, keys=["m"]).collect():
        x, y = np.array([[*v, 1.0] for m, *_, v in rows if m == r.m]), np.array([t for m, _, _, t, _ in rows if m == r.m])
        assert np.allclose(r.weights, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)
    assert len(L.least_squares(df).first().weights) == 4


def test_precomputed_targets_in_three_forms(spark):
    rng = np.random.default_rng(8)
    m = rng.random((4, 5))
    met = [(k, i, j) for k, (i, j) in enumerate(itertools.product(range(4), range(5))) if (i + j) % 3]
    df = spark.createDataFrame(met, "at long, idx_a long, idx_b long")
    matrix = spark.createDataFrame([(i, m[i].tolist()) for i in range(4)], "i long, values array<double>")
    flat = spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.ravel())], "at long, value double")
    aligned = spark.createDataFrame([(k, float(m[i, j])) for k, i, j in met], "at long, value double")
    want = {(i, j): m[i, j] for _, i, j in met}
    for given in (matrix, flat, aligned):
        assert {(r.idx_a, r.idx_b): r.target for r in pairs.self_supervised(df, given, 4, 5).collect()} == want
    for wrong in (flat.where("at < 7"), matrix.where("i < 3"), matrix.withColumn("values", F.slice("values", 1, 4))):
        with pytest.raises(ValueError, match="are due"):
            pairs.precomputed_targets(df, wrong, 4, 5)
    sides = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "features_a array<double>, features_b array<double>")
    assert pairs.self_supervised(sides).first().target == 5 and pairs.self_supervised(sides, metric="manhattan").first().target == 7
    with pytest.raises(ValueError, match="metric"):
        pairs.self_supervised(sides, metric="other")


@pytest.mark.parametrize("objective", ["ndcg", "squared"])
def test_one_large_model_over_blocks_grows_the_trees_of_a_whole_one(spark, objective):
    rng = np.random.default_rng(11)
    rows = [(q, d, float(rng.integers(4)), [float(np.round(rng.normal(), 2)), float(rng.integers(6)), 1.0]) for q, n in enumerate([40, 1, 70, 25, 60]) for d in range(n)]
    df = spark.createDataFrame(rows, "qid long, doc_id long, y double, features array<double>").repartition(3)
    c = B.Boost(rounds=2, objective=objective)
    facts = lambda e: {(r["round"], r["node"]): (r.feature, r.threshold and round(r.threshold, 9), round(r.prediction, 8), r.n) for r in e.collect()}
    assert B._blocked(df, 210) == 3 and B._blocked(df, 209) == 0
    assert B._blocked(df.withColumn("y", F.when(F.col("doc_id") != 69, F.col("y"))), 210) == 0
    whole = facts(B.fit(df, c))
    assert len(whole) > 9 and whole == facts(B.fit(df, c, cells=1, block=50, bins=8))
