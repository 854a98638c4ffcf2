import itertools

import numpy as np
from pyspark.sql import functions as F

from rankloom.operators import metrics
from rankloom.operators import pairwise as P
from test_rankers import metrics_by_hand, table


def lists_of(rows, m):
    out = {}
    for k, q, _, y, x in rows:
        if k == m:
            out.setdefault(q, []).append((y, x))
    return [(np.array([y for y, _ in v]), np.array([x for _, x in v])) for v in out.values()]


def test_counts_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows, _ = table(spark, rng, 10)
    rows = [(q, i, y, float(rng.normal())) for _, q, i, y, _ in rows] + [(40, 0, 2.0, 1.0), (41, 0, 1.0, 0.5), (41, 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "qid long, doc_id long, y double, h double").repartition(3)
    got = {(r.qid, r.doc_id): (r["count"], r.better) for r in P.pair_counts(df).collect()}
    want = {(q, i): [0.0, 0.0] for q, i, _, _ in rows}
    for (q, i, y, h), (p, j, z, g) in itertools.permutations(rows, 2):
        if q == p and y > z:
            w = np.exp(g - h)
            want[(q, i)][0] += w
            want[(q, i)][1] += w
            want[(p, j)][0] -= w
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_rankboost_equals_pair_enumeration(spark):
    rows, df = table(spark, np.random.default_rng(1), 8, 3, 9)
    got = {}
    model = P.rankboost(df, 3, 4, ["m"])
    for r in model.collect():
        got[(r.m, r["round"])] = (r.feature, r.threshold, r.alpha)
    for m in (0, 1):
        lists = lists_of(rows, m)
        x = np.concatenate([v for _, v in lists])
        pairs, at = [], 0
        for y, _ in lists:
            pairs += [(at + i, at + j) for i, j in itertools.permutations(range(len(y)), 2) if y[i] > y[j]]
            at += len(y)
        hi, lo = (np.array(p) for p in zip(*pairs, strict=True))
        h = np.zeros(len(x))
        for r in (1, 2, 3):
            w = np.exp(h[lo] - h[hi])
            w = w / w.sum()
            found = []
            for f in range(3):
                a, z = x[:, f].min(), x[:, f].max()
                for k in range(1, 5):
                    t = a + k * (z - a) / 5
                    says = (x[:, f] > t).astype(float)
                    found.append((-round(abs((w * (says[hi] - says[lo])).sum()), 9), f, k, (w * (says[hi] - says[lo])).sum(), t))
            _, f, _, share, t = min(found, key=lambda e: e[:3])
            alpha = 0.5 * np.log((1 + share) / (1 - share))
            assert got[(m, r)][0] == f and abs(got[(m, r)][1] - t) < 1e-9 and abs(got[(m, r)][2] - alpha) < 1e-8
            h = h + alpha * (x[:, f] > t)
    scored = P.rankboost_scores(df, P.rankboost(df, 12, 10, ["m"]), ["m"]).withColumn("score", F.round("score", 9))
    chance = metrics.ndcg(df.withColumn("r", F.rand(1)), "r", 5).agg(F.avg("ndcg")).first()[0]
    assert metrics.ndcg(scored, "score", 5).agg(F.avg("ndcg")).first()[0] > chance + 0.1
    assert P.rankboost(df.withColumn("y", F.lit(1.0)), 3).collect() == []


def test_coordinate_ascent_equals_plain_loops_and_never_falls(spark):
    rows, df = table(spark, np.random.default_rng(2), 8, 4, 12)
    options = {"sweeps": 1, "restarts": 2, "n_steps": 3, "first": 0.2, "k": 4, "keys": ["m"]}
    got = {r.m: r for r in P.coordinate_ascent(df, **options).collect()}
    import hashlib

    for m in (0, 1):
        lists = lists_of(rows, m)
        best = None
        for start in (0, 1):
            salt = lambda i: int(hashlib.md5(f"{m}|{start}|w{i}".encode()).hexdigest()[:8], 16) / float(1 << 32)  # noqa: B023, E731
            w = np.full(3, 1 / 3) if start == 0 else np.array([salt(i) for i in range(3)])
            before = 0.0
            for i in range(3):
                means = []
                for s in P.steps(3, 0.2):
                    v = w + s * np.eye(3)[i]
                    means.append(round(float(np.mean([metrics_by_hand(np.round(x @ w + s * x[:, i], 9), y, 4) for y, x in lists])), 9))
                    assert len(v) == 3
                at = int(np.argmax(means))
                assert means[at] >= before - 1e-9
                before = means[at]
                w = w + P.steps(3, 0.2)[at] * np.eye(3)[i]
            if best is None or before > best[0]:
                best = (before, w)
        assert abs(got[m].ndcg - best[0]) < 1e-8 and np.allclose(got[m].weights, best[1], atol=1e-9)
    longer = P.coordinate_ascent(df, **(options | {"sweeps": 2})).collect()
    assert all(r.ndcg >= got[r.m].ndcg - 1e-9 for r in longer)
    scored = P.linear_scores(df, P.coordinate_ascent(df, 1, 1, 3, 0.2, 4)).withColumn("score", F.round("score", 9))
    assert metrics.ndcg(scored, "score", 4).count() == 8
