import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from rankloom.functions import binning, scorecard, text, vectors
from rankloom.operators import dataset as D
from rankloom.operators import metrics as M
from rankloom.operators import splits as S
from rankloom.sources import ltr as L

LTR = "qid long, doc_id long, y double, features array<double>"


def lists(spark, seed=1, queries=12, most=20):
    rng = random.Random(seed)
    rows = [(q, d, float(rng.randrange(5)), [float(rng.randrange(6)), rng.random()]) for q in range(queries) for d in range(rng.randint(1, most))]
    return rows, spark.createDataFrame(rows, LTR)


def test_letor_golden_lines_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.0, [3.0, 0.0, 2.0, 2.0]), (1, 1, 2.0, [3.0, 3.0, 0.0, 0.5])], LTR)
    assert [r[0] for r in df.orderBy("doc_id").select(L.letor_line()).collect()] == ["0 qid:1 1:3 2:0 3:2 4:2", "2 qid:1 1:3 2:3 3:0 4:0.5"]
    L.write_letor(df, f"{tmp_path}/t", decimals=4)
    back = L.read_letor(spark, f"{tmp_path}/t", 4)
    assert sorted((r.qid, r.y, tuple(r.features)) for r in back.collect()) == [(1, 0.0, (3.0, 0.0, 2.0, 2.0)), (1, 2.0, (3.0, 3.0, 0.0, 0.5))]
    with pytest.raises(ValueError, match="announced"):
        L.read_letor(spark, f"{tmp_path}/t", 3)


def test_sparse_letor_fills_zeros(spark):
    lines = spark.createDataFrame([("2 qid:7 2:1.5 4:-3 # doc",), ("0 qid:7",), ("",)], "value string")
    assert [(r.qid, r.y, r.features) for r in L.parse_letor(lines, 4).collect()] == [(7, 2.0, [0, 1.5, 0, -3.0]), (7, 0.0, [0.0] * 4)]
    assert L.feature_count(lines) == 4
    assert L.sparse_letor(lines).first().features == {2: 1.5, 4: -3.0}


def test_split_loader_and_required_columns(spark, tmp_path):
    rows, df = lists(spark, 2, 4)
    for s in ("train", "test"):
        L.write_letor(df, f"{tmp_path}/raw/{s}.txt")
    loader = L.SplitLoader(spark, f"{tmp_path}/raw", f"{tmp_path}/cache")
    found = loader.all()
    assert set(found) == {"train", "test"} and found["train"].count() == len(rows) and loader.get("valid") is None
    with pytest.raises(ValueError, match="missing columns: z"):
        L.require_columns(df, ["qid", "z"])


def test_query_groups_json(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"2": {"0": [1, 2], "1": null}, "4": {"0": [1, 2, 3, 4]}}')
    got = sorted(tuple(r) for r in L.read_query_groups(spark, str(tmp_path / "g.json")).collect())
    assert got == [(2, 0, 1), (2, 0, 2), (4, 0, 1), (4, 0, 2), (4, 0, 3), (4, 0, 4)]


def test_concat_by_query_golden(spark):
    row = lambda q, d: (q, d, 0.0, [0.0])
    a = spark.createDataFrame([row(1, 0), row(1, 1), row(2, 2)], LTR)
    b = spark.createDataFrame([row(1, 0), row(3, 1), row(3, 2)], LTR)
    got = [(r.qid, r.src) for r in D.concat_by_query(a, b).orderBy("qid", "position").collect()]
    assert got == [(1, 0), (1, 0), (1, 1), (2, 0), (3, 1), (3, 1)]
    with pytest.raises(ValueError, match="differ"):
        D.concat(a, b.drop("y"))


def test_filters_and_samples(spark):
    rows, df = lists(spark)
    n = Counter(r[0] for r in rows)
    assert {r.qid for r in D.min_group(df, 8).collect()} == {q for q, c in n.items() if c >= 8}
    assert {r.qid for r in D.first_queries(df, 3).collect()} == {0, 1, 2}
    assert Counter(r.qid for r in D.cap_items(df, 5).collect()) == {q: min(5, c) for q, c in n.items()}
    some = {r.qid for r in D.random_queries(df, 4).collect()}
    assert len(some) == 4 and some == {r.qid for r in D.random_queries(df.repartition(3), 4).collect()}
    assert D.random_queries(df, 99).count() == len(rows)
    assert D.sample_queries(df, 0.5).select("qid").distinct().count() == 6
    assert {r.qid for r in D.query_slice(df, -3, None).collect()} == {9, 10, 11}
    assert D.delete_items(df, df.where("doc_id = 0")).count() == len(rows) - 12
    assert sorted((r.qid, r.offset) for r in D.group_offsets(df).collect()) == list(zip(range(12), np.cumsum([0, *[n[q] for q in range(11)]]).tolist(), strict=True))
    with pytest.raises(ValueError):
        D.sample_queries(df, 1.5)


def test_kfold_golden_and_properties(spark):
    rows = [(q, d, float(y), [float(d), float(q)]) for d, (q, y) in enumerate(zip([100] * 5 + [200] * 3 + [300] * 5, [4, 3, 2, 1, 0, 2, 4, 1, 0, 1, 3, 4, 2], strict=True))]
    df = S.query_kfold(spark.createDataFrame(rows, LTR), 2)
    assert {f: sorted(r.doc_id for r in df.where(f"fold = {f}").collect()) for f in (0, 1)} == {0: [0, 1, 2, 5, 6, 8, 9, 10], 1: [3, 4, 7, 11, 12]}
    assert S.fold_leakage(df).count() == 0
    sizes = {(r.fold, r.qid): (r.n_train, r.n_test) for r in S.fold_distribution(df, 2).collect()}
    assert sizes[(0, 200)] == (1, 2) and sizes[(1, 100)] == (3, 2)
    with pytest.raises(ValueError):
        S.query_kfold(df, 1)


def test_split_sizes(spark):
    rows, df = lists(spark, 3, 30)
    by = Counter((r.qid, r.split) for r in S.holdout_per_query(df, 0.5, 0.2).collect())
    for q, n in Counter(r[0] for r in rows).items():
        tr = n if n < 3 else math.floor(n * 0.5)
        rest = n - tr
        va = rest if rest <= 1 else math.floor(rest * (0.2 / (0.2 + (1 - 0.5 - 0.2))))
        assert (by[(q, "train")], by[(q, "valid")], by[(q, "test")]) == (tr, va, rest - va)
    q = S.holdout_queries(df, 0.6, 0.2).select("qid", "split").distinct().groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in q} == {"train": 18, "valid": 6, "test": 6}
    st = S.stratified(df, "y", 0.7)
    assert st.count() == len(rows)
    n = Counter(r[2] for r in rows)
    assert Counter(r.y for r in st.where("split = 'train'").collect()) == {y: math.floor(c * 0.7) for y, c in n.items()}
    batches = S.query_batches(df, 7).collect()
    assert sorted(Counter(r.batch for r in batches).values()) == sorted(len(x) for x in np.array_split(range(30), 5))


def brute_ndcg(y, s, k):
    """Tie-averaged: gains of a tie group are its mean."""
    if len(y) == 1:
        return 1.0
    order = sorted(range(len(y)), key=lambda i: -s[i])
    mean = {v: np.mean([y[i] for i in range(len(y)) if s[i] == v]) for v in set(s)}
    disc = [1 / math.log2(r + 2) if r < k else 0 for r in range(len(y))]
    ideal = sum(g * d for g, d in zip(sorted(y, reverse=True), disc, strict=True))
    return sum(mean[s[i]] * d for i, d in zip(order, disc, strict=True)) / ideal if ideal else 0.0


def test_ndcg_against_brute_force(spark):
    rows, df = lists(spark, 4, 25)
    got = {(r.qid, r.k): r.ndcg for r in M.ndcg(df.withColumn("s", df.features[0]), "s", [3, 10]).collect()}
    for q in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == q]
        for k in (3, 10):
            assert abs(got[(q, k)] - brute_ndcg([r[2] for r in mine], [r[3][0] for r in mine], k)) < 1e-12
    assert all(0 <= v <= 1 + 1e-12 for v in got.values())
    one = M.summary(M.ndcg(df.withColumn("s", df.features[0]), "s", 3)).first()
    v = [x for (_, k), x in got.items() if k == 3]
    assert np.allclose([one["mean"], one["std"], one["median"]], [np.mean(v), np.std(v), np.median(v)])


@pytest.mark.parametrize("seed", [1, 2])
def test_quantile_cuts_equal_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(q), i, float(v), [0.0]) for q in range(6) for i, v in enumerate(np.round(rng.normal(size=int(rng.integers(1, 90))), int(rng.integers(0, 3))))]
    df = spark.createDataFrame(rows, LTR)
    got = {(r.qid, r.doc_id): r.bin for r in binning.quantile_cut(df, ["qid"], "y", 30).collect()}
    for q in range(6):
        y = pd.Series([r[2] for r in rows if r[0] == q])
        want = pd.qcut(y, min(30, y.nunique()), labels=False, duplicates="drop").fillna(0).astype(int).tolist()
        assert [got[(q, i)] for i in range(len(y))] == want
    y = np.array([r[2] for r in rows])
    edges = binning.global_edges(df, "y", 6)
    assert np.allclose(edges, sorted(set(np.quantile(y, np.linspace(0, 1, 7))))[1:-1])


def test_small_functions(spark):
    assert text.rename_features("X_0 <= 1 & X_12 > 2", ["a", "b"]) == "a <= 1 & X_12 > 2"
    row = spark.createDataFrame([(0.5, -0.25, "NDCG@10 on training data: 0.1\nNDCG@10 on training data: 0.25")], "a double, b double, log string")
    r = row.select(text.no_leading_zero(row.a).alias("a"), text.no_leading_zero(row.b, 2).alias("b"), text.last_ndcg(row.log, "training").alias("c"), text.last_ndcg(row.log, "test").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (".500", "-.25", 0.25, None)
    assert vectors.pair_feature_names(["q"], ("pair", "abs_diff", "sq_diff")) == ["A_q", "B_q", "|A_q - B_q|", "(A_q - B_q)^2"]
    p = spark.createDataFrame([("r", 0.9, 3), ("r", -0.9, 5), ("s", 0.5, 1)], "rule string, weight double, support long")
    assert [tuple(x) for x in scorecard.to_points(p).collect()] == [("s", 14, 1)]
