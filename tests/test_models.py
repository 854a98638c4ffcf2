import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import clustering, rtr, selection, sensitivity, splits, synthetic
from rankloom.operators import trees as T
from rankloom.streaming import scorer

LTR = "qid long, doc_id long, y double, features array<double>"


def twin(x, y, depth, node=1):
    """Leaf node of each row by plain recursion."""
    out = np.full(len(y), node)
    if depth == 0 or len(y) < 2:
        return out
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            gain = round(y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y), 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, left)
    if best is None:
        return out
    left = best[1]
    out[left] = twin(x[left], y[left], depth - 1, 2 * node)
    out[~left] = twin(x[~left], y[~left], depth - 1, 2 * node + 1)
    return out


def table(spark, seed=0, queries=6, docs=40):
    rng = random.Random(seed)
    rows = [(q, d, float(rng.randrange(8)), [float(rng.randrange(10)), rng.random(), float(rng.randrange(3))]) for q in range(queries) for d in range(docs)]
    return rows, spark.createDataFrame(rows, LTR)


def test_grouped_trees_equal_the_twin(spark):
    rows, df = table(spark)
    trees = T.grow(df.withColumnRenamed("y", "target"), ["qid"], 3)
    got = {(r.qid, r.doc_id): (r.leaf, r.score) for r in T.apply(df, trees, ["qid"]).collect()}
    for q in range(6):
        mine = [r for r in rows if r[0] == q]
        x, y = np.array([r[3] for r in mine]), np.array([r[2] for r in mine])
        nodes = twin(x, y, 3)
        for i, r in enumerate(mine):
            leaf = "R" + format(int(nodes[i]), "b")[1:].replace("0", "l").replace("1", "r")
            assert got[(q, r[1])][0] == leaf and abs(got[(q, r[1])][1] - y[nodes == nodes[i]].mean()) < 1e-9
    few = T.grow(df.withColumnRenamed("y", "target"), ["qid"], 3, max_leaves=3)
    assert few.where("is_leaf").groupBy("qid").count().where("count > 3").count() == 0
    assert T.grow(df.withColumnRenamed("y", "target"), ["qid"], 3, min_split=41).count() == 6


def test_full_is_score_plus_correction_and_unknown_leaves_get_none(spark):
    _, df = table(spark, 1)
    df = splits.query_kfold(df, 4).withColumn("model_key", F.col("qid") % 2)
    train, test = df.where("fold <> 0 and qid <> 5"), df.where("fold = 0")
    for mixed in (False, True):
        p = rtr.fit(train, rtr.Config(mixed=mixed)).predict(test).collect()
        assert len(p) == test.count()
        assert all(abs(r.full - r.score - r.correction) < 1e-9 for r in p)
        if mixed:
            assert all(r.correction == 0 for r in p if r.qid == 5)
    r = rtr.fit(train, rtr.Config())
    residual = r.store.groupBy("model_key", "leaf").agg(F.abs(F.avg("value")).alias("m")).agg(F.max("m")).first()[0]
    assert residual < 1e-9
    e = rtr.explain(r, test.limit(1)).first()
    assert len(e.neighbours) == 5 and len(e.rule_shallow) == len(e.shallow_path) - 1
    with pytest.raises(ValueError, match="without a model"):
        rtr.dispatch(df.drop("model_key"), splits.query_batches(train, 2))


def test_model_selection_pieces(spark):
    g = selection.grid(spark, {"a": [1, 2], "b": ["x", "y"]}, {"c": 0.5})
    assert g.count() == 4 and selection.configs_to_do(g, g.where("a = 1")).count() == 2
    rows = [(1, [("c0",), ("c1",)], [0.5, 0.7], 1), (2, [("c0",), ("c1",)], [0.3, 0.3], 0)]
    df = spark.createDataFrame(rows, "query long, configs array<struct<n:string>>, results array<double>, idx_best int")
    assert {r.query: r.config.n for r in selection.best_config(df).collect()} == {1: "c1", 2: "c0"}
    assert [r.query for r in selection.drop_tied(df).collect()] == [1]
    assert {r.query: r.idx for r in selection.argmax(selection.explode_results(df), ["query"], "result", "idx").collect()} == {1: 1, 2: 0}


@pytest.mark.parametrize(("values", "kind", "want"), [([True, False], "boolean", [False, True]), ([8, 2, 4], "int", [2, 4, 8]), (["y", "dist"], "string", ["dist", "y"])])
def test_level_order_golden(spark, values, kind, want):
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"f {kind}")
    assert [r.level for r in sensitivity.ordered_levels(df, "f").orderBy("place").collect()] == want


def test_latex_and_delta(spark):
    df = spark.createDataFrame([("d", 1, "base", 0.5), ("d", 1, "new", 0.75)], "dataset string, qxm int, model string, mean double")
    assert sensitivity.baseline_delta(df, "base").first().delta == 0.25
    assert r"1 & .500 \\" in sensitivity.latex_table(spark.createDataFrame([(1, ".500")], "phi int, rtr string"), "phi", ["rtr"])


def test_groups_are_complete_and_of_one_size(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(i), rng.normal(size=4).tolist()) for i in range(11)], "qid long, features array<double>")
    d = clustering.query_distances(df)
    got = clustering.greedy_groups(d, 4).collect()
    assert sorted(r.qid for r in got) == list(range(11))
    sizes = [sum(r.group_id == g for r in got) for g in range(3)]
    assert sizes == [4, 4, 3]
    dist = {(r.qid, r.other): r.distance for r in d.collect()}
    assert {r.qid for r in got if r.group_id == 0} == {0, *sorted(range(1, 11), key=lambda q: dist[(0, q)])[:3]}


def test_more_queries_than_the_driver_held_before(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2100, 4))
    x[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, features array<double>")
    assert clustering.query_distances(df).select("qid", "other").distinct().count() == 2100 * 2100
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.nan_to_num(np.round(1 - u @ u.T, 12), nan=2.0)
    left, want = np.ones(2100, bool), {}
    for seed in range(2100):
        if left[seed]:
            left[seed] = False
            near = [q for q in np.argsort(d[seed], kind="stable").tolist() if left[q]][:7]
            left[near] = False
            want |= dict.fromkeys([seed, *near], len(set(want.values())))
    assert {r.qid: r.group_id for r in clustering.greedy_query_groups(df, 8).collect()} == want


def test_generator_repeats_itself(spark):
    a, b = (sorted(map(str, synthetic.generate(spark, 5, 8, 3).repartition(n).collect())) for n in (1, 3))
    assert a == b and len(a) == 40


def test_streaming_scorer(spark, tmp_path):
    rows, df = table(spark, 5, 3, 20)
    trees = T.grow(df.withColumnRenamed("y", "target"), ["qid"], 2)
    df.write.parquet(f"{tmp_path}/in")
    q = scorer.start(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), trees, ["qid"], f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = T.apply(df, trees, ["qid"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(("copies", "most"), [(75, 40), (1, 11)])
def test_grouping_takes_few_rounds_and_settles_ties_of_copies(spark, monkeypatch, copies, most):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(3000 // copies, 3)), copies, axis=0)[rng.permutation(3000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, features array<double>")
    rounds, greedy = [], clustering._greedy
    monkeypatch.setattr(clustering, "_greedy", lambda s, qids, nearest, n: greedy(s, qids, lambda *a: rounds.append(1) or nearest(*a), n))
    got = {r.qid: r.group_id for r in clustering.greedy_query_groups(df, 2).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 12) + 0.0
    left, want = np.ones(3000, bool), {}
    for seed in range(3000):
        if left[seed]:
            left[seed] = False
            near = [q for q in np.argsort(d[seed], kind="stable").tolist() if left[q]][:1]
            left[near] = False
            want |= dict.fromkeys([seed, *near], len(set(want.values())))
    # With 128 seeds a time, 1,500 groups took 12 rounds at least.
    assert got == want and len(rounds) <= most


def test_distances_of_half_the_pairs_equal_rounded_ones_of_all(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), np.round(rng.normal(size=3), 1).tolist()) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, [1.0, None, 2.0]), (42, None)]
    df = spark.createDataFrame(rows, "qid long, features array<double>")
    half = {(r.qid, r.other): r.distance for r in clustering.query_distances(df, 6, upper=True).collect()}
    every = clustering.query_distances(df)
    want = {(r.qid, r.other): r.d for r in every.selectExpr("qid", "other", "round(distance, 6) AS d").collect() if r.qid < r.other}
    assert every.count() == 43 * 43 and half == want and len(want) == 43 * 21 and half[(0, 40)] is half[(0, 41)] is half[(0, 42)] is None
    assert clustering.half_up(np.array([0.5000005, -0.5000005, 1.0000015, 0.1234564]), 6).tolist() == [0.500001, -0.500001, 1.000002, 0.123456]


def test_blocks_of_queries_grow_so_that_copies_do_not_grow_with_their_number(spark, monkeypatch):
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(q, rng.normal(size=3).tolist()) for q in range(200)], "qid long, features array<double>")
    say = lambda: {(r.qid, r.other): r.distance for r in clustering.query_distances(df, 6, upper=True).collect()}
    want, sent, real = say(), [], clustering.groups.map_groups
    monkeypatch.setattr(clustering.groups, "map_groups", lambda dealt, *a, **k: sent.append(dealt.count()) or real(dealt, *a, **k))
    monkeypatch.setattr(clustering, "BLOCK", 16)
    monkeypatch.setattr(clustering, "BLOCKS", 4, raising=False)
    assert say() == want and len(want) == 200 * 199 // 2
    assert sent == [4 * 200]
    assert clustering.blocks_for(540_000, 8) == 33
