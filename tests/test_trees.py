import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import trees as T

ROWS = "m long, k string, features array<double>, target double, weight double"


def table(rng, sizes, d=3):
    rows = []
    for m, n in enumerate(sizes):
        x = np.concatenate([rng.integers(0, 6, (n, 1)), rng.normal(size=(n, d - 2)), rng.exponential(size=(n, 1)) ** 8], axis=1)
        y = 3.0 * (x[:, 1] > 0.3) + x[:, 0] + rng.normal(size=n)
        rows += [(m, "ab"[m % 2], r.tolist(), float(t), float(w)) for r, t, w in zip(x, y, rng.integers(1, 4, n), strict=True)]
    return rows


def facts(trees, *keys):
    return {(*[r[k] for k in keys], r.path): (r.is_leaf, r.feature, None if r.threshold is None else round(r.threshold, 9), round(r.prediction, 8), r.n) for r in trees.collect()}


@pytest.mark.parametrize(("options", "bins"), [({}, 8), ({"weight": "weight", "min_split": 30}, 16), ({"max_leaves": 5, "draw": ("m", 2)}, 4)])
def test_histograms_grow_the_trees_of_whole_models(spark, options, bins):
    rows = table(np.random.default_rng(7), [260, 3, 90, 1, 400])
    rows[5] = (0, "a", [1.0, 0.1, 1e12], 2.0, 1.0)  # an outlier
    rows += [(9, None, [1.0, 2.0, 3.0], 1.0, 1.0)] * 40 + [(10, None, [float(i % 3), 0.0, 0.0], 0.5, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    whole = facts(T.grow(df, ["m", "k"], 3, **options), "m", "k")
    some = 600 if "draw" in options else 0
    assert whole == facts(T.grow(df, ["m", "k"], 3, cells=some, bins=bins, **options), "m", "k")
    assert whole[(9, None, "R")] == (True, None, None, 1.0, 40) and whole[(10, None, "R")][0]


def test_one_model_with_a_hot_value_and_noise(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = np.where(rng.random((n, 2)) < 0.34, 7.0, rng.normal(size=(n, 2)))
    rows = [(0, "a", v.tolist(), float(t), 1.0) for v, t in zip(x, rng.normal(size=n), strict=True)]
    df = spark.createDataFrame(rows, ROWS)
    assert facts(T.grow(df, [], 2)) == facts(T.grow(df, [], 2, cells=0, bins=32))


def test_a_level_shuffles_bins_not_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(0, "a", [float(v)], float(3 * (v > 0.5) + 0.01 * t), 1.0) for v, t in zip(rng.random(20_000), rng.normal(size=20_000), strict=True)]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    cells = df.select(F.posexplode("features").alias("f", "v"), F.floor(F.col("features")[0] * 64).alias("b"), "target")
    assert cells.groupBy("f", "b").count().count() <= 65
    (tree,) = [r for r in T.grow(df, [], 1, cells=0, bins=64).collect() if not r.is_leaf]
    assert abs(tree.threshold - 0.5) < 1e-3 and facts(T.grow(df, [], 1)) == facts(T.grow(df, [], 1, cells=0, bins=64))


def test_features_drawn_by_spark_and_here_are_the_same(spark):
    df = spark.range(40).select((F.col("id") % 5 - 2).alias("key"), (F.col("id") % 7 + 1).alias("node")).distinct().withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(5))))
    got = {}
    for r in df.withColumn("h", F.xxhash64(F.col("key").cast("long"), F.col("node").cast("long"), F.col("f").cast("long"))).orderBy("h", "f").collect():
        got.setdefault((r.key, r.node), []).append(r.f)
    assert all(T.drawn_features(k, n, 6, 3) == fs[:3] for (k, n), fs in got.items())


def test_groups_come_whole_however_batches_are_cut(spark):
    from rankloom.operators import groups

    rows = [(k, i) for k in range(40) for i in range(1 + 37 * k % 50)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(5)

    def sizes(table, first):
        n = np.diff(np.append(first, table.num_rows))
        yield groups.pa.RecordBatch.from_arrays([table.column("k").take(groups.pa.array(first)).combine_chunks(), groups.pa.array(n)], names=["k", "n"])

    want = {k: sum(1 for x, _ in rows if x == k) for k, _ in rows}
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        for most in (1, 700, 1 << 20):
            got = groups.map_groups(df, ["k"], sizes, "k long, n long", ["i"], most).collect()
            assert len(got) == len(want) and {r.k: r.n for r in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    assert groups.map_groups(df.limit(0), ["k"], sizes, "k long, n long").collect() == []


def test_gains_are_compared_as_plain_sums_give_them():
    """One row against eight from either side: the gains are equal, but not to the ninth decimal of plain sums."""
    t = np.array([69.69937, 64.50436, 13.73578, 12.2571, 65.68121, 85.49225, 20.97613, 22.58385, 131.94188])
    x = np.column_stack([[*range(1, 9), 0], [*range(8)] + [9]]).astype(float)
    slot = np.zeros(9, np.int64)
    gains = []
    for c in (0, 1):
        order = np.argsort(x[:, c])
        n, s = np.arange(1.0, 9), np.cumsum(t[order])
        gains.append(np.round(s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (9 - n) - s[-1] ** 2 / 9, 9))
    best = max((g[i], -c, -i) for c, g in enumerate(gains) for i in range(8))
    feature, threshold, gain = T.best_of(x, t, np.ones(9), slot, 1, 2)
    assert (gain[0], feature[0]) == (best[0], -best[1])


def test_gains_that_end_in_a_half_are_rounded_as_in_sql():
    """The gain of 574.5266098605 becomes 574.526609861; that of the other feature is one double less, and rounded down."""
    x = np.array([[46.0, 3470.0], [34.0, 3487.0], [44.0, 3484.0], [29.0, 3489.0], [6.0, 3483.0]])
    t = np.array([32036.4, 1600.97, 4167.85, 9895.5, 5287.38]) / 1000
    feature, threshold, gain = T.best_of(x, t, np.ones(5), np.zeros(5, np.int64), 1, 2)
    assert (feature[0], threshold[0], gain[0]) == (1, 3476.5, 574.526609861)


def test_one_small_tree_is_applied_as_compiled_tests(spark):
    rng = np.random.default_rng(10)
    rows = [(i, float(rng.normal()), [float(v) for v in rng.normal(size=2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, target double, features array<double>")
    tree = T.grow(df, [], 3)
    more = df.unionByName(spark.createDataFrame([(900, 0.0, None), (901, 0.0, [float("nan"), 9.0]), (902, 0.0, [None, None])], df.schema))
    one = T.apply(more, tree, [])
    keyed = T.apply(more.withColumn("m", F.lit(1)), tree.withColumn("m", F.lit(1)), ["m"]).drop("m")
    assert one.columns == keyed.columns and sorted(map(str, one.collect())) == sorted(map(str, keyed.collect()))
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
