import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import ann


def brute(rows, asks, k):
    out = {}
    for i, q in rows:
        if asks(i):
            near = sorted(((-float(np.dot(q, v)), j) for j, v in rows if j != i))[:k]
            out[i] = [j for _, j in near]
    return out


def frames(rng, n=1500, d=12):
    centres = rng.normal(size=(20, d))
    return [(i, (rng.uniform(0.2, 3) * (centres[i % 20] + rng.normal(size=d) * 0.5)).tolist()) for i in range(n)]


def test_recall_scores_and_ranks(spark):
    rows = frames(np.random.default_rng(5))
    odd = [(9000, None), (9020, [0.0] * 12), (9040, [1.0] * 11 + [None]), (9060, [float("nan")] * 12), (9080, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 3, 0.5) for i, v in rows + odd + [rows[0], rows[7]]], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    vectors = dict(rows)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10, per_list=50, rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, lambda i: i % 20 == 0, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x for x, _, _ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda x: (-x[2], x[1])) and q not in [v for _, v, _ in found]
        assert all(abs(s - np.dot(vectors[q], vectors[v])) < 1e-9 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want[q]))
    assert hits / (10 * len(want)) >= 0.9


def test_few_candidates_ties_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(0, 30)], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") == 20, k=5, rows=8).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert ann.search(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert ann.search(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_walks_find_what_a_scan_finds():
    rng = np.random.default_rng(6)
    c = rng.normal(size=(600, 8))
    g = ann.Graph.build(c)
    miss = total = 0
    for x in rng.normal(size=(40, 8)):
        d = np.sqrt(((c - x) ** 2).sum(axis=1))
        want = set(np.flatnonzero(d <= 1.2 * d.min()).tolist())
        rows, lists = g.nearest(np.array([x, c[0]]), 0.2)
        assert rows.tolist() == sorted(rows) and lists[rows == 1][0] == 0
        miss += len(want - set(lists[rows == 0].tolist()))
        total += len(want)
    assert miss / total < 0.05


def test_a_query_in_a_small_tight_cluster_looks_beyond_it(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tight = x[0] + rng.normal(size=(6, 16)) * 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([tight, x[6:]]))]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 6, k=20, per_list=40).collect()
    want = brute(rows, lambda i: i < 6, 20)
    assert len(got) == 120
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * 120


def test_pruning_widens_until_sample_queries_reach_the_recall(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 30 == 0, k=5, per_list=20, prune=0.0).collect()
    want = brute(rows, lambda i: i % 30 == 0, 5)
    assert len(got) == 500
    assert sum(r.vec_id in want[r.query_id] for r in got) >= ann.RECALL * 500


def test_a_row_repeated_often_leaves_room_for_others(spark):
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 6)) * 0.05 + 1)]
    near = [(7, (np.array(rows[7][1]) + 2 + 1e-4 * j).tolist()) for j in range(300)]
    df = spark.createDataFrame(rows + [rows[3]] * 400 + near, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id").isin(0, 1), k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    best = [(i, v) for i, v in rows if i != 7] + [near[-1]]
    for q in (0, 1):
        want = sorted((-float(np.dot(rows[q][1], v)), i) for i, v in best if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i) for n, (_, i) in enumerate(want)]


def found_by(df, asks, **knobs):
    got = {}
    for r in ann.search(df, asks, **knobs).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in got.items()}


def test_recall_at_production_constants(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(300, 32))
    x = centres[rng.integers(0, 300, 20_000)] + rng.normal(size=(20_000, 32)) * 0.6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_by(df, F.col("vec_id") % 100 == 0)
    q = x[::100]
    truth = np.argsort(-(q @ x.T) + np.where(np.arange(200)[:, None] * 100 == np.arange(20_000)[None, :], np.inf, 0), axis=1)[:, :20]
    hits = sum(len({v for _, v, _ in got[100 * k]} & set(t.tolist())) for k, t in enumerate(truth))
    assert hits / (20 * 200) >= 0.93


def test_huge_tiny_and_outlying_vectors(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 8))
    for scale in (1e200, 1e-200, 1e6):
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, (x[0] * scale).tolist())]
        got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=10, per_list=20)
        with np.errstate(over="ignore"):
            want = brute(rows, lambda i: i % 20 == 0, 10)
        assert got.keys() == want.keys() and all(len(r) == 10 for r in got.values())
        assert sum(len({v for _, v, _ in got[i]} & set(want[i])) for i in want) >= 0.95 * 10 * len(want)


def test_an_outlier_leaves_pruning_as_it_is():
    counts = [(64, 0, 100_000), (64, 1, 500), (64, -1, 2000), (64, 20, 1), (64, 664, 1), (3, 0, 10)]
    bands = ann.bands_of([(*c, c[1] + 0.5) for c in counts])
    assert [(b.dim, b.low, b.high, b.n) for b in bands] == [(64, 664, 664, 1), (64, 20, 20, 1), (64, -1, 1, 102_500), (3, 0, 0, 10)] and bands[2].longest == 1.5
    many = ann.bands_of([(2, 10 * e, 5 + e, 10.0 * e) for e in range(-30, 30)])
    assert len(many) == ann.MOST_BANDS and sum(b.n for b in many) == sum(5 + e for e in range(-30, 30))


def test_other_lengths_and_ids_that_ask_twice(spark):
    rng = np.random.default_rng(14)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))] + [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(5, 3)))]
    rows += [(20, [9.0, 9.0, 9.0, 9.0]), (20, [-9.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [found_by(d, F.col("vec_id").isin(100, 20), k=4) for d in (df, df.repartition(5))]
    assert got[0] == got[1] and {v for _, v, _ in got[0][100]} == {101, 102, 103, 104} and len(got[0][20]) == 4


def test_a_small_beam_finds_what_a_scan_finds():
    rng = np.random.default_rng(15)
    c, x = rng.normal(size=(500, 6)), rng.normal(size=(50, 6))
    g, sizes = ann.Graph.build(c), rng.integers(1, 50, 500)
    d = np.sqrt(((c[None] - x[:, None]) ** 2).sum(axis=2))
    for need in (0, 300):
        order = np.argsort(d, axis=1)
        reach = (np.cumsum(sizes[order], axis=1) < need).sum(axis=1)
        low = np.take_along_axis(d, order, 1)[np.arange(50), reach]
        want = set(zip(*np.nonzero(d <= low[:, None] * 1.3), strict=True))
        for beam in (4, 64, 1000):
            rows, lists = g.nearest(x, 0.3, None, sizes, need, beam=beam)
            assert len(want - set(zip(rows, lists, strict=True))) <= 0.05 * len(want) and set(zip(rows, lists, strict=True)) <= want
