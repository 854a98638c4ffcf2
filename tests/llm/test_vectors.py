import numpy as np

from rankloom.llm import neardup


def brute(rows, threshold):
    """(vec_id, n_links, component_id) per row by all pairs."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            i, j = good[a], good[b]
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i in good:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return [(k, n, low[find(i)] if i in good else k) for i, ((k, _), n) in enumerate(zip(rows, links, strict=True))]


def test_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for _ in range(30):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((1000 - n, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.2])).tolist()))
            n += 1
    rows += [(2000 + i, rows[0][1]) for i in range(5)] + [(3000, (2 * np.array(rows[0][1])).tolist())]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [1.0] * 15 + [None]), (4003, [float("nan")] + [1.0] * 15), (4004, [float("inf")] + [1.0] * 15), (4005, [1.0, 2.0]), (4006, [2.0, 4.0]), (4007, []), (None, rows[0][1]), rows[3], (4008, [-0.0] * 16)]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, n long, rep string")
    want = sorted(brute(rows, 0.95), key=str)
    for knobs in ({}, {"rows": 4}, {"rows": 4, "listed": 0}):
        got = neardup.near_duplicates(df, **knobs).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_plan_misses_few():
    """Pairs at the threshold, as random signs give them, meet in a table and pass the mark."""
    rng = np.random.default_rng(3)
    for n in (1, 500, 10**6, 10**10):
        bits, tables, most = neardup.plan(n)
        mask = neardup.masks(neardup.subsets(bits, tables, 1))
        differ = rng.random((4000, neardup.WIDTH)) < np.arccos(0.95) / np.pi
        x = np.packbits(differ, axis=1).view(np.uint64)
        met = np.any([((x & m) == 0).all(axis=1) for m in mask], axis=0)
        assert met.mean() >= 0.999 and (differ.sum(axis=1) <= most).all()


def test_marks_and_links_of_a_large_group(spark):
    """A third of the vectors within one ball: every pair of them links, and is counted once."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=24)
    rows = [(i, (base + rng.normal(size=24) * 0.03).tolist()) for i in range(150)] + [(1000 + i, rng.normal(size=24).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(brute(rows, 0.95))
    for knobs in ({}, {"rows": 16}):
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.near_duplicates(df, **knobs).collect()) == want
