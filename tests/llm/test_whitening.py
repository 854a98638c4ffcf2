import numpy as np
import pytest

from rankloom.llm import whitening as Wh

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def brute(rows, r):
    """Whole numbers, exact deviations, eigenvalues and whitened rows of vectors of one length."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(object) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = np.array([[int(n * v - t) for v, t in zip(row, s, strict=True)] for row in x], object)
    c = y.astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [int(sum(v * v for v in row)) for row in y], values[:r], values.sum(), c @ vectors[:, :r] / np.sqrt(values[:r])


def spread(rng, n, d):
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(n, d)) * np.linspace(0.2, 3, d) + 5)]


def test_equals_brute_force_and_whitens(spark):
    rows = spread(np.random.default_rng(0), 700, 10)
    odd = [(900, None), (901, [1.0] * 9 + [None]), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9), (904, [])]
    more = [(905, [0.0] * 10), rows[3], (None, [1.0] * 10)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows + odd + more], SCHEMA).repartition(5)
    kept = rows + more
    deviations, values, trace, white = brute(kept, 4)
    got = Wh.digest(df, 4).collect()
    assert len(got) == 4 * len(kept)
    by = {}
    for r in got:
        assert r.n == len(kept) and abs(r.explained - values[r.component - 1] / trace) < 1e-9 and r.identity_error < 1e-9
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = {}
    for (i, _), d, w in zip(kept, deviations, white, strict=True):
        for c in range(1, 5):
            own = by[(i, d)][c]
            sign = signs.setdefault(c, np.sign(own[0] * w[c - 1]))
            assert abs(own[0] - sign * w[c - 1]) < 1e-7
    assert len(by[(3, deviations[3])][1]) == 2
    full = np.array([[r.whitened for r in got if r.component == c] for c in range(1, 5)])
    assert abs(np.cov(full, bias=True) - np.eye(4)).max() < 1e-9


def test_few_rows_flat_components_and_other_lengths(spark):
    none = Wh.digest(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and none.collect() == []
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 3.0])], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.component): r for r in Wh.digest(df).collect()}
    assert len(got) == 4 + 6 and all(got[(i, c)].whitened is None and got[(i, c)].explained == 0 and got[(i, c)].deviation == 0 for i in (1, 2) for c in (1, 2))
    assert abs(abs(got[(3, 1)].whitened) - 1) < 1e-12 and got[(3, 1)].explained == 1 and got[(3, 2)].whitened is None and got[(3, 1)].n == 2


@pytest.mark.parametrize("cuts", [[1], [100, 101], list(range(1, 300, 7))])
def test_merge_in_any_order_and_whole_numbers_far_from_zero(cuts):
    rng = np.random.default_rng(1)
    x = rng.integers(-400, 400, (300, 5)) + 10**11
    parts = [Wh.Moments.of(p) for p in np.split(x, cuts)]
    m = parts[0]
    for p in rng.permutation(len(parts) - 1):
        m = m.merge(parts[p + 1])
    centre = np.array([sum(int(v) for v in col) / 300 for col in x.T])
    want = (x - centre).T @ (x - centre)
    assert m.n == 300 and m.total == [sum(int(v) for v in col) for col in x.T]
    assert abs(m.scatter - want).max() < 1e-6 * abs(want).max()


def test_deviations_beyond_64_bits():
    w = Wh.Whitening(3, [0, 3], np.ones(2), np.eye(2), 2.0)
    sums = w.apply(np.array([[1 << 50, 0], [5, 1]]))[1]
    assert sums == [None, 225]
