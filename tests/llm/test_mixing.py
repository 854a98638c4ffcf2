import random
from collections import Counter

import numpy as np

from rankloom.llm import mixing


def test_permutation_is_one_and_can_be_undone():
    for n in (1, 2, 3, 5, 64, 1000, 1025):
        keys = mixing._keys(1, 2, 3)
        p = mixing.permute(np.arange(n), n, keys)
        assert sorted(p.tolist()) == list(range(n))
        assert mixing.permute(p, n, keys, back=True).tolist() == list(range(n))


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1]) == [187.5, 75, 37.5]
    t = mixing.water_fill([10, 1000, 0, 50], [5, 2, 1, 5])
    assert t[0] == 30 and t[3] == 150 and t[2] == 0 and abs(sum(t) - 1060) < 1e-9
    assert mixing.water_fill([], []) == []


def test_shard_counts_add_up_and_number_slots():
    counts = mixing.shard_counts([5000, 0, 700, 1], shards=4, least=10)
    for i, n in enumerate([5000, 0, 700, 1]):
        own = [(f, c) for _, s, f, c in counts if s == i]
        assert sum(c for _, c in own) == n
        assert [f for f, _ in own] == np.cumsum([0, *[c for _, c in own]])[:-1].tolist()[: len(own)]


def rows_of(rng):
    rows = []
    for i in range(120):
        source = rng.choice(["a", "b", "é", None, "hot", "hot", "hot"])
        n = rng.choice([0, 1, 7, 40, 700, 1500])
        rows.append((i, " \t".join(f"w{i}_{j}" for j in range(n)) if n else rng.choice([None, "", " \n"]), source, 1.5, 3))
    return [*rows, rows[5], rows[5], (None, "only three words", "tiny", 2.5, 4)]


def test_taken_meets_targets_and_documents_match(spark):
    rows = rows_of(random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, size int")
    mix = mixing.Mix(docs, block=64, keep=True)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, mixing.Mix(docs.repartition(7), block=64).taken().collect()), key=str) == sorted(map(tuple, got), key=str)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((k, len((t or "").split())) for k, t, *_ in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    size = Counter()
    for _, t, s, *_ in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in {r[2] for r in rows}), key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.water_fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    by = {k: s for k, _, s, *_ in rows}
    taken = Counter()
    for r in got:
        assert r.source_size == size[by[r.doc_id]] and abs(r.target - want[by[r.doc_id]]) < 1e-6
        taken[by[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)
    out = mix.documents()
    assert out.schema == docs.schema
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= {w for k, t, *_ in rows if k == r.doc_id for w in t.split()}
    per = Counter()
    for r in got:
        per[r.doc_id] += r.taken
    assert +words == +per


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.digest(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in mixing.digest(spark.createDataFrame([(1, None, None)], schema)).collect()] == [(1, 0, 0, 0.0, 0)]


def packed(rows, block):
    """taken of each row: sources packed document after document in the operator's order, blocks counted by the plan's slots."""
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len((t or "").split()) for _, t, q in rows if q == s) for s in order}
    plan = mixing.quotas([(s, sizes[s]) for s in order], mixing.WEIGHTS, block, mixing.SEED)
    assert [q.source for q in plan] == order
    return plan


def test_taken_equals_an_independent_packing(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.choice([1, 30, 90, 200]))), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [rows[4]] * 7 + [rows[9]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.Mix(docs, block=64, stretch=3)
    plan = packed(rows, 64)
    spans = {r.uid: (r.ix, r.start, r.size) for r in mix.spans.collect()}
    ids = {r.uid: r.doc_id for r in mix.rows.select("uid", "doc_id").collect()}
    # The documents of a source lie end to end, without gaps, and copies side by side.
    for ix, q in enumerate(plan):
        own = sorted((start, size, ids[u]) for u, (i, start, size) in spans.items() if i == ix)
        at = 0
        for start, size, _ in own:
            assert start == at
            at += size
        assert at == q.size
        names = [d for *_, d in own]
        assert all(names[a] == names[b] for d in set(names) for a, b in [(names.index(d), len(names) - 1 - names[::-1].index(d))] for b in range(a, b + 1))
    # Words taken, by walking each source's slots through its permutation of blocks.
    taken = {}
    for ix, q in enumerate(plan):
        times = Counter()
        for k in range(q.slots):
            at = int(mixing.permute(np.array([k % q.blocks]), q.blocks, mixing._keys(mixing.SEED, ix, k // q.blocks))[0])
            first, last = at * 64, min(q.size, at * 64 + 64)
            if k == q.slots - 1 and q.last_words >= 0:
                last = first + q.last_words
            times.update(range(first, last))
        for u, (i, start, size) in spans.items():
            if i == ix:
                taken[u] = sum(times[w] for w in range(start, start + size))
    assert sorted((ids[u], n) for u, n in taken.items()) == sorted((r.doc_id, r.taken) for r in mix.taken().collect())


def test_passes_keep_columns_of_any_name(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40)), "s", i + 0.5, "z") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` double, `Runs x` string")
    out = mixing.Mix(docs, block=16, keep=True).documents()
    assert out.columns == docs.columns and {(r.doc_id, r["a.b"], r["Runs x"]) for r in out.collect()} <= {(i, x, z) for i, _, _, x, z in rows}
