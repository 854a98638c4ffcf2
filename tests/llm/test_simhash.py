import random

import xxhash

from rankloom.llm import simhash
from rankloom.llm.common import Scratch
from rankloom.llm.components import connected_components


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Union-find over all pairs: [(id, fp)] -> {position: smallest id}."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [low.get(find(i)) for i in range(len(fps))]


def test_whole_result_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(20, 200))
        for _ in range(rng.randint(1, 5)):
            w = list(words)
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = "Changed"
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "one", "one two", "ONE two", "a\x0bb\x0cc d", "é É à", "x" * 50_000, "word " * 20_000]
    rows = [(i * 3 + 1, t, "zz", 0.5) for i, t in enumerate(texts)] + [(1, texts[0], "zz", 0.1), (None, texts[2], "q", 0.2)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id double")
    got = sorted(map(tuple, simhash.digest(docs).collect()), key=str)
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted([(k, f"{fp:016x}", c) for (k, fp), c in zip(fps, brute_components(fps), strict=True)], key=str)
    assert got == want


def test_links_of_crowded_and_random_fingerprints(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)} | {rng.getrandbits(64) for _ in range(200)}
    for x in list(fps)[:100]:
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    scratch = Scratch(spark, "t")
    roots = {r.id: r.root for r in connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), scratch), scratch).collect()}
    want = brute_components(list(enumerate(fps)))
    groups = {}
    for x, c in zip(signed, want, strict=True):
        groups.setdefault(c, []).append(x)
    assert {x: roots.get(x, x) for x in signed} == {x: min(g) for g in groups.values() for x in g}


def test_components_chain_star_and_empty(spark):
    scratch = Scratch(spark, "t")
    edges = [(i, i + 1) for i in range(100, 160)] + [(999, i) for i in range(500, 600)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), scratch).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in [*range(500, 600), 999]}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), scratch).count() == 0


def test_empty_table(spark):
    assert simhash.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_chain_in_label_order_and_large_star(spark):
    scratch = Scratch(spark, "t")
    chain = spark.range(3000).selectExpr("id AS src", "id + 1 AS dst").repartition(100)
    star = spark.range(20_000).selectExpr("id + 10000 AS src", "9999L AS dst")
    both = spark.createDataFrame([(3000, 9000), (9000, 9001)], "src long, dst long")
    got = connected_components(chain.unionByName(star).unionByName(both), scratch)
    assert {tuple(r) for r in got.groupBy("root").count().collect()} == {(0, 3003), (9999, 20_001)}
