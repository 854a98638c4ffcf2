import math
import random
import re
from collections import Counter

import pytest

from rankloom.llm import lexical

FOUND = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in FOUND.findall(text or "")]


def brute(docs, items, k):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total, out = len(counts), sum(m for *_, m in counts), []
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    for item, own in asked.items():
        scored = []
        for i, c, length in counts:
            m = 50 + (50 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def corpus(rng, n=400):
    words = [*"the of and a to".split() * 8, *[f"w{i}" for i in range(60)], "É", "été", "Straße", "日本", "x\u0085y", "a b", "B2"]
    rows = [(i, " ,.\t".join(rng.choices(words, k=rng.choice([1, 3, 20, 90])))) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)]  # a large group of copies
    return [*rows, rows[3], (None, rows[5][1]), (None, "unique w1"), (2000, None), (2001, ""), (2002, "--- !!"), (2003, "w3 " * 30_000)]


def asked(rng, docs):
    items = [(i, " ".join((rng.choice(docs)[1] or "").split()[:40])) for i in range(30)]
    return [*items, (50, None), (51, ""), (52, "nowhere unheard"), (53, "THE w1"), (53, "w2 of"), items[4], (None, "w5 w6"), (54, docs[7][1])]


@pytest.mark.parametrize(("most", "postings", "block", "at_once"), [(4096, 500_000, 2048, 256), (50, 700, 7, 3)])
def test_equals_brute_force(spark, most, postings, block, at_once):
    rng = random.Random(4)
    docs = corpus(rng)
    items = asked(rng, docs)
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(6)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    index = lexical.build(d, most, postings)
    got = lexical.search(index, q, 10, block, at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, items, 10), key=str)


def test_bounds_hold_the_score_and_leave_most_documents_out():
    rng = random.Random(8)
    docs = corpus(rng)
    rows = [(i, len(t), Counter(t)) for i, x in docs if (t := lexical.terms((x or "").encode()))]
    n, total = len(rows), sum(m for _, m, _ in rows)
    b = lexical._segment(rows, n, total)
    own = lexical.Asked.of([set(lexical.terms(t.encode())) for _, t in asked(rng, docs) if t])
    df = Counter(t for *_, c in rows for t in c)
    for t, k in own.number.items():
        own.weights[k] = lexical.weight(n, df[t]) if df[t] else 0
    s = lexical.Segment(b, 0, own)
    low, high = s.bounds(0, False), s.bounds(0, True)
    for item in range(own.size):
        scores = s.exact(item, lexical.np.arange(len(rows)), n, total)
        assert (low[:, item] <= scores).all() and (scores <= high[:, item]).all()
        if (scores > 0).sum() > 100:
            kth = sorted(low[:, item])[-10]
            assert (high[:, item] >= kth).sum() < 0.5 * len(rows)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.digest(docs, items).collect() == [] and lexical.digest(docs, items.limit(0)).collect() == []
    some = spark.createDataFrame([(4, "b a"), (5, "c")], "doc_id long, text string")
    assert lexical.digest(some, items.limit(0)).collect() == [] and [tuple(r)[:3] for r in lexical.digest(some, items).collect()] == [(1, 1, 4)]
