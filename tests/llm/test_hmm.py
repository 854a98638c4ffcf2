import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import hmm
from rankloom.llm.common import held_out


def model_of(rng, k=3, s=5):
    m, e = rng.random((k, k)), rng.random((s, k))
    return hmm.Hmm(np.array([0.5, 0.3, 0.2][:k]), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))


def paths(m, row):
    for states in itertools.product(range(len(m.start)), repeat=len(row)):
        p = m.start[states[0]] * m.emits[row[0], states[0]]
        for a, b, s in zip(states, states[1:], row[1:], strict=False):
            p *= m.moves[a, b] * m.emits[s, b]
        yield states, p


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    m = model_of(rng)
    rows = [rng.integers(0, 5, n).astype("<i2") for n in (1, 4, 2, 6, 3)]
    want = [math.log(sum(p for _, p in paths(m, r))) for r in rows]
    assert np.allclose(m.forward(rows), want)


def test_expected_counts_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    m = model_of(rng)
    rows = [rng.integers(0, 5, n) for n in (5, 1, 3)]
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for r in rows:
        total = sum(p for _, p in paths(m, r))
        for states, p in paths(m, r):
            start[states[0]] += p / total
            for a, b in zip(states, states[1:], strict=False):
                moves[a, b] += p / total
            for s, a in zip(r, states, strict=True):
                emits[s, a] += p / total
    got = m.expect_all(hmm.blocks_of(rows, size=8))
    assert all(np.allclose(a, b) for a, b in zip(got, (start, moves, emits), strict=True))


def test_blocks_count_every_token_and_move_as_the_whole_text_does():
    rng = np.random.default_rng(5)
    m = model_of(rng)
    rows = [rng.integers(0, 5, n) for n in (3000, 1, 512, 513, 40)]
    whole = m.expect_all(hmm.blocks_of(rows, size=4096))
    cut = m.expect_all(hmm.blocks_of(rows, size=64))
    assert abs(cut[1].sum() - sum(len(r) - 1 for r in rows)) < 1e-6 and abs(cut[2].sum() - sum(map(len, rows))) < 1e-6
    assert all(np.allclose(a, b, rtol=1e-5, atol=1e-6) for a, b in zip(cut, whole, strict=True))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(3)
    rows = [rng.choice([0, 1, 2] if i % 2 else [3, 4, 5], 40) for i in range(40)]
    unigram = np.full(6, 1 / 6)
    models = [hmm.first_guess(hmm.blocks_of(rows), unigram, 2, rounds=n) for n in (1, 5, 20)]
    scores = [m.forward(rows).sum() for m in models]
    assert scores[0] < scores[1] < scores[2] and scores[2] / 1600 > math.log(1 / 6) + 0.5


@pytest.mark.parametrize("cached", [5, 1000])
def test_columns_against_plain_counting(spark, cached):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "é", f"w{rng.randrange(60)}", f"rare{i}"]) for _ in range(rng.randint(0, 30))), 0.5) for i in range(120)]
    rows += [(200, None, 1.0), (201, " \x0b\n", 1.0), (None, "the of", 2.0), (202, "the " * 30_000, 1.0), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = hmm.score(docs, held_out("doc_id", 5, 1), top=3, classes=7, cached=cached, states=2, rounds=1).collect()
    assert len(got) == len(rows)
    import zlib

    def out(k):
        return k is None or zlib.crc32(str(k).encode()) % 5 == 1

    c = Counter()
    for k, t, _ in rows:
        if not out(k):
            c.update([*(t or "").encode().lower().split(), b" "])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for k, t, _ in rows:
        w = [*(t or "").encode().lower().split(), b" "]
        want[(k, out(k), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_add_up(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), 2 + i % 4) for i in range(40)] + [(bytearray(hmm.END), 9)], "word binary, n long")
    v = hmm.vocabulary(counts, top=5, classes=4, cached=100)
    model = hmm.first_guess(hmm.blocks_of([]), v.unigram(), 2)
    total = model.emits[: v.own + 1].sum(axis=0)
    for k in range(4):
        inside = sum(10 ** v.known_log(v.counts[i], k) for i, (w, s) in enumerate(v.symbols.items()) if s == v.own + 1 + k) + 10 ** v.unknown_log()[k]
        assert abs(inside - 1) < 1e-9
        total = total + model.emits[v.own + 1 + k] * inside
    assert np.allclose(total, 1)


def test_empty_and_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert hmm.score(spark.createDataFrame([], schema), held_out("doc_id", 5, 1)).collect() == []
    (r,) = hmm.score(spark.createDataFrame([(None, "a b")], schema), held_out("doc_id", 5, 1)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0 and math.isfinite(r.score)


def test_a_large_tie_group_fills_the_room_left(spark):
    counts = spark.createDataFrame([(b"z", 9)] + [(b"w%02d" % i, 5) for i in range(30)] + [(b"a", 2)], "word binary, n long")
    for cached in (100, 20, 5):
        v = hmm.vocabulary(counts, top=11, classes=4, cached=cached)
        assert v.own == 11 and list(v.symbols)[:11] == [b"z"] + [b"w%02d" % i for i in range(10)]
        assert v.mass.sum() == 20 * 5 + 2 and v.types.sum() == 21
