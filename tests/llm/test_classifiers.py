import random

import numpy as np

from rankloom.llm import langid, toxicity
from rankloom.llm.common import held_out

WORDS = {"xx": ["alba", "berra", "cono", "dista", "elo"], "yy": ["wurz", "zwick", "kropf", "stumm", "fahl"], "zz": ["ощек", "прив", "солн", "река", "дом"]}


def corpus(rng, n=240):
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 60))), lang, "src") for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_languages_are_told_apart_and_odd_texts_have_a_result(spark):
    rows = corpus(random.Random(1))
    odd = [(1001, None, "xx", "s"), (1002, "", "yy", "s"), (1003, "123 !!", None, "s"), (None, "alba cono", None, None), (1004, "alba " * 100_000, None, "s"), rows[0]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs.where(~held_out("doc_id", 3, 1)))
    assert model.langs == ["xx", "yy", "zz"] and model.temperature > 0
    out = langid.classify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (1001, 1002, 1003)} == {(k, "und", 0.0) for k in (1001, 1002, 1003)}
    assert {r.lang_pred for r in got if r.doc_id in (None, 1004)} == {"xx"}
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.classify(docs, none).collect()} == {"und"} and langid.classify(docs.limit(0), model).collect() == []


def test_long_texts_lose_no_grams(monkeypatch):
    text = "Ab cÉ! dé " * 50
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.array_equal(whole, np.sort(np.concatenate(list(langid.grams(text)))))


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(z)])
    assert abs(langid.temperature(5 * z, y) - 5) < 0.6


def toxic_corpus(rng, n=900):
    clean = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = rng.choices(clean, k=60) + (rng.choices(["vile", "scorn", "badlyx", "badlyy", "badlyz"], k=4) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus(random.Random(3))
    odd = [(5001, None, None), (5002, "", "en"), (None, "vile scorn vile badlyx", "en"), (5003, "word1 " * 50_000 + "Vile, SCORN! badlyx badlyy", "en"), rows[0]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (9999, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.where(~held_out("doc_id", 5, 0)), marks)
    got = toxicity.score(docs.withColumn("h", held_out("doc_id", 5, 0)), model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    bad = {i for i, t, _ in rows if "vile" in t or "scorn" in t or "badly" in t}
    out = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 5000]
    right = sum((r.doc_id in bad) == bool(r.predicted) for r in out)
    assert right / len(out) > 0.97
    by = {r.doc_id: r.predicted for r in got}
    assert by[5001] == by[5002] == 0 and by[5003] == 1 and by[None] == 1


def test_toxicity_without_positives_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), empty)).collect() == []


def test_risk_needs_no_labelled_negatives():
    rng = np.random.default_rng(1)
    p = [np.array([0, *rng.integers(2, 6, 2)]) for _ in range(200)]
    u = [np.array([0, *rng.integers(2, 6, 2)]) if i < 60 else rng.integers(2, 6, 2) for i in range(600)]
    w, b = toxicity.train([np.unique(x) for x in p], [np.unique(x) for x in u], 6, 0.1)
    assert w[0] + b > 0 > b and abs(w[2:6]).max() < w[0] / 2


def test_grams_count_the_last_letter():
    for text, n in (("a", 1 + 2 + 1), ("ab", 2 + 3 + 2), ("", 0), ("ab c", 3 + 5 + 3)):
        assert sum(map(len, langid.grams(text))) == n
    last = next(langid.grams("ab")).tolist()
    assert next(langid.grams("b")).tolist()[0] in last[:2]


def test_risk_sums_and_step_equal_plain_loops():
    rng = np.random.default_rng(2)
    n, prior = 5, 0.2
    draw = lambda k: [np.flatnonzero(rng.random(n) < 0.4) for _ in range(k)]
    p, u = draw(30), draw(90)
    w, b = rng.normal(size=n), -0.3
    column = lambda docs: toxicity.pa.array([d.tolist() for d in docs], toxicity.pa.list_(toxicity.pa.int32()))
    place = np.arange(n + 1)

    def parts(w, b, docs):
        """Mean losses and their gradients by document: loss(+), loss(-)."""
        plus, minus, gp, gm = 0.0, 0.0, np.zeros(n + 1), np.zeros(n + 1)
        for d in docs:
            x = np.append(np.isin(np.arange(n), d), 1.0)
            z = x[:n] @ w + b
            plus, minus = plus + np.log1p(np.exp(-z)), minus + np.log1p(np.exp(z))
            gp, gm = gp - x / (1 + np.exp(z)), gm + x / (1 + np.exp(-z))
        return [v / len(docs) for v in (plus, minus, gp, gm)]

    for case in (0.2, 0.99):
        prior = case
        (pp, pm, gpp, gpm), (_, um, _, gum) = parts(w, b, p), parts(w, b, u)
        negative = um - prior * pm
        g = prior * gpp + gum - prior * gpm if negative >= 0 else prior * gpm - gum
        g[:n] += toxicity.DECAY * w
        own, all_ = (toxicity.sums(w, b, place, [column(docs[: len(docs) // 3]), column(docs[len(docs) // 3 :])]) for docs in (p, u))
        seen = np.bincount(np.concatenate(p), minlength=n)
        w2, b2 = toxicity.step(w, b, np.concatenate([own, seen]), all_, prior)
        moved = np.append(w - w2, b - b2)
        assert (np.sign(moved) == np.sign(g)).all() and ((negative >= 0) == (case == 0.2))
        curve = [sum((np.isin(i, d) if i < n else 1) * s * (1 - s) * (len(d) + 1) for d in docs for s in [1 / (1 + np.exp(-(w[d].sum() + b)))]) / len(docs) for i in range(n + 1) for docs in [u]]
        bent = np.array(curve) + prior * np.array([sum((np.isin(i, d) if i < n else 1) * s * (1 - s) * (len(d) + 1) for d in p for s in [1 / (1 + np.exp(-(w[d].sum() + b)))]) / len(p) for i in range(n + 1)]) + toxicity.DECAY + 1e-9
        assert np.allclose(moved, np.clip(g / bent, -1, 1), atol=1e-9)


def test_steps_lower_the_corrected_risk():
    rng = np.random.default_rng(3)
    n, prior = 6, 0.25
    p = [np.append(0, rng.integers(1, n, 2)) for _ in range(60)]
    u = [np.unique(np.append(rng.integers(1, n, 3), [0] if rng.random() < 0.25 else [])).astype(int) for _ in range(300)]
    p, column = [np.unique(d) for d in p], lambda docs: toxicity.pa.array([d.tolist() for d in docs], toxicity.pa.list_(toxicity.pa.int32()))
    loss = lambda w, b, docs, sign: np.mean([np.log1p(np.exp(-sign * (w[d].sum() + b))) for d in docs])
    risk = lambda w, b: prior * loss(w, b, p, 1) + max(0, loss(w, b, u, -1) - prior * loss(w, b, p, -1))
    w, b, before = np.zeros(n), -1.0, None
    seen = np.bincount(np.concatenate(p), minlength=n)
    for _ in range(6):
        own, all_ = (toxicity.sums(w, b, np.arange(n + 1), [column(docs)]) for docs in (p, u))
        now = risk(w, b)
        assert before is None or now <= before + 1e-4
        before = now
        w, b = toxicity.step(w, b, np.concatenate([own, seen]), all_, prior)
    assert w[0] > 0 and w[0] > np.abs(w[1:]).max()


def test_frequencies_and_gains_by_hand(spark):
    docs = spark.createDataFrame([("vile word1",), ("vile vilest",), (None,), ("other",)], "text string")
    numbers = spark.sparkContext.broadcast({"vile": 0, "vile*": 1, "vile*#2": 2, "other": 3})
    found = docs.mapInArrow(toxicity._numbered(numbers), "found array<int>")
    assert sorted(r.found for r in found.collect()) == [[], [0], [0, 1], [3]]
    got = {r.place: r.n for r in found.mapInArrow(toxicity._frequencies(4), "place long, n long").groupBy("place").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == {0: 2, 1: 1, 3: 1, 4: 4}
    p, u = np.array([8.0, 1.0, 0.0]), np.array([2.0, 10.0, 4.0])
    each = toxicity.gains(p, u, 10, 50)
    share = 10 / 60
    want = 2 * (8 * np.log(8 / (10 * share)) + 2 * np.log(2 / (10 * (1 - share))))
    assert abs(each[0] - want) < 1e-9 and each[1] == 0 and each[2] == 0


def test_regression_equals_plain_follow_the_regularised_leader():
    rng = np.random.default_rng(4)
    d, k = 6, 3
    rows = [(np.append(np.sort(rng.choice(d, 3, replace=False)), d), np.append(rng.random(3), 1.0), int(rng.integers(k))) for _ in range(25)]
    w, bias = langid.ftrl(rows, d, k, seed=1)
    z, n = [[0.0] * k for _ in range(d + 1)], [[0.0] * k for _ in range(d + 1)]
    weight = lambda i, c: 0.0 if abs(z[i][c]) <= langid.L1 else -(z[i][c] - np.sign(z[i][c]) * langid.L1) / ((langid.BETA + n[i][c] ** 0.5) / langid.ALPHA + langid.L2)
    order = np.random.default_rng(1)
    for _ in range(langid.EPOCHS):
        for r in order.permutation(len(rows)):
            index, value, label = rows[r]
            own = [[weight(i, c) for c in range(k)] for i in index]
            s = [sum(v * o[c] for v, o in zip(value, own, strict=True)) for c in range(k)]
            e = [np.exp(v - max(s)) for v in s]
            for i, v, o in zip(index, value, own, strict=True):
                for c in range(k):
                    g = v * (e[c] / sum(e) - (c == label))
                    sigma = ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / langid.ALPHA
                    z[i][c] += g - sigma * o[c]
                    n[i][c] += g * g
    want = np.array([[weight(i, c) for c in range(k)] for i in range(d + 1)])
    assert np.allclose(w, want[:d], atol=1e-9) and np.allclose(bias, want[d], atol=1e-9)


def test_document_frequencies_equal_a_plain_count(spark):
    texts = ["ab", "ba b", None, "", "ab ab", "xyz " * 30]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.bucket: r.n for r in docs.mapInArrow(langid._document_frequencies, "bucket long, n long").groupBy("bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    want = {-1: len(texts)}
    for t in texts:
        for h in {int(h) for part in langid.grams(t) for h in part}:
            want[h] = want.get(h, 0) + 1
    assert got == want


def test_classifiers_keep_columns_of_any_name(spark):
    rows = [(i, t, lang, "s", 1.5, 2) for i, t, lang, _ in corpus(random.Random(6), 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string, `x y` double, SCORE int")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    out = langid.classify(docs, model, "lang_pred", "p")
    assert out.columns == [*docs.columns, "lang_pred", "p"] and {tuple(r)[3:6] for r in out.collect()} == {("s", 1.5, 2)}
    scored = toxicity.score(docs, toxicity.Model({"alba": 4.0}, -2.0))
    assert scored.columns == ["doc_id", "text", "lang", "a.b", "x y", "score", "predicted"]
    assert all(r.predicted == int("alba" in r.text.split()) for r in scored.collect())
