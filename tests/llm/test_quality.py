import random
import re

import numpy as np
import pytest

from rankloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows(words, n):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return {g: at for g, at in seen.items() if len(at) > 1}


def brute(text):
    words = WORD.findall(text or "")
    covered = {p for at in windows(words, 5).values() for i in at for p in range(i, i + 5)}
    longest = 0
    while windows(words, max(5, longest + 1)):
        longest = max(5, longest + 1)
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    chars, repeat = sum(map(len, words)), sum(len(words[p]) for p in covered)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    kept = not failed and 100 * repeat <= Q.COVERED * chars and longest <= Q.LONGEST
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), repeat, longest, failed, kept)


def maximal(words, least):
    """Repeats that neither a word before nor one after all occurrences can make longer."""
    out = set()
    for n in range(least, len(words)):
        for g, at in windows(words, n).items():
            before = {words[i - 1] if i else None for i in at}
            after = {words[i + n] if i + n < len(words) else None for i in at}
            if (len(before) > 1 or None in before) and (len(after) > 1 or None in after):
                out.add((g, len(at)))
    return out


def texts(rng):
    prose = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    few = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    line = prose(8)
    long = prose(60)
    out = [None, "", " \n\t", "one", "same " * 400, prose(300), few(200), few(30), f"{line}\n" * 3 + prose(400), f"{prose(900)} {long} {prose(50)} {long}", f"{prose(300)} {long[:100]} x {long[:100]}"]
    out += ["é ü \u0085  日本 # * $ % & | < > " + prose(30), f"a\n\n \nb\n{line}\n{line} \n{line}", "<b>" * 20, prose(20_000) + " " + long + " " + long, f"{line} " * 2 + prose(9)]
    return out + [few(rng.randint(1, 90)) + " " + prose(rng.randint(0, 60)) for _ in range(120)]


@pytest.mark.parametrize("at_once", [1 << 18, 50])
def test_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(Q, "AT_ONCE", at_once)
    rows = list(enumerate(texts(random.Random(1))))
    odd = [(None, rows[5][1]), rows[6]]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + odd], "doc_id long, text string, kept int").repartition(3)
    got = sorted(((r.doc_id, *[r[f] for f in Q.FIELDS if f != "n_repeats"]) for r in Q.digest(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows + odd), key=str)
    assert [r.doc_id for r in Q.digest(df.limit(0)).collect()] == []


def test_a_long_repeat_fails_where_its_share_is_small():
    rng = random.Random(2)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for n, kept in ((Q.LONGEST, True), (Q.LONGEST + 1, False)):
        part = prose(n)
        (m,) = Q.measured([" ".join([*prose(700), *part, *prose(3), *part]).encode()])
        assert m.longest_repeat == n and m.kept is kept and not m.base_failed and m.n_repeats == 1


def test_maximal_repeats(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 120)))) for i in range(25)] + [(90, None), (None, "a b c a b c")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = {}
    for r in Q.repeats(df, 2).collect():
        got.setdefault(r.doc_id, set()).add((tuple(r.text.split()), r.occurrences))
        words = dict(rows)[r.doc_id].split()
        assert words[r.first_word : r.first_word + r.n_words] == r.text.split()
    assert got == {i: want for i, t in rows if (want := maximal((t or "").split(), 2))}


def test_prefixes_and_suffixes_of_many_texts():
    rng = np.random.default_rng(5)
    sizes = [1, 5, 40, 200, 3]
    word = rng.integers(0, 3, sum(sizes))
    text = np.repeat(np.arange(5), sizes)
    stop = np.cumsum(sizes)[text]
    order, levels = Q.suffixes(word, text, stop)
    assert order.tolist() == sorted(range(len(word)), key=lambda i: (text[i], word[i : stop[i]].tolist()))
    place, n = Q.common_prefixes(order, levels, stop, 2)
    want = {}
    for p in range(1, len(order)):
        a, b = (word[order[q] : stop[order[q]]].tolist() for q in (p - 1, p))
        same = next((k for k, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b))) if text[order[p]] == text[order[p - 1]] else 0
        if same >= 2:
            want[p] = same
    assert dict(zip(place.tolist(), n.tolist(), strict=True)) == want


def test_keep_has_all_columns_whatever_their_names(spark):
    good = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, good, "a", 1.5), (2, "again " * 40, "b", 2.5), (3, None, "c", 3.5), (1, good, "a", 1.5)], "doc_id long, text string, `a.b c` string, kept double")
    got = Q.keep(df)
    assert got.schema == df.schema and [tuple(r) for r in got.collect()] == [(1, good, "a", 1.5)] * 2
