import hashlib
import random

import numpy as np
import pytest

from rankloom.llm import bpe


@pytest.fixture(scope="module")
def spec():
    return open(bpe.default_path(), encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def texts_of(rng):
    letters = "abcdefgehinorst"
    out = [
        "", " ", "\t\n\x0b\x0c\r", "Hello, World's 123 don't", "\x1c\x1d a\x85b\xa0c  d　e", "é ́a ΑΣ ΑΣ. Σ İı ǅ ß", "<|endoftext|> a<|startoftext|>b <|END|>", "😀👩‍👩‍👧 ｆｕｌｌ 中文字 한글 भाषा", "﻿​\x00\x01",
        "thethe" * 900, "".join(rng.choices(letters, k=20_000)), "".join(rng.choices("ab", k=7000)), "a" * 5000, "é" * 4000 + "!" * 5000 + "1" * 3000, "x<|endoftext|>" * 600, "ΑΣ" * 3000 + "'s" * 2000,
    ]
    for _ in range(200):
        out.append("".join(rng.choice(["the ", "ing", "é", "É", "'LL ", " ", "\n", "12", "…", "́", "th", "Zu", ".", "\x85", "<|endoftext|>"]) for _ in range(rng.randint(1, 60))))
    return out


def test_exact_against_the_library(spec, library):
    rng = random.Random(11)
    small, usual = bpe.Bpe(spec, part=9, leaf=7, unsplit=20, window=1), bpe.Bpe(spec)
    for t in texts_of(rng):
        want = library.encode(t, add_special_tokens=False).ids
        for b in (small, usual):
            ids = b.encode(t.encode())
            assert np.frombuffer(ids, "<u4").tolist() == want, t[:50]
            assert b.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_the_tree_gives_the_rows_and_no_cut_changes_them(spec, library):
    """Texts of ordinary words come through joins, many of them through cut words, wherever the cuts and windows fall."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgéΣ'1", k=rng.randint(1, 12))) for _ in range(400)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(rng.randint(200, 1500))) for _ in range(6)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for part in (1, 2, 3, 10, 64, 1000, 1024):
        for window in (1, 3):
            b = bpe.Bpe(spec, part=part, window=window)
            assert [np.frombuffer(b.encode(t.encode()), "<u4").tolist() for t in texts] == want
            leaves = sum(len(list(b.cut(t.encode(), part))) for t in texts)
            assert b.joins >= leaves / 3 and (b.grown > 0 or part < 64 or window > 1)
            assert all(len(x) <= max(part, 4) for t in texts for x, _ in b.cut(t.encode(), part))


def test_forgetting_changes_nothing(spec, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    b, rng = bpe.Bpe(spec), random.Random(4)
    for _ in range(50):
        t = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{rng.randrange(50)}"]) for _ in range(20))
        assert np.frombuffer(b.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_query_rows_also_when_texts_are_cut(spark, library):
    rng = random.Random(12)
    rows = [(i, t, 9, "clash") for i, t in enumerate(texts_of(rng)[:40])] + [(None, None, 1, ""), (7, "again", 1, ""), (7, "again", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, kind string")
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    want.sort(key=str)
    assert sorted(map(tuple, bpe.encode_decode(docs).collect()), key=str) == want
    assert sorted(map(tuple, bpe.encode_decode(docs, long=50, run=30, part=11, leaf=16, unsplit=40, window=1).collect()), key=str) == want
    one = bpe.encode_decode(docs.where("doc_id = 3"), texts=True).first()
    assert one.decoded == library.decode(one.ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs.limit(0)).collect() == []
