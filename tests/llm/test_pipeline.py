import hashlib
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as cp
from rankloom.llm import bpe, mixing, simhash
from rankloom.llm.common import BATCH_BYTES, short_batches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    words = {"aa": ["vala", "mire", "tonu", "sela", "kiro", "pano"], "bb": ["wurzel", "stock", "klang", "zwist", "frost", "dampf"]}
    rows = []
    for i in range(160):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang]) + str(rng.randrange(30)) for _ in range(rng.randint(3, 80)))
        if rng.random() < 0.15:
            text += " vile scum rotten" * 2
        rows.append((i, text, lang, rng.choice(["s1", "s2", "s3", "s3"]), len(text)))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1", rows[i][4]) for i in range(10)]
    return rows + [(300, None, "aa", "s1", None), (301, "", "aa", "s2", 0), (302, "12 34", "bb", None, 5), rows[3], (None, "vala mire", "aa", None, 9), (None, "vala mire", "aa", None, 9)]


def test_stages_and_run(spark, tmp_path):
    rows = corpus(random.Random(9))
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    marks = [(i, 1, int("vile" in t)) for i, t, *_ in rows[:160] if i % 2]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = cp.language_id(spark, docs, sf)
    assert first.columns == docs.columns
    assert sorted(map(tuple, first.collect()), key=str) == sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=str)
    clean = cp.toxicity_filter(spark, first, sf)
    left = clean.collect()
    want = [r for r in first.collect() if "vile" not in r.text]
    assert clean.columns == docs.columns and len(set(map(tuple, want)) ^ set(map(tuple, left))) <= 4
    one = cp.simhash_dedup(spark, clean, sf)
    assert one.columns == docs.columns
    groups = {}
    for r in simhash.near_duplicates(clean).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    kept = sorted((r.doc_id for r in one.collect()), key=str)
    assert kept == sorted((min((k for k in g if k is not None), default=None) for g in groups.values()), key=str)
    mixed = cp.source_mixing(spark, one, sf)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.digest(one).collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == taken
    assert [n for n, _ in cp.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"] and cp.ORACLE_SQL is None
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    want = []
    for r in mixed.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, cp.run(spark, sf).collect()), key=str) == sorted(want, key=str)


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    rows = corpus(random.Random(2))
    names = ["a.b", "x y", "SCORE", "Predicted", "lang_pred", "key", "runs", "Size"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + ", " + ", ".join(f"`{n}` int" for n in names))
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, int("vile" in t)) for i, t, *_ in rows[:160] if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert got and all(tuple(r)[5:] == tuple(range(len(names))) for r in got)
    assert cp.encoding(spark, docs, sf).columns[:2] == ["doc_id", "n_tokens"]


def test_empty(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert cp.run(spark, sf).collect() == []


def test_short_batches(spark):
    own = spark.newSession()
    text = own.range(0, 4000, 1, 1).selectExpr("repeat('x', if(id % 500 = 7, 100000, 1000)) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    for given, want in (("64m", 1 << 20), ("256k", 1 << 18)):
        own.conf.set(BATCH_BYTES, given)
        short_batches(own, 1 << 20)
        found = text.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in found) == 4000
        assert max(r["bytes"] for r in found) <= want + 120_000
