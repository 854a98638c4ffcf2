"""Operator 4 - language identification.

Features are TF-IDF weights of hashed character 1- to 3-grams over lower-cased letters; a text's term frequencies are
shares of its n-grams, and document frequencies count every training document. A sparse multinomial logistic regression
is trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows, and a
temperature fitted on rows the training has not seen calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import map_rows, place, short_batches, tidy

#: Hash buckets; labelled training rows of a language in the sample (bound of the fit), the share of them kept for the temperature; characters handled at once.
BUCKETS, PER_LANG, CALIBRATE, CHUNK = 1 << 16, 1200, 0.25, 1 << 18
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.3, 1.0, 0.002, 0.001, 4, 30.0
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, or a space for all else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, by stretches that overlap so that none is lost or counted twice."""
    text = f" {text}  "  # one space more, so that the last letter begins a stretch of three as well
    for at in range(0, max(1, len(text) - 2), CHUNK):
        part = np.frombuffer(text[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        c = _letters()[part]
        n = len(c) - 2
        a, b, d = c[:n], c[1 : n + 1], c[2 : n + 2]
        h1 = a * np.uint32(0x9E3779B1)
        h2 = (h1 ^ b) * np.uint32(0x85EBCA6B)
        h3 = (h2 ^ d) * np.uint32(0xC2B2AE35)
        word = a != 32
        yield np.concatenate([h1[word] >> np.uint32(16), (h2 + np.uint32(0x51ED270B))[word | (b != 32)] >> np.uint32(16), (h3 + np.uint32(0x2545F491))[b != 32] >> np.uint32(16)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, weights (bucket x language, idf and scale included), intercepts and temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for h in grams(text):
            total += self.weights[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for null or text without a letter, or without languages."""
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, classes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts from sparse rows (indices, values, class)."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    rng = np.random.default_rng(seed)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            index, value, label = rows[r]
            w = weight(index)
            p = softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    w = weight(np.arange(buckets + 1))
    return w[:buckets], w[buckets]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden steps over a logarithmic grid."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for t in b.column("text"):
            seen = np.zeros(BUCKETS, bool)
            for h in grams(t.as_py()):
                seen[h] = True
            df += seen
            docs += 1
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], docs))], names=["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        index, share = [], []
        for t in b.column("text"):
            n = np.zeros(BUCKETS, np.int64)
            for h in grams(t.as_py()):
                n += np.bincount(h, minlength=BUCKETS)
            at = np.flatnonzero(n)
            index.append(at.astype("<i4").tobytes())
            share.append((n[at] / max(1, n.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("pick"), pa.array(index, pa.binary()), pa.array(share, pa.binary())], names=["lang", "pick", "at", "share"])


def fit(rows: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from rows (doc_id, text, lang); null langs and texts and null ids teach nothing.

    ``per_lang`` bounds the labelled rows of a language that the classifier is fitted on; they are drawn by a hash of id
    and text, and rows that repeat id, text and lang are drawn once. Document frequencies count all rows given.
    """
    short_batches(rows.sparkSession)
    known = rows.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    found = known.select("text").mapInArrow(tidy(_document_frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, docs = np.zeros(BUCKETS), 0
    for r in found:
        if r["bucket"] < 0:
            docs = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.where(df > 0, np.log((1 + docs) / (1 + df)) + 1, 0.0)
    # The draw is made on distinct keys without texts, so that it is bounded whatever repeats.
    key = ["lang", "doc_id", "hash"]
    keyed = known.withColumn("hash", F.xxhash64("text"))
    distinct = keyed.select(*key).distinct()
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_lang / n))) for k, n in sizes.items()])
    pick = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1_000_003)) / 1_000_003.0
    drawn = distinct.withColumn("pick", pick).where(F.col("pick") < share)
    rows = keyed.join(F.broadcast(drawn), key).groupBy(*key, "pick").agg(F.first("text").alias("text"))
    sample = rows.select("lang", "pick", "text").mapInArrow(tidy(_sparse), "lang string, pick double, at binary, share binary").collect()
    sample.sort(key=lambda r: (r["pick"], r["lang"], bytes(r["at"])))
    data = [(np.append(at := np.frombuffer(r["at"], "<i4"), BUCKETS), np.append(SCALE * np.frombuffer(r["share"], "<f4") * idf[at], 1.0), langs.index(r["lang"])) for r in sample]
    last = [k for k in range(len(data)) if k % round(1 / CALIBRATE) == 1]
    w, bias = ftrl([d for k, d in enumerate(data) if k not in set(last)], BUCKETS, len(langs))
    logits = np.array([data[k][1][:-1] @ w[data[k][0][:-1]] + bias for k in last]) if last else np.zeros((0, len(langs)))
    t = temperature(logits, np.array([data[k][2] for k in last], int))
    return Model(langs, (w * idf[:, None] * SCALE).astype(np.float32), bias, t)


def classify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability; columns of the names given are replaced, all rows stay.

    Null texts and texts without a letter get ``und`` and 0; so does every text if no language was learned.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, own = place(docs, "text"), [i for i, c in enumerate(docs.columns) if c.lower() not in (lang.lower(), score.lower())]
    schema = T.StructType([*[docs.schema.fields[i] for i in own], T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in own], pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=[str(i) for i in range(len(own) + 2)])

    return map_rows(docs, run, schema)
