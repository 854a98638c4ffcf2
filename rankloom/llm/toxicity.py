"""Operator 2 - toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all training documents, whatever their labels, are the unlabelled text.
Linear numpy classifiers over the presence of words and word beginnings minimise the class-prior-corrected risk
``prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])``; where the second part turns negative, the step
undoes it instead. The prior is the toxic share of the labelled training rows.

A first guess is the mean of a few classifiers on bootstrap samples of bounded samples of both sides. Features are screened
on those samples, and chosen by their counts over all training texts; then rounds of steps over all training texts follow,
whose sums of losses, derivatives and curvatures are added up over the partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import Scratch, map_rows, place, short_batches, tidy

#: Bounds of the labelled positives and of the first guess's unlabelled documents; features of the model, and of those screened; least positives with a feature, and its least log-likelihood ratio, when chosen and when screened; lengths of word beginnings.
POSITIVES, UNLABELLED, FEATURES, SCREENED, LEAST, SIGNIFICANT, LIKELY, BEGINNINGS = 2500, 6000, 4000, 16_000, 3, 18.0, 9.0, (4, 5, 6, 7)
#: Classifiers and steps of the first guess, their rate and decay; rounds over all training texts.
MODELS, STEPS, RATE, DECAY, ROUNDS = 3, 300, 0.1, 1e-4, 4
REMEMBERED = 50_000
#: Bytes that separate words: all ASCII but letters and digits.
_SEPARATE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> set[str]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(_SEPARATE).decode("utf-8", "replace").lower().split())


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *[f"{word[:k]}*" for k in BEGINNINGS if len(word) > k]]


def document_features(text: str | None) -> list[str]:
    """Forms of the text's distinct words; ``form#k`` says that k of them (2 or 3) or more have a form in common."""
    n = Counter(f for w in words(text) for f in features(w))
    return [*n, *[f"{f}#{k}" for f, c in n.items() if c > 1 for k in (2, 3) if c >= k]]


@dataclass
class Model:
    """Weights by feature and an intercept; log odds of toxicity."""

    weights: dict[str, float]
    bias: float
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    forms: set[str] = field(default_factory=set, repr=False)

    def score(self, text: str | None) -> float:
        """Probability of toxicity; an empty or null text has the intercept's."""
        n: Counter = Counter()
        seen = self.seen
        forms = self.forms = self.forms or {f.partition("#")[0] for f in self.weights}
        for w in words(text):
            own = seen.get(w)
            if own is None:
                if len(seen) > REMEMBERED:
                    seen.clear()
                own = seen[w] = tuple(f for f in features(w) if f in forms)
            if own:
                n.update(own)
        z = self.bias + sum(self.weights.get(g, 0.0) for f in sorted(n) for g in (f, f"{f}#2", f"{f}#3")[: n[f]])
        return float(1 / (1 + np.exp(-z))) if z > -500 else 0.0


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and intercept from documents given as arrays of feature numbers."""
    rng = np.random.default_rng(seed)
    total, bias = np.zeros(n), 0.0

    def flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)

    for _ in range(MODELS):
        p = [positives[i] for i in rng.integers(0, len(positives), len(positives))]
        u = [unlabelled[i] for i in rng.integers(0, len(unlabelled), len(unlabelled))]
        (pr, pc), (ur, uc) = flat(p), flat(u)
        w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
        m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
        for t in range(1, STEPS + 1):
            zp = np.bincount(pr, w[pc], len(p)) + b
            zu = np.bincount(ur, w[uc], len(u)) + b
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            # Derivatives of the logistic loss: loss(+)' = s - 1, loss(-)' = s.
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp, gu = -prior * sp / len(p), su / len(u)
            if negative < 0:
                gp, gu = -gp, -gu
            else:
                gp = gp + prior * (sp - 1) / len(p)
            g = np.bincount(pc, gp[pr], n) + np.bincount(uc, gu[ur], n) + DECAY * w
            gb = gp.sum() + gu.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.999**t
            w = w - RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b = b - RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        total, bias = total + w / MODELS, bias + b / MODELS
    return total, bias


def distinct_forms(positives: dict[str, int], share: float = 0.9) -> list[str]:
    """Features without the beginnings that a longer form all but stands for: one with ``share`` of their positives."""
    out = set(positives)
    for f, n in positives.items():
        form, _, k = f.partition("#")
        for g in features(form.rstrip("*")):
            g = f"{g}#{k}" if k else g
            if len(g.rstrip("*")) < len(f.rstrip("*")) and g in positives and n >= share * positives[g]:
                out.discard(g)
    return list(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, apart for positives and unlabelled ones, summed per task."""
    p, u = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = list(p.keys() | u.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[x] for x in names], pa.int64()), pa.array([u[x] for x in names], pa.int64())], names=["feature", "p", "u"])

    for b in batches:
        for t, positive in zip(b.column("text"), b.column("positive").to_pylist(), strict=True):
            (p if positive else u).update(document_features(t.as_py()))
            if len(p) + len(u) > 400_000:
                yield out()
                p.clear()
                u.clear()
    yield out()


class Numbers:
    """Numbers of the features of texts; words are looked up once."""

    def __init__(self, number: dict[str, int]):
        self.number, self.seen, self.forms = number, {}, {f.partition("#")[0] for f in number}

    def found(self, text: str | None) -> list[int]:
        n: Counter = Counter()
        seen = self.seen
        for w in words(text):
            own = seen.get(w)
            if own is None:
                if len(seen) > REMEMBERED:
                    seen.clear()
                own = seen[w] = tuple(f for f in features(w) if f in self.forms)
            if own:
                n.update(own)
        number = self.number
        return sorted(number[g] for f, c in n.items() for g in (f, f"{f}#2", f"{f}#3")[:c] if g in number)


def _numbered(shared):
    """Replaces text by its features' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(shared.value)
        for b in batches:
            yield b.drop_columns(["text"]).append_column("found", pa.array([numbers.found(t.as_py()) for t in b.column("text")], pa.list_(pa.int32())))

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each entry of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False)


def _frequencies(size: int):
    """Documents with each number, summed per task; place ``size`` counts all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, np.int64)
        for b in batches:
            n[:size] += np.bincount(flat(b.column("found"))[1], minlength=size)
            n[size] += b.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["place", "n"])

    return run


def sums(w: np.ndarray, bias: float, place: np.ndarray, batches: Iterator[pa.Array]) -> np.ndarray:
    """Over documents: sums of s x, of s, of loss(-), of s (1 - s) |x| x, of s (1 - s) |x|, and their number; s is the score.

    ``place``: weight of each number, or the place after the last for numbers without one. |x| counts a document's
    features and the intercept, so that the last but two sums are rows of a matrix that the curvature doesn't exceed.
    """
    n = len(w)
    out = np.zeros(2 * (n + 1) + 2)
    for column in batches:
        row, number = flat(column)
        at = place[number]
        row, at = row[at < n], at[at < n]
        z = np.bincount(row, w[at], len(column)) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        h = s * (1 - s) * (np.bincount(row, minlength=len(column)) + 1)
        out[:n] += np.bincount(at, s[row], n)
        out[n] += s.sum()
        out[n + 1 : 2 * n + 1] += np.bincount(at, h[row], n)
        out[2 * n + 1] += h.sum()
        out[2 * n + 2] += np.logaddexp(0, z).sum()
        out[2 * n + 3] += len(column)
    return out


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums(*shared.value, (b.column("found") for b in batches))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    return run


def step(w: np.ndarray, bias: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """A step down the risk from the sums of the positives and of the unlabelled text.

    The logistic loss has loss(+) - loss(-) = -z, so the risk is ``E_u[loss(-)] - prior * E_p[z]`` and bends with the
    unlabelled text alone; a bound of its curvature for each weight makes the step a sure descent.
    """
    n = len(w)
    n_p, n_u = p[2 * n + 3], u[2 * n + 3]
    negative = u[2 * n + 2] / n_u - prior * p[2 * n + 2] / n_p
    gp, gu = -prior * p[: n + 1] / n_p, u[: n + 1] / n_u
    g = -(gp + gu)
    if negative >= 0:
        # prior * E_p[loss(+)]' is prior * (s - 1) x; ``counts`` are the sums of x.
        counts = np.append(p[2 * n + 4 :], n_p)
        g = gu - prior * counts / n_p
    g[:n] += DECAY * w
    curve = u[n + 1 : 2 * n + 2] / n_u + prior * p[n + 1 : 2 * n + 2] / n_p + DECAY + 1e-9
    move = np.clip(g / curve, -1.0, 1.0)
    return w - move[:n], bias - float(move[n])


def gains(p: np.ndarray, u: np.ndarray, n_p: float, n_u: float) -> np.ndarray:
    """Log-likelihood ratio of "more frequent among positives"; 0 where it isn't."""
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda k, n: np.where(k > 0, k * np.log(k / ((p + u) * (n / (n_p + n_u)))), 0.0)
        return np.where(p * n_u > u * n_p, 2 * (term(p, n_p) + term(u, n_u)), 0.0)


def _drawn(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """About ``most`` texts of (doc_id, text), drawn by a hash of both; rows that repeat both count once."""
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    n = rows.agg(F.approx_count_distinct(key)).first()[0]
    pick = F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(1_000_003)) / 1_000_003.0
    keyed = rows.withColumn("key", key)
    return keyed.where(pick < most / max(n, 1)).groupBy("key", "doc_id").agg(F.first("text").alias("text")).select("text")


def fit(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, rounds: int = ROUNDS) -> Model:
    """A model from training rows (doc_id, text) and labels (doc_id, toxic); null ids and null labels teach nothing.

    A document labelled more than once is toxic if any label says so. ``positives`` bounds the labelled rows, ``unlabelled``
    the documents of the first guess; both are drawn by a hash of id and text, and repeated rows are drawn once. All rows
    are unlabelled text in the choice of features and in the rounds, repeated ones as often as they occur. Without toxic
    training rows every score is 0.
    """
    spark = rows.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "toxicity")
    ids = rows.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = scratch.table(ids.select("doc_id").join(marks, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("toxic").alias("toxic")), "marked")
    n, toxic = marked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("toxic")), F.lit(0))).first()
    if not toxic:
        return Model({}, -500.0)
    prior = min(0.95, toxic / n)
    known = ids.join(marked.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    p = _drawn(known, positives, "p").withColumn("positive", F.lit(True))
    u = _drawn(ids, unlabelled, "u").withColumn("positive", F.lit(False))
    sample = scratch.table(p.unionByName(u), "sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))))
    counted = sample.mapInArrow(tidy(_count), "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST)
    rises = F.col("p") * n_u > F.col("u") * n_p
    # Few features with a p of LEAST or more rise at all; the most frequent of them are the candidates.
    seen = counted.where(rises).orderBy(F.desc(F.col("p") * n_u - F.col("u") * n_p), "feature").limit(8 * SCREENED).toArrow()
    table = {k: seen.column(k).to_numpy(zero_copy_only=False) for k in ("feature", "p", "u")}
    gain = gains(table["p"], table["u"], n_p, n_u)
    order = [i for i in np.lexsort((table["feature"].astype(str), -gain)) if gain[i] >= LIKELY][:SCREENED]
    names, count_p = [str(table["feature"][i]) for i in order], table["p"][order]
    numbers = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    found = scratch.table(ids.select("text").mapInArrow(tidy(_numbered(numbers)), "found array<int>"), "found")
    counts = np.zeros(len(names) + 1)
    for r in found.mapInArrow(tidy(_frequencies(len(names))), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[r["place"]] = r["n"]
    # Shares of all training texts, in units of the first guess's sample, so that the significance asked for stays the same.
    gain = gains(count_p, counts[:-1] / max(counts[-1], 1) * n_u, n_p, n_u)
    best = [i for i in np.lexsort((names, -gain)) if gain[i] >= SIGNIFICANT][:FEATURES]
    chosen = sorted(distinct_forms({names[i]: int(count_p[i]) for i in best}))
    at = {f: i for i, f in enumerate(names)}
    place = np.full(len(names) + 1, len(chosen), np.int64)
    place[[at[f] for f in chosen]] = np.arange(len(chosen))
    final = spark.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})
    docs = sorted((r["positive"], list(r["found"])) for r in sample.select("positive", "text").mapInArrow(tidy(_numbered(final)), "positive boolean, found array<int>").collect())
    p_docs, u_docs = [np.array(f, np.int64) for y, f in docs if y], [np.array(f, np.int64) for y, f in docs if not y]
    w, bias = train(p_docs, u_docs, len(chosen), prior)
    p_rows = pa.array([d.tolist() for d in p_docs], pa.list_(pa.int32()))
    seen_p = np.bincount(flat(p_rows)[1], minlength=len(chosen))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((w, bias, place))
        total = np.zeros(2 * (len(w) + 1) + 2)
        for r in found.mapInArrow(tidy(_sums(shared)), "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
            total[r["place"]] = r["n"]
        own = sums(w, bias, np.arange(len(chosen) + 1), [p_rows])
        w, bias = step(w, bias, np.concatenate([own, seen_p]), total, prior)
        shared.unpersist()
    scratch.drop(marked, sample, found)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-6}, float(bias))


def score(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5); columns of the names given are replaced, all rows stay."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, own = place(docs, "text"), [i for i, c in enumerate(docs.columns) if c.lower() not in (score.lower(), predicted.lower())]
    schema = T.StructType([*[docs.schema.fields[i] for i in own], T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a task remembers goes with it; a broadcast value stays with the worker.
        m = Model(shared.value.weights, shared.value.bias)
        for b in batches:
            s = [m.score(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in own], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[str(i) for i in range(len(own) + 2)])

    return map_rows(docs, run, schema)
