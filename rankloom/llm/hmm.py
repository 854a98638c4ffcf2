"""Operator 6 - hidden Markov language model over words.

Latent states emit symbols: each of the most frequent words is a symbol of its own, the end of a text is one, and other
words fall into classes by their last letters. P(word | state) is P(symbol | state), times P(word | class) for words of a
class, where every known word gives up half a count to the class's unknown words. Over known words, the end and one
unknown word a class, each state's probabilities add up to one.

Word counts cover all training texts and stay distributed; only tables of bounded size (symbols, and the counts of words
above a frequency) reach the driver and the workers, and other words meet their counts by a join. Baum-Welch counts are
summed over the partitions of all training texts. Texts are cut into blocks of tokens that overlap: the recursions of a
block begin and end ``MARGIN`` tokens outside it, by when they have all but forgotten how they began, and each token and
each move from one token to the next is counted in one block. A first guess comes from a bounded sample of blocks. Scores
are exact: a scaled forward recursion over each whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch

#: Words with symbols of their own, classes of other words, latent states; most words whose counts are sent to workers.
TOP, CLASSES, STATES, CACHED = 8192, 2048, 8, 1 << 18
#: Rounds over all training texts; sample blocks and rounds of the first guess; tokens of a block, and of its margins; tokens handled at once; blocks handled at once.
ROUNDS, SAMPLE, FIRST_ROUNDS, BLOCK, MARGIN, HELD, SLICE = 3, 2500, 15, 512, 16, 1 << 20, 1024
END = b" "  # no word is a space


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at the contract's white space; no end token."""
    return (text or b"").lower().split()


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


# -- the model ----------------------------------------------------------------------------------------------------


@dataclass
class Hmm:
    """Start (K), moves (K x K) and emissions by symbol (S x K)."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    def forward(self, rows: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each symbol row, all rows in step, longest first."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        sizes = np.array([len(rows[i]) for i in order])
        flat, first = np.concatenate([rows[i] for i in order]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])[:-1]
        out, a = np.zeros(len(rows)), None
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        for t in range(int(sizes[0])):
            n = int(active[t])
            e = self.emits[flat[first[:n] + t]]
            a = self.start * e if a is None else (a[:n] @ self.moves) * e
            norm = a.sum(axis=1)
            a /= norm[:, None]
            out[:n] += np.log(norm)
        back = np.empty(len(rows))
        back[order] = out
        return back

    def expect(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, moves, emissions) of the tokens that blocks count, and of the moves into them."""
        order = np.argsort(-blocks.lengths, kind="stable")
        rows, lengths, low, high = blocks.symbols[order], blocks.lengths[order], blocks.low[order], blocks.high[order]
        top, k = int(lengths[0]), len(self.start)
        active = np.searchsorted(-lengths, -np.arange(top), side="left")
        alphas, norms, a = [], [], None
        # A block that counts its first token begins its text.
        begins = low == 0
        begin = np.where(begins[:, None], self.start, 1.0 / k)
        for t in range(top):
            n = int(active[t])
            e = self.emits[rows[:n, t]]
            a = begin * e if a is None else (a[:n] @ self.moves) * e
            norm = a.sum(axis=1, keepdims=True)
            a = a / norm
            alphas.append(a)
            norms.append(norm)
        moves, symbols, gammas = np.zeros((k, k)), [], []
        beta = np.zeros((0, k))
        for t in range(top - 1, -1, -1):
            n = int(active[t])
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k))])
            counted = ((low[:n] <= t) & (t < high[:n]))[:, None]
            gammas.append(alphas[t] * beta * counted)
            symbols.append(rows[:n, t])
            if t:
                weight = self.emits[rows[:n, t]] * beta / norms[t]
                moves += alphas[t - 1][:n].T @ (weight * counted)
                beta = weight @ self.moves.T
        gamma, s = np.concatenate(gammas), np.concatenate(symbols)
        emits = np.stack([np.bincount(s, gamma[:, j], len(self.emits)) for j in range(k)], axis=1)
        return gammas[-1][begins].sum(axis=0), moves * self.moves, emits

    def expect_all(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same in slices, so that memory doesn't grow with the blocks."""
        total = [np.zeros(x.shape) for x in (self.start, self.moves, self.emits)]
        for at in range(0, len(blocks.lengths), SLICE):
            for into, some in zip(total, self.expect(blocks[at : at + SLICE]), strict=True):
                into += some
        return tuple(total)

    @staticmethod
    def update(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray) -> Hmm:
        """The model of expected counts, smoothed so that every symbol can come from every state."""
        e = emits + 20.0 * unigram[:, None]
        return Hmm((start + 0.1) / (start + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), e / e.sum(axis=0))


@dataclass
class Blocks:
    """Padded rows of symbols with their lengths; tokens from ``low`` up to ``high`` count, the others are margins."""

    symbols: np.ndarray
    lengths: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __getitem__(self, at: slice) -> Blocks:
        return Blocks(self.symbols[at], self.lengths[at], self.low[at], self.high[at])


def cuts(n: int, size: int, margin: int) -> list[tuple[int, int, int, int]]:
    """(from, to, low, high) of the blocks of a row of ``n`` tokens; low and high count from the block's first token."""
    return [(a := max(0, at - margin), min(n, at + size + margin), at - a, min(n, at + size) - a) for at in range(0, n, size)]


def blocks_of(rows: list[np.ndarray], size: int = BLOCK, margin: int = MARGIN) -> Blocks:
    """Rows cut into overlapping blocks. Every token counts in one block; ``margin`` is 1 at least, for the moves over borders."""
    found = [(r, *c) for r in rows for c in cuts(len(r), size, margin)]
    symbols = np.zeros((len(found), size + 2 * margin), np.int64)
    for k, (r, a, b, _, _) in enumerate(found):
        symbols[k, : b - a] = r[a:b]
    lengths, low, high = (np.array([f(x) for x in found], np.int64) for f in (lambda x: x[2] - x[1], lambda x: x[3], lambda x: x[4]))
    return Blocks(symbols, lengths, low, high)


def first_guess(blocks: Blocks | None, unigram: np.ndarray, states: int, rounds: int = FIRST_ROUNDS, seed: int = 6) -> Hmm:
    """A model from sample blocks: states begin as noisy copies of the word frequencies that tend to stay."""
    rng = np.random.default_rng(seed)
    noisy = unigram[:, None] * np.exp(rng.normal(0, 1.0, (len(unigram), states)))
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1)), noisy / noisy.sum(axis=0))
    model.moves /= model.moves.sum(axis=1, keepdims=True)
    for _ in range(rounds if blocks is not None and len(blocks.lengths) else 0):
        model = Hmm.update(*model.expect_all(blocks), unigram)
    return model


# -- counts -------------------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column("text").cast(pa.large_binary()):
            n.update(tokens(t.as_py()))
            n[END] += 1
            if len(n) > 250_000:
                yield out()
                n.clear()
    if n:
        yield out()


@dataclass
class Vocabulary:
    """Bounded tables for the workers: frequent words with their symbols and counts, and the classes' totals.

    Symbols: words of their own, then the end, then the classes. ``mass`` and ``types``: tokens and words of each class.
    """

    symbols: dict[bytes, int]
    counts: np.ndarray
    own: int
    classes: int
    total: int
    distinct: int
    mass: np.ndarray
    types: np.ndarray

    def base_log(self, c: np.ndarray | float) -> np.ndarray | float:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def known_log(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of known words; unknown words: :meth:`unknown_log`."""
        return np.log10((c - 0.5) / (self.mass[k] + 0.5))

    def unknown_log(self) -> np.ndarray:
        return np.log10((0.5 * self.types + 0.5) / (self.mass + 0.5))

    def unigram(self) -> np.ndarray:
        f = np.concatenate([self.counts[: self.own], [self.counts[-1]], self.mass]) + 0.5
        return f / f.sum()


def _class_totals(own: set[bytes], classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if w not in own and w != END:
                    k = word_class(w, classes)
                    mass[k] += n
                    types[k] += 1
        found = np.flatnonzero(types)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(mass[found]), pa.array(types[found])], names=["k", "mass", "types"])

    return run


def vocabulary(counts: DataFrame, top: int = TOP, classes: int = CLASSES, cached: int = CACHED) -> Vocabulary:
    """Tables from the word counts; the ``top`` first by count and word have symbols of their own.

    Words with equal counts are cached or left together, but for the first of them by word that ``top`` has room for.
    """
    words = counts.where(F.col("word") != F.lit(END))
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    spread = sorted(((r["n"], r["count"]) for r in words.groupBy("n").count().where("n > 1").collect()), reverse=True)

    def least(most: int) -> int:
        sum_, low = 0, 1 << 62
        for n, c in spread:
            if (sum_ := sum_ + c) > most:
                break
            low = n
        return low

    kept = words.where(F.col("n") >= least(cached)).toArrow()
    rows = sorted(zip(kept.column("n").to_pylist(), kept.column("word").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    rest = [n for n, _ in spread if n < least(cached)]
    if len(rows) < top and rest:
        rows += [(r["n"], bytes(r["word"])) for r in words.where(F.col("n") == rest[0]).orderBy("word").limit(top - len(rows)).collect()]
    own = min(top, len(rows))
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0
    shared = counts.sparkSession.sparkContext.broadcast({w for _, w in rows[:own]})

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _class_totals(shared.value, classes)(batches)

    mass, types = np.zeros(classes), np.zeros(classes)
    for r in counts.mapInArrow(totals, "k long, mass long, types long").groupBy("k").agg(F.sum("mass").alias("mass"), F.sum("types").alias("types")).collect():
        mass[r["k"]], types[r["k"]] = r["mass"], r["types"]
    symbols = {w: i if i < own else own + 1 + word_class(w, classes) for i, (_, w) in enumerate(rows)}
    return Vocabulary(symbols, np.array([n for n, _ in rows] + [ends], np.float64), own, classes, total, distinct, mass, types)


class _Lookup(dict):
    """Word -> place in the cached tables; other words are kept aside and get -1 minus their class."""

    def __init__(self, v: Vocabulary):
        super().__init__((w, i) for i, w in enumerate(v.symbols))
        self.aside: list[bytes] = []
        self.classes = v.classes

    def __missing__(self, word: bytes) -> int:
        self.aside.append(word)
        return -1 - word_class(word, self.classes)


#: The worker's tables, with the vocabulary that they were made for.
_LOOKUPS: list[tuple] = []


def _symbols(shared):
    """Per text: counts, parts of the scores that cached words give, symbols, and the other words with their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        if not _LOOKUPS or _LOOKUPS[0][0] is not v:
            symbol = np.array(list(v.symbols.values()) or [0], np.int64)
            k = np.maximum(symbol - v.own - 1, 0)
            given = np.where(symbol > v.own, v.known_log(np.append(v.counts[:-1], [1.0] * (not v.symbols)), k), 0.0)
            _LOOKUPS[:] = [(v, _Lookup(v), symbol, np.append(v.base_log(v.counts[:-1]), 0.0), given)]
        _, lookup, symbol, base, given = _LOOKUPS[0]
        end = float(v.base_log(v.counts[-1]))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, rows = b.slice(at, 512), []
                for t in part.column("text").cast(pa.large_binary()):
                    w = tokens(t.as_py())
                    lookup.aside = []
                    code = np.fromiter(map(lookup.__getitem__, w), np.int64, len(w))
                    hit = code >= 0
                    known = code[hit]
                    s = np.append(np.where(hit, symbol[np.maximum(code, 0)], v.own - code), v.own).astype("<i2")
                    rows.append((len(w) + 1, len(known) + (v.counts[-1] > 0), float(base[known].sum()) + end, float(given[known].sum()), s.tobytes(), lookup.aside, (-1 - code[~hit]).tolist()))
                lookup.aside = []
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "given", "symbols", "words", "classes"])

    return run


SYMBOLS = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, given double, symbols binary, words array<binary>, classes array<int>"


def _rows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Symbol rows and their uids, about ``HELD`` tokens at a time."""
    rows, ids, held = [], [], 0
    for b in batches:
        for i, s in zip(b.column("uid").to_pylist(), b.column(column), strict=True):
            rows.append(np.frombuffer(s.as_py(), "<i2"))
            ids.append(i)
            held += len(rows[-1])
            if held >= HELD:
                yield rows, ids
                rows, ids, held = [], [], 0
    if rows:
        yield rows, ids


def _expected(shared):
    """Expected counts of a partition, as (place, sum) with start, moves and emissions in one row of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Hmm = shared.value
        total = np.zeros(m.start.size + m.moves.size + m.emits.size)
        for rows, _ in _rows(batches, "symbols"):
            total += np.concatenate([x.ravel() for x in m.expect_all(blocks_of(rows))])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["place", "n"])

    return run


def _sampled(share: float, size: int, margin: int):
    """Blocks drawn by a hash of what they hold and where: pick, low, high and symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for s in b.column("symbols"):
                row = np.frombuffer(s.as_py(), "<i2")
                for no, (a, z, low, high) in enumerate(cuts(len(row), size, margin)):
                    data = row[a:z].tobytes()
                    if (pick := zlib.crc32(data, no) / 2**32) < share:
                        found.append((pick, low, high, data))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.binary()))], names=["pick", "low", "high", "data"])

    return run


def baum_welch(train: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS, sample: int = SAMPLE) -> Hmm:
    """A model from (uid, n_tokens, symbols). ``sample`` bounds the blocks of the first guess; the rounds count all texts."""
    n = train.agg(F.coalesce(F.sum(F.ceil(F.col("n_tokens") / BLOCK)), F.lit(0))).first()[0]
    some = train.select("symbols").mapInArrow(_sampled(sample / max(n, 1), BLOCK, MARGIN), "pick double, low long, high long, data binary").distinct().orderBy("pick", "data").limit(sample).collect()
    blocks = None
    if some:
        symbols = np.zeros((len(some), BLOCK + 2 * MARGIN), np.int64)
        for i, r in enumerate(some):
            symbols[i, : len(r["data"]) // 2] = np.frombuffer(r["data"], "<i2")
        blocks = Blocks(symbols, np.array([len(r["data"]) // 2 for r in some]), np.array([r["low"] for r in some]), np.array([r["high"] for r in some]))
    model = first_guess(blocks, unigram, states)
    k, size = states, len(unigram)
    for _ in range(rounds if n else 0):
        shared = train.sparkSession.sparkContext.broadcast(model)
        sums = train.select("uid", "symbols").mapInArrow(_expected(shared), "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(k + k * k + size * k)
        total[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
        model = Hmm.update(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(size, k), unigram)
        shared.unpersist()
    return model


def _likelihoods(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids in _rows(batches, "symbols"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared.value.forward(rows) / np.log(10))], names=["uid", "chain"])

    return run


def score(docs: DataFrame, held: Column, top: int = TOP, classes: int = CLASSES, cached: int = CACHED, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held`` says which rows are held out; all others teach. A null text is empty and has the end token only. Repeated
    rows and null ids keep their rows; other columns play no part; an empty table gives an empty result. Without training
    rows nothing is known, and both scores follow from uniform counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    lean = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    counts = scratch.table(lean.where("not held_out").select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    v = vocabulary(counts, top, classes, cached)
    table = scratch.table(lean.mapInArrow(_symbols(spark.sparkContext.broadcast(v)), SYMBOLS).withColumn("uid", F.monotonically_increasing_id()), "symbols")
    model = baum_welch(table.where("not held_out").select("uid", "n_tokens", "symbols"), v.unigram(), states, rounds)
    chain = table.select("uid", "symbols").mapInArrow(_likelihoods(spark.sparkContext.broadcast(model)), "uid long, chain double")
    # Words outside the bounded table meet their counts by a join; repeats in a text are summed first.
    rare = table.select("uid", F.explode(F.arrays_zip("words", "classes")).alias("w")).groupBy("uid", "w.words", "w.classes").agg(F.count("*").alias("times")).withColumnRenamed("words", "word")
    met = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mass, unknown = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (v.mass, v.unknown_log()))
    at = F.col("classes") + 1
    given = F.when(F.col("n") > 0, F.log10((F.col("n") - 0.5) / (F.element_at(mass, at) + 0.5))).otherwise(F.element_at(unknown, at))
    base = F.log10((F.col("n") + 0.5) / F.lit(v.total + 0.5 * (v.distinct + 1)))
    rest = met.groupBy("uid").agg(F.sum(base * F.col("times")).alias("base2"), F.sum(given * F.col("times")).alias("given2"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known2"))
    out = table.drop("symbols", "words", "classes").join(chain, "uid").join(rest, "uid", "left").na.fill(0, ["base2", "given2", "known2"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known2")).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base2")).alias("base_score"), (F.col("chain") + F.col("given") + F.col("given2")).alias("score"),
    )
