"""Operator 10 - mixing sources to target weights.

The words of a source, document after document by hashed order, are packed into blocks of fixed length. Rows equal in id and
text are packed side by side as one run, so that neither the order of the rows nor a text that a third of them repeat matters. The output is a row of slots in
shards; each shard's source counts are a multinomial draw by what the sources still have to give, so that the sums meet
the targets. The k-th slot of a source maps to a block through the source's pseudorandom permutation of block numbers,
one permutation for each pass over the source, and slots meet blocks by an equality join on (source, block). A source's
last slot is cut so that the words taken equal its target to the nearest word. A target is at most three passes, so no
word is taken more than three times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.common import WORD, Scratch, free, map_rows, n_partitions, short_batches, tidy

WEIGHTS = (5, 2, 1)
#: Passes over a source at most; words in a block; most shards; seed of draws and permutations.
MOST, BLOCK, SHARDS, SEED = 3.0, 512, 256, 20
#: The table of so many sources at most is broadcast; a longer one is joined by shuffling.
SMALL = 10_000
#: Slots that a row of a shard's plan is unfolded to; chunks of a stretch of prefix sums.
RANGE, STRETCH = 1 << 14, 2048


def water_fill(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets that share the sum of sizes by weight, none above ``most`` times its size."""
    targets, free = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    rest = float(sum(sizes))
    while free:
        share = rest / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * share > most * sizes[i]]
        for i in over or free:
            targets[i] = most * sizes[i] if over else weights[i] * share
        if not over:
            break
        rest -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return targets


def _keys(seed: int, source: int, epoch: int) -> list[int]:
    h = hashlib.sha256(f"{seed}/{source}/{epoch}".encode()).digest()
    return [int.from_bytes(h[8 * i : 8 * i + 8], "little") for i in range(4)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, keys: list[int], back: bool = False) -> np.ndarray:
    """A permutation of range(n): four Feistel rounds on the next even number of bits; values beyond n walk on."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Quota:
    """What a source gives: words, its target, blocks, slots, and the words of its last slot (-1: the whole block)."""

    source: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_words: int


def quotas(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = SEED) -> list[Quota]:
    """Quotas of the sources, by code point with null last; their weights repeat."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    targets = water_fill([n for _, n in order], [weights[i % len(weights)] for i in range(len(order))])
    out = []
    for i, ((source, n), target) in enumerate(zip(order, targets, strict=True)):
        blocks, short = -(-n // block), n % block or block
        passes, rest = divmod(round(target), n) if n else (0, 0)
        slots, last = passes * blocks, -1
        if rest:
            # The short block comes somewhere in the last pass; the slots before the end must hold ``rest`` words.
            at = int(permute(np.array([blocks - 1]), blocks, _keys(seed, i, passes), back=True)[0])
            held = lambda j: j * block - (block - short) * (at < j)
            j = -(-rest // block)
            j += held(j) < rest
            slots, last = slots + j, rest - held(j - 1)
            last = -1 if last == (short if at == j - 1 else block) else last
        out.append(Quota(source, n, target, blocks, slots, last))
    return out


def shard_counts(slots: list[int], shards: int = SHARDS, least: int = 1024, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot of the source, slots): multinomial draws by the slots left, which they never exceed."""
    rng, left, total = np.random.default_rng(seed), np.array(slots, np.int64), sum(slots)
    per, first, out = max(least, -(-total // shards)), np.zeros(len(slots), np.int64), []
    shard = 0
    while (rest := int(left.sum())) > 0:
        want = min(per, rest)
        draw = np.minimum(rng.multinomial(want, left / rest), left)
        while (lack := want - int(draw.sum())) > 0:
            spare = left - draw
            draw += np.minimum(rng.multinomial(lack, spare / spare.sum()), spare)
        out += [(shard, i, int(first[i]), int(n)) for i, n in enumerate(draw) if n]
        left, first, shard = left - draw, first + draw, shard + 1
    return out


def _slot_blocks(plan: list[Quota], block: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, k = b.column("ix").to_numpy(), b.column("k").to_numpy()
            at, words = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for i in np.unique(source):
                q = plan[i]
                for epoch in np.unique(k[source == i] // q.blocks):
                    here = np.flatnonzero((source == i) & (k // q.blocks == epoch))
                    at[here] = permute(k[here] % q.blocks, q.blocks, _keys(seed, int(i), int(epoch)))
                here = np.flatnonzero(source == i)
                words[here] = np.where(at[here] == q.blocks - 1, q.size - (q.blocks - 1) * block, block)
                if q.last_words >= 0:
                    words[here[k[here] == q.slots - 1]] = -q.last_words
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("ix"), b.column("k"), pa.array(at), pa.array(words)], names=["shard", "ix", "k", "block", "words"])

    return run


class Mix:
    """A mix of ``docs`` (doc_id, text, source and any other columns).

    ``keep``: whether the rows' own columns are kept for :meth:`documents`. Null texts have size 0; documents without
    words and sources without words give and take nothing; null sources form one source; repeated rows are rows of their
    own. An empty table gives an empty mix. The number of sources must fit the driver; no document is collected.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = SEED, keep: bool = False, stretch: int = STRETCH):
        spark = docs.sparkSession
        short_batches(spark)
        self.spark, self.block, self.seed = spark, block, seed
        self.scratch = scratch = Scratch(spark, "mix")
        inside = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.lit(0)
        rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("th"), inside.alias("row"), F.monotonically_increasing_id().alias("uid"))
        self.rows = scratch.table(rows, "rows")
        stats = self.rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        self.plan = quotas([(r["source"], r["size"]) for r in stats], weights, block, seed)
        named = [(i, q.source, q.size, q.target) for i, q in enumerate(self.plan)]
        self.sources = spark.createDataFrame(named, "ix int, source string, source_size long, target double")
        known = self.sources.select("ix", F.col("source").alias("s"))
        known = F.broadcast(known) if len(self.plan) <= SMALL else known
        # ``part`` tells the task that numbered a row: copies of a row are counted there before they meet.
        lean = self.rows.join(known, F.col("source").eqNullSafe(F.col("s"))).select("uid", "doc_id", "size", "th", "ix", F.shiftright("uid", 33).alias("part"))
        self.numbered = lean
        full = lean.where("size > 0")
        run = ["ix", "doc_id", "th", "size"]
        copies = full.groupBy(*run, "part").agg(F.count("*").alias("n"))
        runs = copies.groupBy(*run).agg(F.sum(F.col("n") * F.col("size")).alias("words"))
        # Prefix sums in three levels: over stretches of hashed chunks of a source, over the chunks of a stretch, and inside each chunk. A hot source is many chunks.
        chunks = max(64, sum(r["n"] for r in stats) // 4096)
        runs = runs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th", "size"), F.lit(chunks)))
        sums = runs.groupBy("ix", "chunk").agg(F.sum("words").alias("words")).withColumn("stretch", F.expr(f"chunk div {stretch}"))
        upto = lambda *by: F.sum("words").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
        whole = sums.groupBy("ix", "stretch").agg(F.sum("words").alias("words")).withColumn("far", upto("ix", "stretch")).select("ix", "stretch", "far")
        before = sums.withColumn("near", upto("ix", "stretch", "chunk")).join(whole, ["ix", "stretch"]).select("ix", "chunk", (F.col("far") + F.col("near")).alias("base"))
        inner = F.sum("words").over(W.partitionBy("ix", "chunk").orderBy("doc_id", "th", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
        starts = runs.withColumn("inner", inner).join(before, ["ix", "chunk"]).select(*run, (F.col("base") + F.col("inner")).alias("start"))
        # Copies of a row stand one after the other: by the task that numbered them, then by number.
        same = lambda a, b: (F.col(f"{a}.ix") == F.col(f"{b}.ix")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
        earlier = F.sum("n").over(W.partitionBy(*run).orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
        placed = copies.withColumn("earlier", earlier).alias("c").join(starts.alias("s"), same("c", "s")).select("c.*", (F.col("s.start") + F.col("c.earlier") * F.col("c.size")).alias("start"))
        place = F.row_number().over(W.partitionBy(*run, "part").orderBy("uid")) - 1
        self.spans = full.withColumn("place", place).alias("f").join(placed.alias("p"), same("f", "p") & (F.col("f.part") == F.col("p.part"))).select("f.uid", "f.ix", (F.col("p.start") + F.col("f.place") * F.col("f.size")).alias("start"), "f.size")

    def slots(self, length: int = RANGE) -> DataFrame:
        """(shard, ix, k, block, words): the output's slots; words is negative where only the block's first words fit.

        A shard's share of a source is cut into ranges of ``length`` slots, so a row unfolds to that many at most.
        """
        counts = shard_counts([q.slots for q in self.plan], seed=self.seed)
        table = self.spark.createDataFrame(counts, "shard int, ix int, first long, n long")
        last = F.col("first") + F.col("n") - 1
        ranges = table.select("shard", "ix", last.alias("last"), F.explode(F.sequence("first", last, F.lit(length).cast("long"))).alias("a"))
        each = ranges.repartition(n_partitions(self.spark)).select("shard", "ix", F.explode(F.sequence("a", F.least("last", F.col("a") + (length - 1)))).alias("k"))
        return each.mapInArrow(tidy(_slot_blocks(self.plan, self.block, self.seed)), "shard int, ix int, k long, block long, words long")

    def pieces(self) -> DataFrame:
        """(uid, block, lo, hi, times, part): document words lo..hi lie in the block, are taken ``times`` times, the first ``part`` of them once more."""
        b = self.block
        taken = self.slots().groupBy("ix", "block").agg(F.sum((F.col("words") > 0).cast("long")).alias("times"), F.sum(F.when(F.col("words") < 0, -F.col("words")).otherwise(0)).alias("part"))
        each = self.spans.withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
        lo = F.greatest(F.lit(0), F.col("block") * b - F.col("start"))
        hi = F.least("size", (F.col("block") + 1) * b - F.col("start"))
        part = F.greatest(F.lit(0), F.least(hi, F.col("block") * b + F.col("part") - F.col("start")) - lo)
        # A row for each block: as it grows with the texts, it is never broadcast, however well it compresses.
        return each.join(taken.hint("merge"), ["ix", "block"]).select("uid", "block", lo.alias("lo"), hi.alias("hi"), "times", part.alias("part"))

    def taken(self) -> DataFrame:
        """Every row: doc_id, size, source_size, target, taken."""
        words = self.pieces().groupBy("uid").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times") + F.col("part")).alias("taken"))
        sources = self.sources.drop("source")
        out = self.numbered.join(words, "uid", "left").join(F.broadcast(sources) if len(self.plan) <= SMALL else sources, "ix")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as rows with the columns of ``docs``: each pass that takes words of a document gives a row of those words.

        A pass that takes the whole document has its text unchanged; other texts are the taken words joined by spaces,
        with n_chars, if there is such a column, to match.
        """
        runs = self.pieces().groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times", "part"))).alias("runs"))
        kept = self.rows.join(runs, "uid").select("row", "size", "runs")
        fields = self.rows.schema["row"].dataType
        size, own = free(fields.names, "size", "runs")
        flat = kept.select("row.*", F.col("size").alias(size), F.col("runs").alias(own))
        lower = [n.lower() for n in fields.names]
        return map_rows(flat, _passes(lower.index("text"), lower.index("n_chars") if "n_chars" in lower else None), fields)


def _cut(text: str, size: int, runs: list[dict]) -> Iterator[str]:
    words: list[bytes] | None = None
    for turn in range(1 + max(r["times"] for r in runs)):
        spans = [(r["lo"], r["hi"] if r["times"] > turn else r["lo"] + r["part"]) for r in runs if r["times"] > turn or (r["times"] == turn and r["part"])]
        if sum(b - a for a, b in spans) == size:
            yield text
        elif spans:
            words = words or text.encode().split()
            yield b" ".join(w for a, b in spans for w in words[a:b]).decode()


def _passes(text_at: int, chars_at: int | None):
    """Rows, with size and runs as their last columns -> a row for each pass over the source that takes words of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, last = [], [], b.num_columns - 2
            for i, (text, n, own) in enumerate(zip(*[b.column(k).to_pylist() for k in (text_at, last, last + 1)], strict=True)):
                for piece in _cut(text, n, own):
                    at.append(i)
                    texts.append(piece)
            columns = b.select(list(range(last))).take(pa.array(at, pa.int64())).columns
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(last)])

    return run


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; nulls, repeats and empty tables as in :class:`Mix`."""
    return Mix(docs).taken()
