"""Operator 12 - ranked lexical search with a two-level quantised index.

The index is sharded by document: a segment holds the postings of some thousand documents, so no term, however frequent, is
a key that rows gather at, and nothing is shuffled to build it. A segment has two levels: for each posting one byte, its
impact rounded upwards; and the exact numbers (occurrences, lengths, ids). A query's weights times the bytes give bounds of
each document's score on either side.

A search reads the index three times: for the terms' document frequencies; for each item's k largest lower bounds, whose
smallest over all segments is the item's threshold; and for the documents whose upper bound reaches it, all of which are
scored anew in whole numbers. A document that is left out has a bound, and so a score, below k others'.

Items come in blocks of a bounded number; a block's terms, weights and thresholds are what tasks are sent.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.common import Scratch, short_batches

#: A term is a longest run of these characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 text as terms and blanks: A-Z lower-cased, other ASCII but letters and digits blank.
FOLDED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Documents found for an item. Documents and postings of a segment; items of a block, and of those scored at once; groups that an item's finds are cut to their best in before they meet.
BEST, DOCUMENTS, POSTINGS, BLOCK, AT_ONCE, SALTS = 50, 4096, 500_000, 2048, 256, 64
#: An impact is below MOST; a byte stands for STEP of it.
SATURATED, MOST = 1000, 1_000_000
STEP = -(-MOST // 255)
SEGMENT = "names binary, starts binary, at binary, impacts binary, counts binary, lengths binary, ids binary, known binary"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order. What is left after folding is split at blanks only."""
    return text.translate(FOLDED).split()


def impact(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a posting adds for each unit of its term's weight: occurrences against length, in whole numbers."""
    m = 50 + (50 * length * documents) // total
    return (1_000_000_000 * tf) // (SATURATED * tf + 20 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# -- the index ----------------------------------------------------------------------------------------------------


def _segment(rows: list[tuple[int | None, int, Counter]], documents: int, total: int) -> pa.RecordBatch:
    """The segment of some documents: (id, terms, occurrences of each)."""
    number: dict[bytes, int] = {}
    term = np.concatenate([np.zeros(0, np.int64), *[np.fromiter((number.setdefault(t, len(number)) for t in c), np.int64, len(c)) for _, _, c in rows]])
    count = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(c.values(), np.int64, len(c)) for _, _, c in rows]])
    at = np.repeat(np.arange(len(rows)), [len(c) for _, _, c in rows])
    length = np.array([n for _, n, _ in rows], np.int64)
    order = np.argsort(term, kind="stable")
    at, count = at[order], count[order]
    starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(number))))
    impacts = -(-impact(count, length[at], documents, total) // STEP)
    cells = [
        b"\n".join(number), starts.astype("<i4").tobytes(), at.astype("<u2").tobytes(), impacts.astype(np.uint8).tobytes(), count.astype("<i4").tobytes(), length.astype("<i8").tobytes(),
        np.array([i or 0 for i, _, _ in rows], "<i8").tobytes(), np.array([i is not None for i, _, _ in rows], np.uint8).tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=[x.split()[0] for x in SEGMENT.split(", ")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's documents that have a term, and all their terms."""
    for b in batches:
        n = [len(terms(t.as_py() or b"")) for t in b.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([pa.array([sum(k > 0 for k in n)]), pa.array([sum(n)])], names=["documents", "total"])


def _build(documents: int, total: int, most: int, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
                found = terms(text.as_py() or b"")
                if not found:
                    continue
                c = Counter(found)
                rows.append((i, len(found), c))
                held += len(c)
                if len(rows) >= most or held >= postings:
                    yield _segment(rows, documents, total)
                    rows, held = [], 0
        if rows:
            yield _segment(rows, documents, total)

    return run


@dataclass
class Index:
    """Segments of an index, and the numbers of its documents and of all their terms."""

    segments: DataFrame
    documents: int
    total: int
    scratch: Scratch


def build(docs: DataFrame, most: int = DOCUMENTS, postings: int = POSTINGS) -> Index:
    """Index the whole texts of ``docs`` (doc_id, text); texts that are null or have no term are in no result.

    ``most`` documents of a segment, 65,536 at most, as their places have two bytes.
    """
    if not 0 < most <= 1 << 16:
        raise ValueError("1 to 65,536 documents a segment")
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "lexical")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    documents, total = lean.select("text").mapInArrow(_counted, "documents long, total long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return Index(scratch.table(lean.mapInArrow(_build(documents, total, most, postings), SEGMENT), "segments"), documents, total, scratch)


# -- the search ---------------------------------------------------------------------------------------------------


@dataclass
class Asked:
    """A block of items: the number of each term, each item's terms and each term's items by number, and terms' weights."""

    number: dict[bytes, int]
    terms: list[list[int]]
    items: list[np.ndarray]
    weights: np.ndarray
    at_once: int = AT_ONCE

    @staticmethod
    def of(texts: list[set[bytes]], at_once: int = AT_ONCE) -> Asked:
        number: dict[bytes, int] = {}
        own = [[number.setdefault(t, len(number)) for t in sorted(text)] for text in texts]
        items: list[list[int]] = [[] for _ in number]
        for i, found in enumerate(own):
            for k in found:
                items[k].append(i)
        return Asked(number, own, [np.array(x) for x in items], np.zeros(len(items), np.int64), at_once)

    @property
    def size(self) -> int:
        return len(self.terms)


class Segment:
    """A segment as read, and the postings of a block's terms in it."""

    def __init__(self, b: pa.RecordBatch, row: int, asked: Asked):
        self.batch, self.row, self.asked = b, row, asked
        names = b.column("names")[row].as_py().split(b"\n")
        starts = self.cell("starts", "<i4").tolist()
        #: Where the postings of a term begin and end, by its number.
        self.found = {k: (starts[j], starts[j + 1]) for j, t in enumerate(names) if (k := asked.number.get(t)) is not None}

    def cell(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(self.batch.column(name)[self.row].as_buffer(), kind)

    def bounds(self, first: int, upper: bool) -> np.ndarray:
        """Bounds of every document's score for the ``at_once`` items from ``first`` on: a row a document."""
        at, impacts = self.cell("at", "<u2"), self.cell("impacts", np.uint8).astype(np.int64)
        # An impact of byte b is above (b - 1) * STEP, and b * STEP at most.
        value = impacts * STEP if upper else np.where(impacts > 0, (impacts - 1) * STEP + 1, 0)
        out = np.zeros((int(at.max()) + 1 if len(at) else 0, min(self.asked.at_once, self.asked.size - first)), np.int64)
        for k, (a, z) in self.found.items():
            items = self.asked.items[k]
            items = items[(items >= first) & (items < first + self.asked.at_once)] - first
            if len(items) and self.asked.weights[k]:
                out[np.ix_(at[a:z], items)] += (value[a:z] * self.asked.weights[k])[:, None]
        return out

    def exact(self, item: int, wanted: np.ndarray, documents: int, total: int) -> np.ndarray:
        """Scores of the documents at places ``wanted`` (rising) for an item."""
        at, counts, lengths = self.cell("at", "<u2"), self.cell("counts", "<i4"), self.cell("lengths", "<i8")
        out = np.zeros(len(wanted), np.int64)
        for k in self.asked.terms[item]:
            if k in self.found and self.asked.weights[k]:
                a, z = self.found[k]
                place = np.minimum(np.searchsorted(at[a:z], wanted), z - a - 1)
                has = np.flatnonzero(at[a:z][place] == wanted)
                tf = counts[a + place[has]].astype(np.int64)
                out[has] += self.asked.weights[k] * impact(tf, lengths[wanted[has]], documents, total)
        return out


def _frequencies(shared):
    """Documents of each of the block's terms, by number, summed over a task's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        n = np.zeros(len(asked.number), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                s = Segment(b, row, asked)
                for k, (a, z) in s.found.items():
                    n[k] += z - a
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["term", "n"])

    return run


def _lower(shared, k: int):
    """The k largest lower bounds above 0 that a task finds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        best = np.zeros((k, asked.size), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                s = Segment(b, row, asked)
                for first in range(0, asked.size, asked.at_once):
                    own = slice(first, first + asked.at_once)
                    all_ = np.concatenate([best[:, own], s.bounds(first, False)])
                    best[:, own] = np.partition(all_, len(all_) - k, axis=0)[len(all_) - k :]
        at, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(best[at, item])], names=["item", "low"])

    return run


def _rescored(shared, k: int, documents: int, total: int):
    """Of the documents whose upper bound reaches an item's threshold, the k best of each task by exact score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, thresholds = shared.value
        found: dict[int, tuple[np.ndarray, ...]] = {}
        for b in batches:
            for row in range(b.num_rows):
                s = Segment(b, row, asked)
                for first in range(0, asked.size, asked.at_once):
                    reached = s.bounds(first, True) >= np.maximum(thresholds[first : first + asked.at_once], 1)
                    for item in np.flatnonzero(reached.any(axis=0)):
                        wanted = np.flatnonzero(reached[:, item])
                        scores = s.exact(first + int(item), wanted, documents, total)
                        own = [scores, s.cell("known", np.uint8)[wanted], s.cell("ids", "<i8")[wanted]]
                        if (old := found.get(first + int(item))) is not None:
                            own = [np.concatenate(x) for x in zip(old, own, strict=True)]
                        scores, known, ids = own
                        order = np.lexsort((ids, 1 - known, -scores))[:k]
                        found[first + int(item)] = tuple(x[order[scores[order] > 0]] for x in own)
        n = [len(v[0]) for v in found.values()]
        scores, known, ids = (np.concatenate([np.zeros(0, np.int64), *[v[i] for v in found.values()]]) for i in range(3))
        item = np.repeat(np.fromiter(found, np.int64, len(found)), n)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=known == 0), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _best(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each item, with their rank: first those of each group of tasks, then of all."""
    some = W.partitionBy("item", "salt").orderBy(*order)
    few = df.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("salt", "rank")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _answer(index: Index, asked: Asked, k: int) -> DataFrame:
    """item, rank, doc_id, score for a block of items."""
    sc, segments = index.segments.sparkSession.sparkContext, index.segments
    shared = sc.broadcast(asked)
    for r in segments.select("names", "starts").mapInArrow(_frequencies(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        asked.weights[r["term"]] = weight(index.documents, r["n"])
    shared = sc.broadcast(asked)
    lower = segments.select("names", "starts", "at", "impacts").mapInArrow(_lower(shared, k), "item int, low long")
    thresholds = np.zeros(asked.size, np.int64)
    for r in _best(lower, k, F.desc("low")).where(F.col("rank") == k).collect():
        thresholds[r["item"]] = r["low"]
    shared = sc.broadcast((asked, thresholds))
    found = segments.mapInArrow(_rescored(shared, k, index.documents, index.total), "item int, doc_id long, score long")
    return _best(found, k, F.desc("score"), F.col("doc_id").asc_nulls_last())


def search(index: Index, items: DataFrame, k: int = BEST, block: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: each item's k best documents with a score above 0, ties by rising doc_id.

    Rows of ``items`` (item_id, text) that share an id are one item with all their terms; so are those without an id. An item
    without terms, or whose terms no document has, has no row. Null doc_ids come last among equal scores, and rows that share
    a doc_id are documents of their own. Items are answered in blocks of about ``block``, a
    segment's bounds found for ``at_once`` of them at a time.
    """
    spark, out = items.sparkSession, None
    lean = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-lean.select("item_id").distinct().count() // block))
    for i in range(blocks):
        texts: dict[int | None, set[bytes]] = {}
        for r in lean.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect():
            texts.setdefault(r["item_id"], set()).update(terms(r["text"].encode()))
        ids = sorted((k for k, own in texts.items() if own), key=lambda v: (v is None, v))
        if not ids or not index.documents:
            continue
        named = spark.createDataFrame([(n, v) for n, v in enumerate(ids)], "item int, item_id long")
        answer = _answer(index, Asked.of([texts[v] for v in ids], at_once), k)
        part = answer.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        part = index.scratch.table(part, "answers") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def digest(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ranking of all ``docs`` for each item: see :func:`search`. Empty tables give an empty result; other columns are ignored."""
    return search(build(docs), items, k)


def oracle(k: int = BEST) -> str:
    """The same rows in DuckDB."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '{TERM}')"
    return f"""
WITH d AS (SELECT doc_id, {found} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, len(t) AS len FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, sum(len)::BIGINT AS total FROM l),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({found}) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s WHERE term IN (SELECT term FROM q) GROUP BY term),
x AS (SELECT item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len * docs) // total))))::BIGINT AS score
  FROM q JOIN w ON q.term = w.term JOIN f ON f.term = q.term JOIN l ON l.doc_id = f.doc_id, s GROUP BY item_id, f.doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= {k}
"""
