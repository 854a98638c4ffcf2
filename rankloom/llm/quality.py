"""Operator 13 - quality rules on repetition inside a text, by suffix arrays over words.

Prefix doubling sorts the suffixes of many texts at once, each text's apart; only suffixes that still share their place with
another are sorted again. The ranks of every doubling give neighbours' longest common prefixes. Their intervals are the
repeated substrings that can't be longer to the right; those whose occurrences follow different words are maximal. The union
of the occurrences' spans is what a text repeats. A text fails whose repeats cover too large a share of its characters, or
whose longest repeat is too long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import map_rows, short_batches, tidy

#: Words of a repeat at least; the base rule's words of a text at least, and percentage of words in repeats at most; the percentage of a text's characters in repeats, and the words of its longest repeat, that are still kept; words that are sorted at once.
LEAST, FEWEST, REPEATED, COVERED, LONGEST, AT_ONCE = 5, 10, 20, 20, 50, 1 << 18
SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"


# -- suffix arrays ------------------------------------------------------------------------------------------------


def _shared(head: np.ndarray) -> np.ndarray:
    """Which places of a sorted list are in a group of several; ``head``: the first places of groups."""
    return ~head | ~np.append(head[1:], True)


def suffixes(word: np.ndarray, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of texts laid end to end, and the suffixes' ranks by their first 1, 2, 4, .. words.

    ``word``, ``text``: numbers of each place's word and text; ``stop``: where its text ends. Suffixes are sorted by text
    first, and one that ends is smaller than one that goes on. Suffixes of equal beginnings share a rank, the place of the
    first of them; by the last ranks all differ.
    """
    key = text * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    head = np.append(True, sorted_[1:] != sorted_[:-1])[: len(key)]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
    levels, left, width = [rank.copy()], np.flatnonzero(_shared(head)), 1
    while len(left):
        i = order[left]
        after = np.where(i + width < stop[i], rank[np.minimum(i + width, len(key) - 1)], -1)
        i, after = (x[again] for again in [np.lexsort((after, rank[i]))] for x in (i, after))
        own = rank[i]
        head = np.append(True, (own[1:] != own[:-1]) | (after[1:] != after[:-1]))
        order[left] = i
        rank[i] = left[np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))]
        levels.append(rank.copy())
        left, width = left[_shared(head)], 2 * width
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], stop: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(place, words): the places of the suffix array whose suffix begins with the same ``least`` words or more as the one before."""
    top = len(levels) - 1
    first = levels[min(least.bit_length() - 1, top)]
    place = np.flatnonzero(first[order[:-1]] == first[order[1:]]) + 1
    x, y = order[place - 1], order[place]
    n = np.zeros(len(place), np.int64)
    for level in range(top - 1, -1, -1):
        inside = (x + n < stop[x]) & (y + n < stop[y])
        a, b = (np.where(inside, v + n, 0) for v in (x, y))
        n += (inside & (levels[level][a] == levels[level][b])).astype(np.int64) << level
    return place[n >= least], n[n >= least]


def intervals(place: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, words): the intervals of the suffix array whose suffixes have so many words in common, and not more."""
    stack: list[tuple[int, int]] = []
    before = -2
    for p, n in [*zip(place.tolist(), words.tolist(), strict=True), (-1, 0)]:
        if p != before + 1:
            while stack:
                own, first = stack.pop()
                yield first, before, own
        first = p - 1
        while stack and stack[-1][0] > n:
            own, first = stack.pop()
            yield first, p - 1, own
        if not stack or stack[-1][0] < n:
            stack.append((n, first))
        before = p


@dataclass
class Repeats:
    """Repeats of texts laid end to end: the suffix array, (first, last, words) of each maximal repeat's interval, and how many words from each place on are repeated."""

    order: np.ndarray
    maximal: list[tuple[int, int, int]]
    reach: np.ndarray

    @property
    def covered(self) -> np.ndarray:
        """Which places are in the span of a repeat."""
        n = len(self.reach)
        ends = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(self.reach)
        ends[at] += 1
        np.subtract.at(ends, at + self.reach[at], 1)
        return np.cumsum(ends)[:n] > 0

    @staticmethod
    def of(word: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int = LEAST) -> Repeats:
        order, levels = suffixes(word, text, stop)
        place, words = common_prefixes(order, levels, stop, least)
        # A suffix's innermost interval is its longest. Where it isn't maximal, all its occurrences follow the same word, and the span of the suffix before it covers its own.
        reach = np.zeros(len(word), np.int64)
        np.maximum.at(reach, order[place - 1], words)
        np.maximum.at(reach, order[place], words)
        # An interval is maximal if two neighbours in it follow different words, or one begins its text.
        x, y = order[place - 1], order[place]
        differ = np.zeros(len(order) + 1, np.int64)
        differ[place] = (x == start[x]) | (y == start[y]) | (word[x - 1] != word[y - 1])
        differ = np.cumsum(differ)
        return Repeats(order, [(a, z, n) for a, z, n in intervals(place, words) if differ[z] > differ[a]], reach)


# -- measures -----------------------------------------------------------------------------------------------------


@dataclass
class Measures:
    """What the rules look at in a text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int = 0
    repeat_chars: int = 0
    longest_repeat: int = 0
    n_repeats: int = 0

    @property
    def base_failed(self) -> bool:
        return self.n_words < FEWEST or 100 * self.n_repeat_words > REPEATED * self.n_words

    @property
    def kept(self) -> bool:
        return not self.base_failed and 100 * self.repeat_chars <= COVERED * self.word_chars and self.longest_repeat <= LONGEST


def plain(text: bytes) -> tuple[Measures, list[bytes]]:
    """What needs no suffix array, and the words. ``bytes.split`` splits at exactly the white space of the contract."""
    words = text.split()
    lines = Counter(text.split(b"\n"))
    gaps = len(text) - len(text.translate(None, SPACE))
    return Measures(len(words), len(text.decode()) - gaps, len(text) - len(text.translate(None, SYMBOLS)), sum(n - 1 for line, n in lines.items() if n > 1 and line.split())), words


def _laid(found: list[list[bytes]], least: int) -> tuple[Repeats, np.ndarray]:
    """The repeats of texts given as words, and the number of each place's text."""
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for words in found for w in words), np.int64, sum(map(len, found)))
    sizes = np.array([len(words) for words in found], np.int64)
    text = np.repeat(np.arange(len(found)), sizes)
    stop = np.cumsum(sizes)
    return Repeats.of(word, text, (stop - sizes)[text], stop[text], least), text


def measured(texts: list[bytes]) -> list[Measures]:
    """Measures of texts, sorted together in stretches of about ``AT_ONCE`` words; a longer text is a stretch of its own."""
    out: list[Measures] = []
    held: list[list[bytes]] = []

    def close() -> None:
        own, (r, text) = out[len(out) - len(held) :], _laid(held, LEAST)
        if len(places := np.flatnonzero(r.covered)):
            first = np.cumsum([0, *map(len, held)])
            for i, n in enumerate(np.bincount(text[places], minlength=len(held)).tolist()):
                own[i].n_repeat_words = n
            longest = np.zeros(len(held), np.int64)
            np.maximum.at(longest, text, r.reach)
            for i in np.flatnonzero(longest).tolist():
                own[i].longest_repeat = int(longest[i])
            for p, i in zip(places.tolist(), text[places].tolist(), strict=True):
                own[i].repeat_chars += len(held[i][p - first[i]].decode())
            for a, _, _ in r.maximal:
                own[text[r.order[a]]].n_repeats += 1
        held.clear()

    n = 0
    for t in texts:
        m, words = plain(t)
        out.append(m)
        held.append(words)
        n += len(words)
        if n >= AT_ONCE:
            close()
            n = 0
    if held:
        close()
    return out


# -- operators ----------------------------------------------------------------------------------------------------

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat", "n_repeats", "base_failed", "kept"]


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = measured(_texts(b.column("text")))
        cells = [pa.array([getattr(m, f) for m in found], pa.bool_() if f in ("base_failed", "kept") else pa.int64()) for f in FIELDS]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cells], names=["doc_id", *FIELDS])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, measures, base_failed and kept of every row of ``docs`` (doc_id, text).

    A null text has no words, and so fails; null ids and repeated rows are rows like any other; an empty table gives an empty
    result; other columns are ignored. Texts of any length are measured whole, each by one task. n_repeats counts the maximal
    repeats of ``LEAST`` words or more, repeat_chars the characters of the words that they cover.
    """
    short_batches(docs.sparkSession)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(tidy(_digest), "doc_id long, " + ", ".join(f"{f} {'boolean' if f in ('base_failed', 'kept') else 'long'}" for f in FIELDS))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns, whatever their names."""
    short_batches(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([m.kept for m in measured(_texts(b.column(at)))], pa.bool_()))

    return map_rows(docs, run, T.StructType(docs.schema.fields))


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, first_word (from 0), n_words, occurrences, text: a row for each maximal repeat inside a text of ``docs``."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), _texts(b.column("text")), strict=True):
                words = t.split()
                r, _ = _laid([words], least)
                rows = [(i, first := int(r.order[a : z + 1].min()), n, z - a + 1, b" ".join(words[first : first + n]).decode()) for a, z, n in r.maximal]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "first_word", "n_words", "occurrences", "text"])

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, first_word long, n_words long, occurrences long, text string")


def oracle() -> str:
    """The same rows in DuckDB, by windows of words: a repeat of n words or more is a window of n that occurs twice."""
    word = r"[^\x20\x09-\x0D]"
    twice = lambda n: f"""SELECT doc_id, unnest(places) AS place FROM (SELECT doc_id, list(i) AS places FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)) GROUP BY doc_id, gram HAVING count(*) > 1)"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
l AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY ALL) GROUP BY doc_id),
g AS ({twice(LEAST)}),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(place, place + {LEAST})) AS p FROM g)),
r AS (SELECT d.doc_id, count(*) AS n, sum(length(d.w[c.p]))::BIGINT AS chars FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY d.doc_id),
b AS (SELECT DISTINCT doc_id FROM ({twice(LONGEST + 1)})),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(r.chars, 0) AS repeat_chars, b.doc_id IS NOT NULL AS long_
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id),
f AS (SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, base_failed, NOT base_failed AND 100 * repeat_chars <= {COVERED} * word_chars AND NOT long_ AS kept FROM f
"""
