"""Operator 9 - approximate nearest neighbours by inner product over balanced posting lists.

Vectors are split into bands of like length (and number of components). In a band, scaled to lengths of at most one, inner
products become Euclidean distances by one more coordinate that lifts every vector to length one; a vector far longer than
the rest has a band of its own and leaves the distances of the others as they are. Balanced k-means on a bounded sample
gives a band's centroids; a vector near the boundary of clusters is in each list whose centroid is at most ``REPLICATE``
farther than its nearest, unless an earlier list shadows it: one whose centroid is nearer to that centroid than the vector.
So clusters share the vectors between them, while vectors without structure are in one list each and an index reads no more
than a scan. Workers search the centroids by best-first walks on an in-memory graph of neighbouring centroids,
with a bounded beam, both to place vectors and to find a query's lists in every band; distance-ratio pruning keeps the lists
whose centroid is at most so much farther than the nearest. The ratio is ``PRUNE`` at least; at build time it is widened
until the lists of ``PROBES`` sample queries hold the share ``RECALL`` of their exact neighbours among all rows. Queries
meet the lists' vectors by list, and inner products are computed exactly in double precision.

Lists that are long all the same (equal vectors) are dealt to parts by hash, so no task holds a whole list; a query goes
to all parts of its lists, and every part keeps its best k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.llm.common import Scratch, n_partitions
from rankloom.llm.neardup import usable

#: Vectors a list has about; most lists of all bands, and least of a band that is cut at all; sample vectors for a list; relative distances up to which a vector is replicated and a query's lists are kept; most lists of a vector; rows of a part; neighbours of a centroid; queries whose finds a task combines; entries, for each neighbour wanted, that a query's lists of a band must hold before pruning begins.
LIST, MOST_LISTS, LEAST_LISTS, PER_LIST, REPLICATE, PRUNE, COPIES, ROWS, DEGREE, COMBINED, NEED = 200, 16_384, 8, 4, 0.05, 0.06, 3, 2048, 24, 100_000, 25
#: Sample queries whose exact neighbours set the pruning ratio; the recall that it must give them; centroids that a walk keeps, beyond which it measures all; steps of a walk at least; how much farther than what it keeps a walk looks.
PROBES, RECALL, BEAM, STEPS, SLACK = 256, 0.95, 64, 24, 0.04
#: Lengths of a band differ by a factor of 2 to this power; most bands of a number of components; numbers of components that have bands and lists (others are one list each, searched whole); entries of a matrix of distances.
OCTAVES, MOST_BANDS, DIMS, MATRIX = 3, 8, 8, 1 << 22
def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 9) -> np.ndarray:
    """k-means whose small clusters give way: their centroids move next to those of clusters over twice the mean size."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    c = x[: min(k, len(x))].copy()
    size = max(1, MATRIX // len(c))
    for r in range(rounds):
        near = np.concatenate([_distances(x[a : a + size], c).argmin(axis=1) for a in range(0, len(x), size)])
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[n > 0])])[:-1], axis=0)
        c[n > 0] = sums / n[n > 0][:, None]
        big, small = np.flatnonzero(n > 2 * len(x) / len(c)), np.flatnonzero(n < 0.5 * len(x) / len(c))
        if r < rounds - 2:
            for a, b in zip(big[np.argsort(-n[big])], small[np.argsort(n[small])], strict=False):
                c[b] = x[order[np.searchsorted(near[order], a) + rng.integers(n[a])]]
    return np.unique(c, axis=0)


@dataclass
class Graph:
    """Centroids, their neighbours, and where walks begin."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(c: np.ndarray, degree: int = DEGREE, seed: int = 9) -> Graph:
        """Each centroid's nearest, and a few random ones that keep the graph in one piece; its own number fills up."""
        rng, near, size = np.random.default_rng(seed), min(degree, len(c) - 1), max(1, MATRIX // len(c))
        best = np.zeros((len(c), 0), np.int64)
        if near > 0:
            best = np.concatenate([np.argpartition(_distances(c[a : a + size], c), near, axis=1)[:, : near + 1] for a in range(0, len(c), size)])
        to = np.sort(np.concatenate([best, rng.integers(0, len(c), (len(c), 4))], axis=1), axis=1)
        again = np.concatenate([np.zeros((len(c), 1), bool), to[:, 1:] == to[:, :-1]], axis=1)
        return Graph(c, np.where(again, np.arange(len(c))[:, None], to), rng.choice(len(c), min(len(c), 8), replace=False))

    def nearest(self, x: np.ndarray, ratio: float, most: int | None = None, sizes: np.ndarray | None = None, need: int = 0, least: int = STEPS, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs of the lists of each row of ``x`` with distances up to (1 + ratio) times the nearest's.

        Best-first walks of all rows in step: each expands the nearest centroid that it knows and has not expanded, and
        ends where that is farther than the ratio and some slack allow, after ``least`` steps. A walk keeps the nearest
        ``beam`` centroids; where all of them are near enough to be kept, the row is compared with every centroid instead.
        With the lists' ``sizes``, the ratio counts from the list with which ``need`` vectors are reached instead of the
        nearest, so that a query beside a small tight cluster looks beyond it. Pairs come by row, nearest first, ``most``
        a row.
        """
        c, n = self.centroids, len(x)
        beam = min(beam, len(c))
        square = (c * c).sum(axis=1)
        own = (x * x).sum(axis=1)
        number, far, done = np.full((n, beam), -1), np.full((n, beam), np.inf), np.zeros((n, beam), bool)

        def meet(rows: np.ndarray, near: np.ndarray) -> None:
            """The walks of ``rows`` get to know the centroids ``near``, a row of them each."""
            d = square[near] - 2 * np.matmul(c[near], x[rows][:, :, None])[:, :, 0] + own[rows][:, None]
            d = np.sqrt(np.maximum(d, 0))
            d[(near[:, :, None] == number[rows][:, None, :]).any(axis=2)] = np.inf
            ids, ds, gone = np.concatenate([number[rows], near], axis=1), np.concatenate([far[rows], d], axis=1), np.concatenate([done[rows], np.zeros(near.shape, bool)], axis=1)
            order = np.argsort(ds, axis=1, kind="stable")[:, :beam]
            number[rows], far[rows], done[rows] = (np.take_along_axis(v, order, 1) for v in (ids, ds, gone))

        def base(d: np.ndarray, lists: np.ndarray) -> np.ndarray:
            """The distance that the ratio counts from, by sorted distances; infinite where ``need`` isn't reached."""
            if sizes is None:
                return d[:, 0]
            reach = (np.cumsum(np.where(np.isfinite(d), sizes[lists], 0), axis=1) < need).sum(axis=1)
            return np.where(reach < d.shape[1], np.take_along_axis(d, np.minimum(reach, d.shape[1] - 1)[:, None], 1)[:, 0], np.inf)

        meet(np.arange(n), np.tile(self.entries, (n, 1)))
        full = np.zeros(n, bool)
        for first, low_of in ((least, lambda: far[:, 0]), (0, lambda: base(far, number))):
            rows, step = np.arange(n), 0
            while len(rows := rows[~full[rows]]):
                ahead = ~done[rows] & np.isfinite(far[rows])
                at = ahead.argmax(axis=1)
                limit = low_of()[rows] * (1 + ratio + SLACK)
                go = ahead.any(axis=1) & ((step < first) | (far[rows, at] <= limit))
                full[rows] |= (beam < len(c)) & (far[rows, -1] <= np.where(np.isfinite(limit), limit, np.finfo(float).max))
                go &= ~full[rows]
                rows, at, step = rows[go], at[go], step + 1
                if len(rows):
                    done[rows, at] = True
                    meet(rows, self.neighbours[number[rows, at]])
        i, lists, d = [], [], []
        some = np.flatnonzero(~full)
        if len(some):
            a, b = np.nonzero(np.isfinite(far[some]) & (far[some] <= base(far[some], number[some])[:, None] * (1 + ratio)))
            i, lists, d = [some[a]], [number[some][a, b]], [far[some][a, b]]
        rest, size = np.flatnonzero(full), max(1, MATRIX // len(c))
        for start in range(0, len(rest), size):
            rows = rest[start : start + size]
            all_ = np.sqrt(_distances(x[rows], c))
            if sizes is None:
                low = all_.min(axis=1)
            else:
                order = np.argsort(all_, axis=1)
                low = base(np.take_along_axis(all_, order, 1), order)
            a, b = np.nonzero(all_ <= low[:, None] * (1 + ratio))
            i, lists, d = [*i, rows[a]], [*lists, b], [*d, all_[a, b]]
        i, lists, d = (np.concatenate([np.zeros(0, t), *v]) for v, t in ((i, np.int64), (lists, np.int64), (d, np.float64)))
        order = np.lexsort((lists, d, i))
        i, lists = i[order], lists[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < (most or len(c))
        return i[keep], lists[keep]


@dataclass
class Band:
    """Vectors of ``dim`` components and lengths from 2 ** low up to 2 ** (high + 1), the longest of 2 ** longest, in lists from ``first`` on."""

    dim: int
    low: int
    high: int
    n: int
    longest: float = 0.0
    first: int = 0
    graph: Graph | None = None

    @property
    def lists(self) -> int:
        return len(self.graph.centroids) if self.graph else 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors scaled to lengths of one at most, with the coordinate that makes all lengths one."""
        whole = math.floor(self.longest)
        x = np.ldexp(x, -whole) * 2.0 ** (whole - self.longest)
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Queries scaled to length one, with nothing in the coordinate that is added; no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def bands_of(counts: list[tuple[int, int, int, float]]) -> list[Band]:
    """Bands from (dim, exponent, vectors, binary logarithm of the longest), most frequent dims first; the dims after the first few have a band each."""
    dims: dict[int, list[tuple[int, int, float]]] = {}
    for dim, *rest in counts:
        dims.setdefault(dim, []).append(tuple(rest))
    out = []
    for k, dim in enumerate(sorted(dims, key=lambda d: (-sum(n for _, n, _ in dims[d]), d))):
        own: list[Band] = []
        for e, n, longest in sorted(dims[dim], reverse=True):
            if own and (own[-1].high - e < OCTAVES or k >= DIMS):
                own[-1].low, own[-1].n = e, own[-1].n + n
            else:
                own.append(Band(dim, e, e, n, longest))
        while len(own) > MOST_BANDS:
            i = min(range(len(own) - 1), key=lambda i: own[i].n + own[i + 1].n)
            own[i : i + 2] = [Band(dim, own[i + 1].low, own[i].high, own[i].n + own[i + 1].n, own[i].longest)]
        out += own
    return out


def unshadowed(x: np.ndarray, centroids: np.ndarray, rows: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs, given by row and nearest first, without lists whose centroid is nearer to that of an earlier list of
    the row than to the row's vector: queries near such a centroid look into the earlier list as well."""
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place == 0
    far = ((x[rows] - centroids[lists]) ** 2).sum(axis=1)
    for k in range(1, int(place.max(initial=0)) + 1):
        at = np.flatnonzero(place == k)
        good = np.ones(len(at), bool)
        for earlier in range(1, k + 1):
            apart = ((centroids[lists[at]] - centroids[lists[at - earlier]]) ** 2).sum(axis=1)
            good &= ~keep[at - earlier] | (apart >= far[at])
        keep[at] = good
    return rows[keep], lists[keep]


@dataclass
class Index:
    """Bands with their centroids; lists are numbered through all bands, those of the most frequent dim first."""

    bands: list[Band]

    def of(self, dim: int) -> list[Band]:
        return [b for b in self.bands if b.dim == dim]

    def places(self, dim: int, exponents: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs of the lists that vectors of ``dim`` components go to."""
        rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for band in self.of(dim):
            at = np.flatnonzero((exponents >= band.low) & (exponents <= band.high))
            if len(at):
                i, j = np.arange(len(at)), np.zeros(len(at), np.int64)
                if band.graph:
                    lifted = band.lift(x[at])
                    i, j = unshadowed(lifted, band.graph.centroids, *band.graph.nearest(lifted, REPLICATE, COPIES))
                rows, lists = [*rows, at[i]], [*lists, j + band.first]
        return np.concatenate(rows), np.concatenate(lists)

    def wanted(self, x: np.ndarray, prune: float, sizes: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs of the lists that queries look into, in every band of their number of components."""
        rows, lists, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], unit(x)
        for band in self.of(x.shape[1]):
            i, j = band.graph.nearest(q, prune, None, sizes[band.first : band.first + band.lists], need) if band.graph else (np.arange(len(x)), np.zeros(len(x), np.int64))
            rows, lists = [*rows, i], [*lists, j + band.first]
        return np.concatenate(rows), np.concatenate(lists)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, x, asks) -> id, data, dim, log (binary, of the length), exponent (its floor), asks."""
    for b in batches:
        data, dims, logs = [], [], []
        for v in b.column("x"):
            x = np.asarray(v.as_py(), np.float64)
            top = np.abs(x).max()
            y = x / top
            data.append(x.astype("<f8").tobytes())
            dims.append(len(x))
            logs.append(float(np.log2(top) + 0.5 * np.log2(y @ y)))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(data, pa.binary()), pa.array(dims, pa.int32()), pa.array(logs, pa.float64()), pa.array([math.floor(v) for v in logs], pa.int32()), b.column("asks")], names=["id", "data", "dim", "log", "exponent", "asks"])


def matrix(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products; one that overflows both ways, and so has no value, counts as the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
    return np.where(np.isnan(s), -np.inf, s)


def _place(shared, lists_of):
    """(id, data, dim, exponent) -> a row for each list that ``lists_of`` (index, dim, exponents, vectors) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for at in range(0, len(own), 512):
                    part = b.take(pa.array(own[at : at + 512]))
                    rows, lists = lists_of(index, int(dim), part.column("exponent").to_numpy(), matrix(part.column("data").to_pylist()))
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("id").take(take), pa.array(lists.astype(np.int32)), part.column("data").take(take)], names=["id", "list", "data"])

    return run


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        low = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= low)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _exact(shared, k: int):
    """Postings -> for each sample query the k nearest ids of each stretch, with the lists that hold the nearest row of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, q = shared.value
        low = np.full(len(asks), -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                part = b.slice(at, 8192)
                ids, lists = part.column("id").to_numpy(), part.column("list").to_numpy()
                if not len(ids):
                    continue
                order = np.argsort(ids, kind="stable")
                ids, lists, scores = ids[order], lists[order], products(q, matrix(part.column("data").to_pylist())[order])
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                length = np.diff(np.append(first, len(ids)))
                top = np.maximum.reduceat(scores, first, axis=1)
                top[asks[:, None] == ids[first]] = -np.inf
                n = min(k, len(first))
                g = np.argpartition(-top, n - 1, axis=1)[:, :n]
                s = np.take_along_axis(top, g, 1)
                i, j = np.nonzero(np.isfinite(s) & (s >= low[:, None]))
                if n == k:
                    np.maximum(low, s.min(axis=1), out=low)
                g, s = g[i, j], s[i, j]
                pair = np.repeat(np.arange(len(g)), length[g])
                row = first[g][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(length[g]) - length[g], length[g])
                near = scores[i[pair], row] >= s[pair] - 1e-9 * (1 + np.abs(s[pair]))
                ends = np.append(0, np.cumsum(np.bincount(pair[near], minlength=len(g))))
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lists[row[near]], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(asks[i]), pa.array(ids[first][g]), pa.array(s), held], names=["query_id", "vec_id", "score", "lists"])

    return run


def calibrated(posted: DataFrame, asked: DataFrame, index: Index, sizes: np.ndarray, k: int, prune: float, seed: int = 9) -> float:
    """The pruning ratio, ``prune`` at least, with which sample queries reach ``RECALL`` of their exact k nearest among all postings.

    The sample is of the most frequent number of components; the ratio holds for all.
    """
    spark, main = posted.sparkSession, index.of(index.bands[0].dim)
    probes = asked.where(F.col("dim") == main[0].dim).orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(PROBES).select("id", "data").collect()
    if not probes or not any(b.graph for b in main):
        return prune
    asks, q = np.array([r["id"] for r in probes]), matrix([bytes(r["data"]) for r in probes])
    shared = spark.sparkContext.broadcast((asks, q))
    own = posted.where(F.col("list") < sum(b.lists for b in main))
    near = own.mapInArrow(_exact(shared, k), "query_id long, vec_id long, score double, lists array<int>").groupBy("query_id", "vec_id").agg(F.max_by("lists", "score").alias("lists"), F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    truth: dict[int, list[list[int]]] = {}
    for r in near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "lists").collect():
        truth.setdefault(r["query_id"], []).append(r["lists"])
    total = sum(map(len, truth.values()))
    if not total:
        return prune

    def recall(ratio: float) -> float:
        hits = 0
        for at in range(0, len(q), 64):
            rows, lists = index.wanted(q[at : at + 64], ratio, sizes, NEED * k)
            for i, ask in enumerate(asks[at : at + 64].tolist()):
                own = set(lists[rows == i].tolist())
                hits += sum(not own.isdisjoint(held) for held in truth.get(ask, []))
        return hits / total

    while recall(prune) < RECALL:
        prune = prune * 1.03 + 0.002
    return prune


def _search(k: int):
    """Rows sorted by (list, part, side): vectors (side 0) come before the queries (side 1) that want them.

    A task combines a query's finds from all its lists, so it gives k rows a query, not k a list; beyond ``COMBINED``
    queries it gives what it has and begins anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def frame() -> pa.RecordBatch:
            n = [len(v) for v, _ in found.values()]
            q = np.repeat(np.fromiter(found, np.int64, len(found)), n)
            v, s = (np.concatenate([np.zeros(0), *[f[i] for f in found.values()]]) for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v.astype(np.int64)), pa.array(s.astype(np.float64))], names=["query_id", "vec_id", "score"])

        def answer(ids: np.ndarray, first: np.ndarray, x: np.ndarray, asked: list[tuple[int, bytes]]) -> None:
            """``ids``: the distinct ids of the rows ``x``, which are sorted by id; ``first``: where each id's rows begin."""
            scores = products(matrix([d for _, d in asked]), x)
            if len(ids) < len(x):
                scores = np.maximum.reduceat(scores, first, axis=1)
            for (i, _), s in zip(asked, scores, strict=True):
                own = ids
                old = found.get(i)
                if old is not None and len(old[0]) == k:
                    some = np.flatnonzero(s >= old[1][-1])
                    own, s = ids[some], s[some]
                s, own = s[own != i], own[own != i]
                if old is not None:
                    own, s = np.concatenate([old[0], own]), np.concatenate([old[1], s])
                at = best(own, s, 2 * k)  # an id is in it twice at most: as found before and as found here
                own, s = own[at], s[at]
                _, first = np.unique(own, return_index=True)
                first.sort()
                found[i] = own[first][:k], s[first][:k]

        key, vectors, ids, first, x, asked = None, [], None, None, None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("list", "part", "side", "id", "data")]
            for lst, part, side, i, data in zip(*cols, strict=True):
                if (lst, part) != key:
                    if asked:
                        answer(ids, first, x, asked)
                    key, vectors, ids, asked = (lst, part), [], None, []
                    if len(found) > COMBINED:
                        yield frame()
                        found.clear()
                if side == 0:
                    vectors.append((i, data))
                    continue
                if ids is None:
                    if not vectors:
                        continue
                    vectors.sort(key=lambda v: v[0])
                    ids = np.array([v for v, _ in vectors])
                    x = matrix([d for _, d in vectors])
                    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    ids = ids[first]
                    vectors = []
                asked.append((i, data))
                if len(asked) >= 512:
                    answer(ids, first, x, asked)
                    asked = []
        if asked:
            answer(ids, first, x, asked)
        yield frame()

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20, per_list: int = LIST, prune: float = PRUNE, rows: int = ROWS, seed: int = 9) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the k nearest found of each query, by inner product, ties to smaller ids.

    ``queries`` says which rows of ``vectors`` (vec_id, embedding) ask; every usable row is indexed. Null ids, null or
    zero vectors, and vectors with null or non-finite components take no part. Vectors of different numbers of components
    have no product, so a query finds those of its own. Rows with the same id count once, with their best score; an id that
    asks with several vectors asks with the least of them; a query is never its own neighbour. Products that overflow are
    infinite. Fewer than k candidates give fewer rows; an empty table gives an empty result; other columns are ignored.
    ``prune`` is the least pruning ratio.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    good = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("x")))
    lengths = good.mapInArrow(_lengths, "id long, data binary, dim int, log double, exponent int, asks boolean")
    # Rows that repeat id and vector count once, also in the sample and in the number of lists.
    good = scratch.table(lengths.groupBy("id", "data", "dim", "log", "exponent").agg(F.max("asks").alias("asks")), "vectors")
    bands = bands_of([tuple(r) for r in good.groupBy("dim", "exponent").agg(F.count("*"), F.max("log")).collect()])
    if not bands:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, wide = sum(b.n for b in bands), {b.dim: None for b in bands}
    wide = set(list(wide)[:DIMS])
    goal = lambda b: min(max(LEAST_LISTS, b.n // per_list), max(1, b.n // PER_LIST), max(LEAST_LISTS, MOST_LISTS * b.n // n)) if b.dim in wide else 1
    in_band = lambda b: (F.col("dim") == b.dim) & F.col("exponent").between(b.low, b.high)
    share = F.coalesce(*[F.when(in_band(b), F.lit(min(1.0, 1.1 * PER_LIST * goal(b) / b.n))) for b in bands if goal(b) > 1], F.lit(0.0))
    pick = F.pmod(F.xxhash64(F.lit(seed), "id", "data"), F.lit(1_000_003)) / 1_000_003.0
    sample = sorted((tuple(r) for r in good.where(pick < share).select("dim", "exponent", "id", "data").collect()), key=lambda r: (r[2], bytes(r[3])))
    first = 0
    for b in bands:
        points = [bytes(r[3]) for r in sample if r[0] == b.dim and b.low <= r[1] <= b.high]
        b.first = first
        if goal(b) > 1 and points:
            b.graph = Graph.build(balanced_centroids(b.lift(matrix(points)), min(goal(b), max(1, len(points) // PER_LIST)), seed=seed))
        first += b.lists
    index = Index(bands)
    shared = spark.sparkContext.broadcast(index)
    placed, at = "id long, list int, data binary", "list int, parts int"
    posted = scratch.table(good.mapInArrow(_place(shared, lambda index, dim, exponents, x: index.places(dim, exponents, x)), placed), "postings")
    # One row a list, of which there are MOST_LISTS at most, and one for each rare number of components.
    held = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
    sizes = np.array([held.get(i, 0) for i in range(first)])
    parts = spark.createDataFrame([(i, -(-c // rows)) for i, c in held.items()], at)
    asked = scratch.table(good.where("asks").groupBy("id").agg(F.min(F.struct("data", "dim", "exponent")).alias("v")).select("id", "v.*"), "asked")
    prune = calibrated(posted, asked, index, sizes, k, prune, seed)
    asked = asked.mapInArrow(_place(shared, lambda index, dim, exponents, x: index.wanted(x, prune, sizes, NEED * k)), placed)
    posted = posted.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id", "data"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "data")
    asked = asked.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "data")
    met = posted.unionByName(asked).repartition(n_partitions(spark), "list", "part").sortWithinPartitions("list", "part", "side")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
