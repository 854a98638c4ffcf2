"""Operator 1 - embedding near-duplicates.

Random hyperplanes give each vector a signature of ``WIDTH`` signs; each of several tables takes a random subset of the
signs as its code, and vectors with equal codes in a table meet. The bits of a code follow the number of vectors, so that
buckets stay small; the number of tables follows the bits, so that a pair at the threshold is missed with a probability
below ``MISS``. Equal vectors are one class with a size, and only classes are compared.

Buckets hold ids and signatures, not vectors. Where two signatures of a bucket differ in so few signs that the vectors may
link, and agree in no earlier table's code, their rows are marked; only marked rows fetch their vectors, and meet again in
the same bucket for the exact cosine in double precision. The mark wrongly leaves out a pair at the threshold with a
probability that is part of ``MISS``.

A bucket is compared block by block: rows of a crowded bucket are dealt to blocks by hash, and each pair of blocks is a
group of its own, so no task holds a whole bucket and no pairs leave a task: a block pair gives, per vector, the number
of new links and the smallest vector that its links connect it to there. Links are counted in the first table where two
codes agree. The connections go through distributed connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, n_partitions
from rankloom.llm.components import _forest, connected_components

THRESHOLD, MISS, SEED = 0.95, 1e-5, 1
#: Signs of a signature; vectors in a bucket that random data would have; rows of a block; crowded buckets whose list is broadcast (a longer list is joined by shuffling); rows of a group that are compared in step with other groups; pairs compared at once.
WIDTH, EXPECTED, ROWS, LISTED, SMALL, PAIRS = 512, 32, 1024, 100_000, 48, 1 << 17


def usable(embedding: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(embedding, fine) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _binomial(n: int, p: float) -> np.ndarray:
    """Probabilities of 0 to n of n."""
    k = np.arange(n + 1)
    choose = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in k])
    return np.exp(choose + k * math.log(p) + (n - k) * math.log(1 - p))


@cache
def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS, width: int = WIDTH) -> tuple[int, int, int]:
    """(bits, tables, most signs that may differ) for n vectors.

    Of a pair at the threshold, d of the signature's signs differ, binomially distributed; a table's random subset then
    holds none of them with the share of subsets that miss all d.
    """
    bits = min(30, max(6, round(math.log2(max(n, 1) / EXPECTED + 1))))
    share = _binomial(width, math.acos(threshold) / math.pi)
    most = int(np.searchsorted(np.cumsum(share), 1 - miss / 10))
    agree = np.array([math.prod((width - d - i) / (width - i) for i in range(bits)) if d <= width - bits else 0.0 for d in range(width + 1)])
    tables = 1
    while (share * (1 - agree) ** tables).sum() > 0.9 * miss:
        tables += 1
    return bits, tables, most


def subsets(bits: int, tables: int, seed: int, width: int = WIDTH) -> np.ndarray:
    """The signs of each table's code."""
    rng = np.random.default_rng([seed, bits, width])
    return np.array([rng.choice(width, bits, replace=False) for _ in range(tables)])


def masks(subset: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Each table's signs as bits of a signature's 64-bit words."""
    out = np.zeros((len(subset), width), np.uint8)
    np.put_along_axis(out, subset, 1, axis=1)
    return np.packbits(out, axis=1).view(np.uint64)


def _codes(subset: np.ndarray, seed: int, width: int = WIDTH):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(subset.shape[1], dtype=np.int64)
        for b in batches:
            values = [np.asarray(v.as_py(), np.float64) for v in b.column("embedding")]
            signs = np.zeros((len(values), width), np.uint8)
            size = np.array([len(v) for v in values])
            for dim in np.unique(size):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).normal(size=(dim, width))
                own = np.flatnonzero(size == dim)
                x = np.array([values[i] for i in own])
                signs[own] = x / np.abs(x).max(axis=1, keepdims=True) @ planes[dim] > 0
            codes = (signs[:, subset] @ weights).astype(np.int32)
            ends = np.arange(len(values) + 1, dtype=np.int32) * len(subset)
            signature = pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())
            data = pa.array([v.astype("<f8").tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("size"), b.column("dim"), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel())), signature, data], names=["rep", "size", "dim", "codes", "signature", "data"])

    return run


def _unit(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by their largest component (so that squares neither overflow nor vanish), and their lengths."""
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


GROUP = ["t", "dim", "code", "i", "j"]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, from rows that come sorted by group, with the places where each group begins and the last ends."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
        keys = [t.column(c).to_numpy() for c in GROUP]
        at = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        yield t.slice(0, int(at[-1])), at
        rest = t.slice(int(at[-1]))
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def new_at(x: np.ndarray, mask: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which pairs, by the signs ``x`` they differ in, agree in no table before ``t``."""
    alive = np.arange(len(x))
    for s in range(int(t.max(initial=0))):
        alive = alive[((x[alive] & mask[s]) != 0).any(axis=1) | (t[alive] <= s)]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def _marked(subset: np.ndarray, most: int):
    """Rows of groups -> the rows that have a pair there to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = masks(subset)
        for table, at in _grouped(batches):
            n = table.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64).reshape(n, -1)
            t, side = table.column("t").to_numpy(), table.column("side").to_numpy()
            across = table.column("i").to_numpy() != table.column("j").to_numpy()
            marked, length = np.zeros(n, bool), np.diff(at)
            group = np.repeat(np.arange(len(length)), length)

            def pairs(u: np.ndarray, v: np.ndarray) -> None:
                fits = ~(marked[u] & marked[v]) & (~across[u] | (side[u] != side[v]))
                u, v = u[fits], v[fits]
                d = x[u] ^ x[v]
                near = np.flatnonzero(np.bitwise_count(d).sum(axis=1) <= most)
                near = near[new_at(d[near], mask, t[u[near]])]
                marked[u[near]] = marked[v[near]] = True

            small = np.flatnonzero(length[group] <= SMALL)
            for d in range(1, SMALL):
                u = small[small + d < n]
                u = u[group[u] == group[u + d]]
                if not len(u):
                    break
                for a in range(0, len(u), PAIRS):
                    pairs(u[a : a + PAIRS], u[a : a + PAIRS] + d)
            for g in np.flatnonzero(length > SMALL):
                start, end = int(at[g]), int(at[g + 1])
                step = max(1, PAIRS // (end - start))
                for a in range(start, end, step):
                    u, v = np.meshgrid(np.arange(a, min(a + step, end)), np.arange(a, end), indexing="ij")
                    later = v > u
                    pairs(u[later], v[later])
            yield from table.drop_columns(["signature"]).filter(pa.array(marked)).to_batches()

    return run


def _compare(threshold: float, subset: np.ndarray):
    """Marked rows with their vectors, by group -> rep, number of new links, smallest vector that they connect it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = masks(subset)
        for table, at in _grouped(batches):
            cols = {c: table.column(c).to_numpy() for c in ("t", "i", "j", "side", "rep", "size")}
            data, signature = table.column("data").to_pylist(), table.column("signature").to_pylist()
            found = [[np.zeros(0, np.int64)] * 3]
            for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if end - start < 2 or start >= table.num_rows:
                    continue
                # The order of rows decides nothing; by side, the two blocks lie apart.
                order = start + np.argsort(cols["side"][start:end], kind="stable")
                same, split = cols["i"][start] == cols["j"][start], int((cols["side"][start:end] == 0).sum())
                if not same and split in (0, end - start):
                    continue
                rep, size = cols["rep"][order], cols["size"][order]
                x, length = _unit([data[k] for k in order])
                signs = np.frombuffer(b"".join([signature[k] for k in order]), np.uint64).reshape(len(order), -1)
                a, b = (slice(0, len(order)),) * 2 if same else (slice(0, split), slice(split, len(order)))
                close = (x[a] @ x[b].T) / (length[a][:, None] * length[b][None, :]) >= threshold
                u, v = np.nonzero(np.triu(close, 1) if same else close)
                v = v + b.start
                new = np.concatenate([new_at(signs[u[k : k + PAIRS]] ^ signs[v[k : k + PAIRS]], mask, np.full(len(u[k : k + PAIRS]), cols["t"][start])) for k in range(0, len(u), PAIRS)] or [np.zeros(0, bool)])
                u, v = u[new], v[new]
                if len(u):
                    n = np.bincount(u, size[v], len(order)) + np.bincount(v, size[u], len(order))
                    src, dst = _forest(rep[u], rep[v])
                    linked = np.flatnonzero(n)
                    low = rep[linked].copy()
                    by = np.argsort(src)
                    where = np.minimum(np.searchsorted(src[by], low), len(src) - 1)
                    hit = src[by][where] == low
                    low[hit] = dst[by][where][hit]
                    found.append([rep[linked], n[linked].astype(np.int64), low])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], names=["rep", "n", "low"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, listed: int = LISTED, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components, and vectors of other lengths, link with nothing.
    Rows with the same id and vector are rows of their own that link with each other; a row with a null id links with
    nothing, and has a null component_id and is not kept. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    ids = vectors.select(F.col("vec_id").cast("long"), "embedding")
    good = ids.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    key = F.xxhash64("embedding")
    members = scratch.table(good.withColumn("h", key), "members")
    classes = members.groupBy("h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    # An id may stand on several vectors; classes get numbers of their own, in the order of nothing.
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    bits, tables, most = plan(n, threshold)
    subset = subsets(bits, tables, seed)
    coded = classes.select(F.col("cls").alias("rep"), "size", F.size("embedding").alias("dim"), "embedding").repartition(n_partitions(spark)).mapInArrow(_codes(subset, seed), "rep long, size long, dim int, codes array<int>, signature binary, data binary")
    coded = scratch.table(coded, "codes")
    buckets = coded.select("dim", F.posexplode("codes").alias("t", "code")).groupBy("t", "dim", "code").agg(F.count("*").alias("n")).where(F.col("n") > rows)
    crowded = scratch.table(buckets.select("t", "dim", "code", F.ceil(F.col("n") / rows).cast("int").alias("blocks")), "crowded")
    many = crowded.count()
    each = coded.select("rep", "dim", "signature", F.posexplode("codes").alias("t", "code"))
    each = each.join(F.broadcast(crowded) if many <= listed else crowded, ["t", "dim", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pair = lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), (F.col("block") > k).cast("int").alias("side"))
    dealt = each.withColumn("block", block).withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))).select("t", "dim", "code", "p.i", "p.j", "p.side", "rep", "signature")
    marked = dealt.repartition(n_partitions(spark), *GROUP).sortWithinPartitions(*GROUP).mapInArrow(_marked(subset, most), "t int, dim int, code int, i int, j int, side int, rep long")
    marked = scratch.table(marked, "marked")
    fetched = marked.join(coded.select("rep", "size", "signature", "data"), "rep")
    found = fetched.repartition(n_partitions(spark), *GROUP).sortWithinPartitions(*GROUP).mapInArrow(_compare(threshold, subset), "rep long, n long, low long")
    found = scratch.table(found, "links")
    roots = connected_components(found.select(F.col("rep").alias("src"), F.col("low").alias("dst")), scratch)
    links = found.groupBy(F.col("rep").alias("cls")).agg(F.sum("n").alias("n"))
    named = classes.join(links, "cls", "left").join(roots.withColumnRenamed("id", "cls"), "cls", "left").select("h", "embedding", "rep", "size", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = members.join(named.join(least, "root"), ["h", "embedding"]).select("vec_id", (F.col("size") - 1 + F.col("n")).cast("long").alias("n_links"), "component_id")
    alone = ids.where(~(usable(F.col("embedding")) & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB, comparing all pairs."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= {threshold}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*)::BIGINT AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
