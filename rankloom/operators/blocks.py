"""One large model, or the trees of one forest, over blocks of rows: what needs no key needs no join.

Rows lie in blocks, a row of binary columns each. A level of all trees is one pass in which tasks sum (tree, node, feature,
bin), and a second one over the bins that may hold the best split inside. What reaches the driver is a level's sums by bin
and splits, which don't grow with the rows. The trees are those of an exact search (see trees.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.operators import groups
from rankloom.storage import cut, new_path, remove

#: Rows of a block; bins of all features of a model, of which each feature has 256 at least.
BLOCK, ALL_BINS = 1 << 13, 8192
#: Bytes of blocks that go to Python at once. One batch of all blocks of a task is slow to make and to read, and holds them twice.
BATCH = 4 << 20
ROWS = "x binary, code binary, t binary, w binary"
#: Rows of some trees' nodes: entries, bins, node from 0 inside its level, target less the node's mean, weight or None, tree.
Opened = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, int]]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to ``BATCH``, if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < own <= BATCH:
        spark.conf.set(name, str(BATCH))


def odd(number: str) -> Column:
    """Whether features or a column are null, or hold a null or no number."""
    entry = F.col(number).isNull() | F.isnan(number) | F.col("features").isNull() | F.exists("features", lambda v: v.isNull() | F.isnan(v))
    return F.coalesce(entry, F.lit(True))


def whole_lists(rows: DataFrame, cells: int) -> int:
    """The number of features, if each query fits a task and all entries are numbers, else 0."""
    each = rows.groupBy("qid").agg(F.sum(F.size("features")).alias("n"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("z"), F.max(odd("y")).alias("odd"))
    r = each.agg(F.max("n"), F.min("a"), F.max("z"), F.max("odd")).first()
    return int(r[1]) if r[1] and r[1] == r[2] and not r[3] and r[0] <= cells and r[1] <= ALL_BINS else 0


def width(rows: DataFrame) -> int:
    """The number of features, if it is the same for all rows and all entries and targets are numbers, else 0."""
    r = rows.agg(F.min(F.size("features")), F.max(F.size("features")), F.max(odd("t"))).first()
    return int(r[0]) if r[0] and r[0] == r[1] and not r[2] and r[0] <= ALL_BINS else 0


def bins_of(d: int) -> int:
    return max(256, 1 << (ALL_BINS // d).bit_length() - 1)


def cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Ends of each feature's bins, of about equal size."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.select(F.posexplode("features").alias("f", "v")).groupBy("f").agg(F.array_distinct(F.percentile_approx("v", probs, F.lit(8 * bins))).alias("e")).collect()
    return [np.sort(np.array(e)) for _, e in sorted((r["f"], r["e"]) for r in found)]


def coded(x: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(ends)], axis=1).astype(np.int16)


def node_of(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    node, row = np.ones(len(x), np.int64), np.arange(len(x))
    while (open_ := feature[node] >= 0).any():
        node = np.where(open_, 2 * node + (x[row, feature[node]] > threshold[node]), node)
    return node


def nine(v: np.ndarray) -> np.ndarray:
    """``v`` to nine decimals, halves away from zero as in SQL; numpy's own rounding takes them to the even neighbour."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = v * 1e9
        whole = np.trunc(scaled)
        return (whole + np.copysign(np.abs(scaled - whole) >= 0.5, scaled)) / 1e9


def _gained(s: np.ndarray, n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n * (whole - n) > 0, s * s * whole / (n * (whole - n)), -np.inf)


def best_splits(state: DataFrame, opened: Callable[[Iterator[pa.RecordBatch]], Opened], d: int, bins: int, min_split: int, slots: int, trees: int = 1, allowed: np.ndarray | None = None) -> dict[int, tuple]:
    """The best split of each slot (tree * slots + node) of a level that has one: (-gain, feature, value, next value, n and sum of the left side, n).

    Targets are less their node's mean, and weights 1 at least. ``allowed``: trees * slots x features that may be split on.
    """
    spark, own_size = state.sparkSession, slots * d * bins
    size = trees * own_size

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k, s, p, q, lo, hi = (*np.zeros((5, size)), np.full(size, np.inf), np.full(size, -np.inf))
        for x, code, slot, t, w, tree in opened(batches):
            own = slice(tree * own_size, (tree + 1) * own_size)
            wt = t if w is None else w * t
            wq, up = wt * t, np.maximum(wt, 0.0)
            for f in range(d):
                some = slice(None) if allowed is None else np.flatnonzero(allowed[tree * slots + slot, f])
                at = (slot[some] * d + f) * bins + code[some, f]
                count = np.bincount(at, minlength=own_size)
                k[own] += count
                n[own] += count if w is None else np.bincount(at, w[some], own_size)
                s[own] += np.bincount(at, wt[some], own_size)
                p[own] += np.bincount(at, up[some], own_size)
                q[own] += np.bincount(at, wq[some], own_size)
                np.minimum.at(lo[own], at, x[some, f])
                np.maximum.at(hi[own], at, x[some, f])
        at = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(v[at]) for v in (n, k, s, p, q, lo, hi)]], names=["at", "n", "k", "s", "p", "q", "lo", "hi"])

    parts = state.mapInArrow(summed, "at long, n double, k double, s double, p double, q double, lo double, hi double")
    table = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "k", "s", "p", "q")], F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow().sort_by("at")
    at, (n, k, s, p, q, lo, hi) = table.column("at").to_numpy(), (table.column(c).to_numpy() for c in ("n", "k", "s", "p", "q", "lo", "hi"))
    if not len(at):
        return {}
    own = at // bins
    new = np.append(True, own[1:] != own[:-1])
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    before = lambda v: np.cumsum(v) - v - (np.cumsum(v) - v)[begin][group]
    whole, n0, s0 = np.add.reduceat(n, begin)[group], before(n), before(s)
    last = np.append(own[1:] != own[:-1], True)
    after = np.where(last, np.nan, np.append(lo[1:], np.nan))
    large = np.add.reduceat(k, begin)[group] >= min_split
    gain = np.where(~last & large, nine(_gained(s0 + s, n0 + n, whole)), -np.inf)
    slot, f = own // d, own % d
    best: dict[int, tuple] = {}
    reach = np.zeros(trees * slots)
    good = np.flatnonzero(gain > 0)
    order = good[np.lexsort((hi[good], f[good], -gain[good], slot[good]))]
    for i in order[np.unique(slot[order], return_index=True)[1]].tolist():
        best[int(slot[i])] = (-gain[i], int(f[i]), hi[i], after[i], n0[i] + n[i], s0[i] + s[i], whole[i])
        reach[slot[i]] = gain[i]
    # The bounds are those of the trees' levels (see trees.py), for rows of weight 1 at least.
    side = np.maximum(np.abs(s0 + p), np.abs(s0 - (p - s)))
    corner = np.maximum(_gained(side, n0 + 1, whole), _gained(side, n0 + n - 1, whole))
    rest, rest_n = s0 + s, whole - n0 - n
    apart = np.divide(s0 * s0, n0, out=np.zeros(len(n)), where=n0 > 0) + np.divide(rest * rest, rest_n, out=np.zeros(len(n)), where=rest_n > 0.5) + q
    bound = np.where(np.isfinite(corner), np.minimum(corner, apart), apart)
    inside = large & (lo < hi) & (bound * (1 + 1e-9) + 1e-9 >= reach[slot])
    if not inside.any():
        return best
    flag = np.zeros(size, bool)
    flag[at[inside]] = True

    def by_value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, code, own_slot, t, w, tree in opened(batches):
            for c in range(d):
                cell = ((tree * slots + own_slot) * d + c) * bins + code[:, c]
                some = np.flatnonzero(flag[cell])
                some = some[np.lexsort((x[some, c], cell[some]))]
                if len(some):
                    cell, v = cell[some], x[some, c]
                    first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (v[1:] != v[:-1])))
                    n_ = np.diff(np.append(first, len(cell))).astype(float) if w is None else np.add.reduceat(w[some], first)
                    wt = t[some] if w is None else w[some] * t[some]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(v[first]), pa.array(n_), pa.array(np.add.reduceat(wt, first))], names=["at", "v", "n", "s"])

    # Where each flagged bin is in the table of sums.
    where = np.full(size, -1, np.int32)
    facts = tuple(v[inside] for v in (n0, s0, whole, after))
    where[at[inside]] = np.arange(int(inside.sum()))

    def best_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        cell, v, count, total = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("at", "v", "n", "s"))
        order = np.lexsort((v, cell))
        cell, v = cell[order], v[order]
        one = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (v[1:] != v[:-1])))
        cell, v, count, total = cell[one], v[one], np.add.reduceat(count[order], one), np.add.reduceat(total[order], one)
        head = np.append(True, cell[1:] != cell[:-1])
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        upto = lambda x: np.cumsum(x) - (np.cumsum(x) - x)[start]
        n0_, s0_, all_, after_ = (x[where[cell]] for x in facts)
        next_ = np.where(np.append(head[1:], True), after_, np.append(v[1:], np.nan))
        left, sum_ = n0_ + upto(count), s0_ + upto(total)
        gain_ = np.where(np.isnan(next_), -np.inf, nine(_gained(sum_, left, all_)))
        slot_, f_ = cell // (d * bins), cell // bins % d
        some = np.flatnonzero(gain_ > 0)
        some = some[np.lexsort((v[some], f_[some], -gain_[some], slot_[some]))]
        some = some[np.unique(slot_[some], return_index=True)[1]]
        found = {"slot": slot_, "loss": -gain_, "f": f_, "v": v, "next": next_, "nl": left, "sl": sum_, "whole": all_}
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in found.values()], names=list(found))

    # A bin that is summed by value holds about one in ``bins`` of the rows, so a task holds bins whole.
    parts = state.mapInArrow(by_value, "at long, v double, n double, s double").repartition("at")
    for r in parts.mapInArrow(best_inside, "slot long, loss double, f long, v double, next double, nl double, sl double, whole double").collect():
        mine = tuple(r)[1:]
        if r["slot"] not in best or mine[:3] < best[r["slot"]][:3]:
            best[r["slot"]] = mine
    return best


# -- lists --------------------------------------------------------------------------------------------------------

LISTS = "x binary, y binary, first binary"


def lists(rows: DataFrame, block: int = 8 * BLOCK) -> DataFrame:
    """Blocks of whole queries of ``rows`` (qid, doc_id, y, features), written once; see :func:`read_lists`."""

    def run(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = groups.matrix(table, "features"), groups.numbers(table, "y")
        limits, at = np.append(first, table.num_rows), 0
        while at < len(first):
            to = min(max(at + 1, int(np.searchsorted(limits, limits[at] + block))), len(first))
            a, z = int(limits[at]), int(limits[to])
            cells = (np.ascontiguousarray(x[a:z]), y[a:z], limits[at:to] - a)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["x", "y", "first"])
            at = to

    return cut(groups.map_groups(rows.select("qid", "doc_id", "y", "features"), ["qid"], run, LISTS, ["doc_id"]))


def read_lists(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels and where queries begin, of each block."""
    for b in batches:
        for i in range(b.num_rows):
            x, y, first = (np.frombuffer(b.column(c)[i].as_buffer(), k) for c, k in zip(("x", "y", "first"), (float, float, np.int64), strict=True))
            yield x.reshape(-1, d), y, first


# -- trees --------------------------------------------------------------------------------------------------------


def _packed(ends: list[np.ndarray], block: int, copies: Callable[[np.ndarray], np.ndarray] | None):
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        x = groups.matrix(table, "features")
        w = np.zeros(0, np.uint8) if copies is None else copies(groups.matrix(table, "_dice"))
        cells = (np.ascontiguousarray(x), coded(x, ends), groups.numbers(table, "t"), np.ascontiguousarray(w))
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["x", "code", "t", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= block:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return run


def _rows(batches: Iterator[pa.RecordBatch], d: int, trees: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    for b in batches:
        if b.num_rows:
            x, code, t, w = (np.concatenate([np.frombuffer(v.as_buffer(), k) for v in b.column(c)]) for c, k in zip(("x", "code", "t", "w"), (float, np.int16, float, np.uint8), strict=True))
            yield x.reshape(-1, d), code.reshape(-1, d), t, w.reshape(-1, trees) if len(w) else None


def grow(rows: DataFrame, d: int, depth: int, min_split: int = 2, trees: int = 1, drawn: Callable[[int, int], list[int]] | None = None, copies: Callable[[np.ndarray], np.ndarray] | None = None, bins: int | None = None, block: int = BLOCK) -> list[tuple]:
    """(tree, node, feature or None, threshold or None, prediction, n) of ``trees`` trees of the same rows (features, t).

    ``copies``: how often each tree takes a row, up to 255 times, from the row's ``_dice``, one number a tree. ``drawn``:
    (tree, node) -> features that the node may be split on. All entries must be numbers (:func:`width`).
    """
    spark = rows.sparkSession
    small_batches(spark)
    bins = bins or max(256, bins_of(d) >> max(0, (trees.bit_length() - 4)))
    path = new_path(spark)
    rows.mapInArrow(_packed(cuts(rows, bins), block, copies), ROWS).write.parquet(path)
    state = spark.read.schema(ROWS).parquet(path)
    span = 1 << (depth + 1)
    feature, threshold, mean = np.full((trees, span), -1), np.zeros((trees, span)), np.zeros((trees, span))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, trees * span))
        for x, _, t, w in _rows(batches, d, trees):
            for m in range(trees):
                at = m * span + node_of(x, feature[m], threshold[m])
                own = np.ones(len(t)) if w is None else w[:, m].astype(float)
                sums += [np.bincount(at, v, trees * span) for v in ((own > 0).astype(float), own, own * t)]
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(v[at]) for v in sums]], names=["at", "k", "w", "t"])

    def placed() -> tuple[np.ndarray, ...]:
        k, w, t = np.zeros((3, trees, span))
        for r in state.mapInArrow(leaves, "at long, k double, w double, t double").groupBy("at").agg(F.sum("k"), F.sum("w"), F.sum("t")).collect():
            k.flat[r[0]], w.flat[r[0]], t.flat[r[0]] = r[1], r[2], r[3]
        return k, w, t

    def opened(batches: Iterator[pa.RecordBatch]) -> Opened:
        for x, code, t, w in _rows(batches, d, trees):
            for m in range(trees):
                node = node_of(x, feature[m], threshold[m])
                on = np.flatnonzero(node >= low if w is None else (node >= low) & (w[:, m] > 0))
                yield x[on], code[on], node[on] - low, t[on] - mean[m, node[on]], None if w is None else w[on, m].astype(float), m

    k, w, t = placed()
    mean[:, 1] = np.divide(t[:, 1], w[:, 1], out=np.zeros(trees), where=w[:, 1] > 0)
    for level in range(depth):
        low = 1 << level
        allowed = None
        if drawn is not None:
            allowed = np.zeros((trees * low, d), bool)
            for i in range(trees * low):
                allowed[i, drawn(i // low, low + i % low)] = True
        best = best_splits(state, opened, d, bins, min_split, low, trees, allowed)
        if not best:
            break
        for i, (_, on, v, following, nl, sl, all_) in best.items():
            m, node = i // low, low + i % low
            feature[m, node], threshold[m, node] = on, (v + following) / 2
            mean[m, 2 * node], mean[m, 2 * node + 1] = mean[m, node] + sl / nl, mean[m, node] - sl / (all_ - nl)
    k, w, t = placed()
    remove(spark, path)
    for node in range(span // 2 - 1, 0, -1):
        for v in (k, w, t):
            v[:, node] += v[:, 2 * node] + v[:, 2 * node + 1]
    found = []
    for m, node in np.argwhere(k > 0).tolist():
        inner = feature[m, node] >= 0
        found.append((m, node, int(feature[m, node]) if inner else None, float(threshold[m, node]) if inner else None, float(t[m, node] / w[m, node]), int(k[m, node])))
    return found
