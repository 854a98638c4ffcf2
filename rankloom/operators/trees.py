"""Regression trees for many models at once.

The model is a grouping column: the trees of all queries, batches, folds and leaves grow together. A split keeps the largest
gain ``sl^2/nl + sr^2/nr``, to nine decimals; ties go to the smaller feature, then value. Values up to the threshold, half
way to the next value, go left. Nodes are numbered as in a heap: root 1, children 2i and 2i + 1; paths are R, then l or r.

A model of up to ``CELLS`` rows times features is grown whole by one task, and thousands of them are one job. Larger models
grow level by level over histograms: a sketch cuts each feature into ``BINS`` bins of about equal size, once; a level sums
(model, node, feature, bin) with map-side combine, so its shuffle is bounded by that product and no task holds a node. Splits
between bins are exact from these sums. A split inside a bin can't exceed a bound that follows from the bin's sums, as the
gain is convex in the left side's count and sum; only bins whose bound reaches the best split between bins are summed by
value. The trees are those of an exact search, whatever way a model takes. A large model without keys takes the same levels
over blocks of rows (see blocks.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from rankloom.operators import blocks, groups
from rankloom.storage import cut

#: Rows times features of a model that a task grows whole; bins of a feature of larger models, a power of 2.
CELLS, BINS = 4_000_000, 256
#: Gains of a node that differ by no more may be equal to nine decimals.
NEAR = 3e-9


def path_of(node: Column) -> Column:
    return F.concat(F.lit("R"), F.translate(F.substring(F.bin(node), 2, 64), "01", "lr"))


def half_way(v: np.ndarray, after: np.ndarray, apart: bool) -> np.ndarray:
    """Thresholds between values and the next ones; with ``apart``, those that would not be below the next value (neighbouring
    doubles, infinity) are the value itself, so that both sides of a split have rows."""
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (v + after) / 2
    return np.where((middle < after) | np.isnan(after), middle, v) if apart else middle


#: Ranges that the values of a feature are cut into where few models share a job.
RANGES = 512


def _running(sums: DataFrame, group: list[str], ranges: int) -> DataFrame:
    """``sums`` (group.., v, n, s) with sums up to v (nl, sl), of the group (tn, ts), and the value after v (next).

    With ranges, values are cut into as many of equal width, whose sums are added up first, so that a group with many
    values is as many tasks; the result is the same.
    """
    if ranges <= 1:
        each = W.partitionBy(*group)
        left = each.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
        return sums.select(*group, "v", F.sum("n").over(left).alias("nl"), F.sum("s").over(left).alias("sl"), F.sum("n").over(each).alias("tn"), F.sum("s").over(each).alias("ts"), F.lead("v").over(each.orderBy("v")).alias("next"))
    ends = sums.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * ranges), F.lit(ranges - 1)), F.lit(0))
    cells = sums.join(ends, group).withColumn("cell", at)
    per = cells.groupBy(*group, "cell").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"), F.min("v").alias("first"))
    order = W.partitionBy(*group).orderBy("cell")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    before = per.select(*group, "cell", (F.sum("cn").over(upto) - F.col("cn")).alias("n0"), (F.sum("cs").over(upto) - F.col("cs")).alias("s0"), F.lead("first").over(order).alias("after"))
    inner = W.partitionBy(*group, "cell").orderBy("v")
    left = inner.rowsBetween(W.unboundedPreceding, 0)
    met = cells.select("*", F.sum("n").over(left).alias("il"), F.sum("s").over(left).alias("is"), F.lead("v").over(inner).alias("in")).join(before, [*group, "cell"])
    return met.select(*group, "v", (F.col("n0") + F.col("il")).alias("nl"), (F.col("s0") + F.col("is")).alias("sl"), "tn", "ts", F.coalesce("in", "after").alias("next"))


def best_splits(rows: DataFrame, keys: Sequence[str], target: str = "target", min_split: int = 2, ranges: int | None = None) -> DataFrame:
    """keys.., node, feature, threshold, gain: the best split of each node that has one.

    ``rows``: keys.., node, features and the target. Gains are compared to nine decimals. A single model (no keys) has its
    values cut into ranges.
    """
    by = [*keys, "node"]
    long = rows.select(*by, F.col(target).alias("_t"), F.posexplode("features").alias("f", "v"))
    sums = long.groupBy(*by, "f", "v").agg(F.count("*").alias("n"), F.sum("_t").alias("s"))
    at = _running(sums, [*by, "f"], ranges if ranges is not None else 1 if keys else RANGES)
    gain = F.col("sl") * F.col("sl") / F.col("nl") + F.try_divide((F.col("ts") - F.col("sl")) * (F.col("ts") - F.col("sl")), F.col("tn") - F.col("nl")) - F.col("ts") * F.col("ts") / F.col("tn")
    fit = at.where((F.col("tn") >= min_split) & F.col("next").isNotNull()).withColumn("gain", F.round(gain, 9)).where("gain > 0")
    first = F.min(F.struct((-F.col("gain")).alias("loss"), "f", "v", "next")).alias("b")
    return fit.groupBy(*by).agg(first).select(*by, F.col("b.f").cast("int").alias("feature"), ((F.col("b.v") + F.col("b.next")) / 2).alias("threshold"), (-F.col("b.loss")).alias("gain"))


# -- growing --------------------------------------------------------------------------------------------------------


def grow(rows: DataFrame, keys: Sequence[str], depth: int, target: str = "target", min_split: int = 2, max_leaves: int | None = None, weight: str | None = None, draw: tuple[str, int] | None = None, cells: int = CELLS, bins: int = BINS, apart: bool = False) -> DataFrame:
    """Trees of all models: keys.., node, path, depth, is_leaf, feature, threshold, prediction, n.

    ``rows``: keys.., features, target and, if named, positive weights. With ``max_leaves`` a level keeps the best gains that
    still fit. ``draw``: a long key and a number; each node splits on one of so many features only, drawn by a hash of that
    key and the node. ``apart``: see :func:`half_way`.
    """
    keys = list(keys)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = cut(rows.select(*keys, F.col("features").cast("array<double>").alias("features"), F.col(target).cast("double").alias("t"), w.alias("w")))
    small, large = groups.parted(rows, keys, F.size("features"), cells)
    fields = [rows.schema[k] for k in keys]
    found = [(n, ST.LongType()) for n in ("node",)] + [("feature", ST.IntegerType()), ("threshold", ST.DoubleType()), ("prediction", ST.DoubleType()), ("n", ST.LongType())]
    schema = ST.StructType(fields + [ST.StructField(n, t) for n, t in found])
    parts = []
    if small is not None:
        parts.append(groups.map_groups(small, keys, _whole(keys, depth, min_split, max_leaves, draw, apart), schema))
    plain = large is not None and not keys and weight is None and max_leaves is None and draw is None and not apart
    if plain and (d := blocks.width(large)):
        found_ = blocks.grow(large.drop("w"), d, depth, min_split, bins=None if bins == BINS else bins)
        parts.append(rows.sparkSession.createDataFrame([r[1:] for r in found_], schema))
    elif large is not None:
        # Keys have names of their own there, which no sum's name can be, and are never null, so that plain joins find them.
        own = {k: f"_key{i}" for i, k in enumerate(keys)}
        held = large.select(*[F.struct(F.col(k).alias("v")).alias(v) for k, v in own.items()], "features", "t", "w")
        levels = _by_levels(held, list(own.values()), depth, min_split, max_leaves, draw and (f"{own[draw[0]]}.v", draw[1]), bins, apart)
        parts.append(levels.select(*[F.col(v)["v"].alias(k) for k, v in own.items()], *schema.names[len(keys) :]))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return finished(out, keys)


def finished(out: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys.., node, path, depth, is_leaf, feature, threshold, prediction, n, written once."""
    return cut(out.select(*keys, "node", path_of(F.col("node")).alias("path"), (F.length(F.bin("node")) - 1).cast("int").alias("depth"), F.col("feature").isNull().alias("is_leaf"), "feature", "threshold", "prediction", "n"))


def drawn_features(key: int, node: int, d: int, most: int) -> list[int]:
    """The features that a node may split on: those of the ``most`` smallest hashes, as :func:`_by_levels` finds them."""
    as_bytes = lambda v: int(v).to_bytes(8, "little", signed=True)
    seed = xxhash.xxh64_intdigest(as_bytes(node), xxhash.xxh64_intdigest(as_bytes(key), 42))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted(range(d), key=lambda f: (signed(xxhash.xxh64_intdigest(as_bytes(f), seed)), f))[:most]


def best_of(x: np.ndarray, t: np.ndarray, w: np.ndarray, slot: np.ndarray, slots: int, min_split: int, allowed: np.ndarray | None = None, presorted: bool = False, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, gain) of the best split of each slot of rows; feature -1 where there is none.

    ``allowed``: slots x features that may be split on. ``presorted``: the rows of a slot come by rising values of their one feature.
    """
    n, sums = np.bincount(slot, w, slots), np.bincount(slot, w * t, slots)
    count = np.bincount(slot, minlength=slots)
    # Targets less their slot's mean add up to 0 in each slot, so one running sum serves all of them without losing digits.
    centred = w * (t - (sums / n)[slot])
    feature, threshold, best = np.full(slots, -1, np.int64), np.zeros(slots), np.zeros(slots)
    close = []
    for f in range(x.shape[1]):
        order = np.argsort(slot.astype(np.int16 if slots < 1 << 15 else np.int64), kind="stable") if presorted else np.lexsort((x[:, f], slot))
        at, v = slot[order], x[order, f]
        new = np.append(True, at[1:] != at[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        nl, sl = np.cumsum(w[order]), np.cumsum(centred[order])
        edge = np.flatnonzero(np.append((at[1:] == at[:-1]) & (v[1:] != v[:-1]), False) & (count[at] >= min_split))
        if allowed is not None:
            edge = edge[allowed[at[edge], f]]
        here = at[edge]
        k = nl[edge] - (nl[first[edge]] - w[order][first[edge]])
        s = sl[edge] - (sl[first[edge]] - centred[order][first[edge]])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = blocks.nine(s * s * n[here] / (k * (n[here] - k)))
        good = gain > 0
        edge, here, gain = edge[good], here[good], gain[good]
        if not len(edge):
            continue
        begin = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        top = np.maximum.reduceat(gain, begin)
        some = gain >= np.maximum(np.repeat(top, np.diff(np.append(begin, len(here)))), best[here]) - NEAR
        close.append((here[some], np.full(int(some.sum()), f), v[edge[some]], v[edge[some] + 1], gain[some]))
        top_at = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(begin, len(here)))))
        _, one = np.unique(here[top_at], return_index=True)
        place, own = edge[top_at[one]], here[begin]
        better = top > best[own]
        own, place = own[better], place[better]
        best[own], feature[own], threshold[own] = top[better], f, half_way(v[place], v[place + 1], apart)
    if close:
        _settle(x, t, w, slot, [np.concatenate(c) for c in zip(*close, strict=True)], feature, threshold, best, apart)
    return feature, threshold, best


def _settle(x: np.ndarray, t: np.ndarray, w: np.ndarray, slot: np.ndarray, close: list[np.ndarray], feature: np.ndarray, threshold: np.ndarray, best: np.ndarray, apart: bool) -> None:
    """Choose anew where several splits of a slot are within ``NEAR`` of its best gain, by gains from plain sums.

    Whether nearly equal gains are equal to nine decimals hangs on how they are added up, so this is done as the definition
    says: sums of each value, then up to each value, neither centred.
    """
    at, f, v, after, gain = close
    keep = gain >= best[at] - NEAR
    at, f, v, after = at[keep], f[keep], v[keep], after[keep]
    many = np.bincount(at, minlength=len(best)) > 1
    keep = many[at]
    at, f, v, after = at[keep], f[keep], v[keep], after[keep]
    if not len(at):
        return
    order = np.lexsort((v, f, at))
    at, f, v, after = at[order], f[order], v[order], after[order]
    rows = np.flatnonzero(many[slot])
    rows = rows[np.argsort(slot[rows], kind="stable")]
    own = slot[rows]
    begins = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (f[1:] != f[:-1])))
    won: dict[int, tuple[float, int, float]] = {}
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
        s, c = int(at[lo]), int(f[lo])
        mine = rows[np.searchsorted(own, s) : np.searchsorted(own, s, side="right")]
        values, group = np.unique(x[mine, c], return_inverse=True)
        n, sums = np.cumsum(np.bincount(group, w[mine])), np.cumsum(np.bincount(group, w[mine] * t[mine]))
        place = np.searchsorted(values, v[lo:hi])
        nl, sl, tn, ts = n[place], sums[place], n[-1], sums[-1]
        found = blocks.nine(sl * sl / nl + (ts - sl) * (ts - sl) / (tn - nl) - ts * ts / tn)
        i = int(np.argmax(found))
        if s not in won or found[i] > won[s][0]:
            won[s] = float(found[i]), c, float(half_way(v[lo + i], after[lo + i], apart))
    for s, (g, c, cut_at) in won.items():
        if g > 0:
            best[s], feature[s], threshold[s] = g, c, cut_at


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of ``keys``, which are not negative, and each one's place among them."""
    top = int(keys.max(initial=0)) + 1
    if top > 4 * len(keys):
        return np.unique(keys, return_inverse=True)
    there = np.bincount(keys, minlength=top) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[keys]


def grow_arrays(x: np.ndarray, t: np.ndarray, w: np.ndarray, model: np.ndarray, depth: int, min_split: int = 2, max_leaves: int | None = None, drawn=None, presorted: bool = False, apart: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Nodes of the trees of models numbered from 0 (model, node, feature, threshold, prediction, n), and each row's leaf.

    ``drawn``: (model, node) -> features that may be split on. ``presorted``: there is one feature, and the rows of a model come
    by its rising values. ``apart``: see :func:`half_way`.
    """
    node, width, active = np.ones(len(t), np.int64), 1 << (depth + 1), np.arange(len(t))
    splits, used = [], np.zeros(int(model.max(initial=-1)) + 1, np.int64)
    for _ in range(depth):
        if not len(active):
            break
        slots, at = _numbered(model[active] * width + node[active])
        allowed = None
        if drawn is not None:
            allowed = np.zeros((len(slots), x.shape[1]), bool)
            for i, s in enumerate(slots.tolist()):
                allowed[i, drawn(s // width, s % width)] = True
        feature, threshold, gain = best_of(x[active], t[active], w[active], at, len(slots), min_split, allowed, presorted, apart)
        if max_leaves is not None:
            order = np.lexsort((slots, -gain, slots // width))
            order = order[feature[order] >= 0]
            own = slots[order] // width
            rank = np.arange(len(own)) - np.searchsorted(own, own) + 1
            feature[order[rank + used[own] + 1 > max_leaves]] = -1
            np.add.at(used, slots[feature >= 0] // width, 1)
        split = feature >= 0
        splits.append((slots[split], feature[split], threshold[split]))
        active, at = active[split[at]], at[split[at]]
        node[active] = 2 * node[active] + (x[active, feature[at]] > threshold[at])
    up = [(model * width + (node >> d))[(node >> d) > 0] for d in range(depth + 1)]
    rows = [np.flatnonzero((node >> d) > 0) for d in range(depth + 1)]
    slots, at = _numbered(np.concatenate(up))
    i = np.concatenate(rows)
    n = np.bincount(at, minlength=len(slots))
    prediction = np.bincount(at, w[i] * t[i], len(slots)) / np.bincount(at, w[i], len(slots))
    feature, threshold = np.full(len(slots), -1, np.int64), np.full(len(slots), np.nan)
    for s, f, v in splits:
        place = np.searchsorted(slots, s)
        feature[place], threshold[place] = f, v
    return {"model": slots // width, "node": slots % width, "feature": feature, "threshold": threshold, "prediction": prediction, "n": n}, node


def _whole(keys: list[str], depth: int, min_split: int, max_leaves: int | None, draw: tuple[str, int] | None, apart: bool):
    """Trees of some whole models: keys.., node, feature, threshold, prediction, n."""

    def run(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, t, w = groups.matrix(table, "features"), groups.numbers(table, "t"), groups.numbers(table, "w")
        model = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        drawn = None
        if draw is not None:
            own = table.column(draw[0]).take(pa.array(first)).to_pylist()
            drawn = lambda m, node: drawn_features(own[m], node, x.shape[1], draw[1])
        found, _ = grow_arrays(x, t, w, model, depth, min_split, max_leaves, drawn, apart=apart)
        at, inner = pa.array(first[found["model"]]), found["feature"] >= 0
        columns = [table.column(k).take(at).combine_chunks() for k in keys]
        columns += [pa.array(found["node"]), pa.array(found["feature"].astype(np.int32), mask=~inner), pa.array(found["threshold"], mask=~inner), pa.array(found["prediction"]), pa.array(found["n"])]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "node", "feature", "threshold", "prediction", "n"])

    return run


def _bin(v: Column, ends: Column, bins: int) -> Column:
    """How many of the rising ``ends``, of which there are fewer than ``bins``, lie below v: by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bins.bit_length() - 1))])
    below = lambda p, s: (p + s <= F.size(ends)) & F.coalesce(F.try_element_at(ends, p + s) < v, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(below(p, s), p + s).otherwise(p))


def _meet(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return rows.join(small, keys, how) if keys else rows.crossJoin(F.broadcast(small))


def _by_levels(rows: DataFrame, keys: list[str], depth: int, min_split: int, max_leaves: int | None, draw: tuple[str, int] | None, bins: int, apart: bool) -> DataFrame:
    """Trees of models of any size: keys.., node, feature, threshold, prediction, n."""
    by = [*keys, "node"]
    values = rows.select(*keys, F.posexplode("features").alias("f", "v"))
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    ends = values.groupBy(*keys, "f").agg(F.array_distinct(F.percentile_approx("v", probs, F.lit(8 * bins))).alias("ends"))
    model = cut(ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "ends"))), lambda e: e["ends"]).alias("ends")))
    binned = F.transform("features", lambda v, i: F.struct(v.alias("v"), _bin(v, F.element_at("ends", i + 1), bins).alias("b")))
    rows = cut(_meet(rows, model, keys).select(*keys, "features", "t", "w", binned.alias("cells")))
    mean = (F.sum(F.col("w") * F.col("t")) / F.sum("w")).alias("prediction")
    none = [F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold")]
    #: All nodes so far with their means, of which the last level's have no split yet.
    nodes = cut(rows.groupBy(*keys).agg(mean).select(*keys, F.lit(1).cast("long").alias("node"), *none, "prediction", F.lit(0.0).alias("gain")))

    def placed() -> DataFrame:
        maps = compact(nodes.withColumn("depth", F.length(F.bin("node")) - 1), keys)
        at = leaf_node(F.col("tree"), F.col("levels"), F.col("features"))
        met = _meet(rows, maps, keys).withColumn("node", at)
        return met.withColumn("mean", F.col("tree")[F.col("node")]["prediction"]).drop("tree", "levels")

    for level in range(depth):
        open_ = placed().where(F.col("node") >= 1 << level)
        off = F.col("t") - F.col("mean")
        cells = open_.select(*by, "w", (F.col("w") * off).alias("c"), (F.col("w") * off * off).alias("q"), F.posexplode("cells").alias("f", "cell")).select(*by, "w", "c", "q", "f", "cell.v", "cell.b")
        sums = cells.groupBy(*by, "f", "b").agg(F.sum("w").alias("n"), F.count("*").alias("k"), F.sum("c").alias("s"), F.sum(F.greatest("c", F.lit(0.0))).alias("p"), F.sum("q").alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("w").alias("least"))
        each = W.partitionBy(*by, "f")
        upto = each.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        table = sums.select("*", (F.sum("n").over(upto) - F.col("n")).alias("n0"), (F.sum("s").over(upto) - F.col("s")).alias("s0"), F.sum("n").over(each).alias("all"), F.sum("k").over(each).alias("rows"), F.lead("lo").over(each.orderBy("b")).alias("after"))
        table = table.where(F.col("rows") >= min_split)
        if draw is not None:
            order = F.dense_rank().over(W.partitionBy(*by).orderBy(F.xxhash64(F.col(draw[0]).cast("long"), F.col("node").cast("long"), F.col("f").cast("long")), "f"))
            table = table.withColumn("drawn", order).where(F.col("drawn") <= draw[1]).drop("drawn")
        table = cut(table)
        all_, gained = F.col("all"), lambda s, n: F.try_divide(s * s * F.col("all"), n * (F.col("all") - n))
        between = table.where("after is not null").select(*by, "f", F.col("hi").alias("v"), F.col("after").alias("next"), (F.col("n0") + F.col("n")).alias("nl"), (F.col("s0") + F.col("s")).alias("sl"), "all")
        between = between.withColumn("gain", F.round(gained(F.col("sl"), F.col("nl")), 9)).where("gain > 0")
        reach = between.groupBy(*by).agg(F.max("gain").alias("reach"))
        # Inside a bin the left side has between one row of it and all but one, and a sum between that of its negative and of its positive parts;
        # and by Cauchy's inequality the bin adds its sum of squares to the gain at most.
        side = F.greatest(F.abs(F.col("s0") + F.col("p")), F.abs(F.col("s0") - (F.col("p") - F.col("s"))))
        corner = F.greatest(gained(side, F.col("n0") + F.col("least")), gained(side, F.col("n0") + F.col("n") - F.col("least")))
        rest, rest_n = F.col("s0") + F.col("s"), all_ - F.col("n0") - F.col("n")
        divided = F.when(F.col("n0") > 0, F.try_divide(F.col("s0") * F.col("s0"), F.col("n0"))).otherwise(0.0) + F.when(rest_n > F.col("least") / 2, F.try_divide(rest * rest, rest_n)).otherwise(0.0) + F.col("q")
        bound = F.coalesce(F.least(corner, divided), divided)
        inside = table.where("lo < hi").withColumn("bound", bound).join(reach, by, "left").where(F.col("bound") * (1 + 1e-9) + 1e-9 >= F.coalesce("reach", F.lit(0.0)))
        inside = inside.select(*by, "f", "b", "n0", "s0", "all", "after")
        exact = cells.join(inside, [*by, "f", "b"]).groupBy(*by, "f", "b", "n0", "s0", "all", "after", "v").agg(F.sum("w").alias("n"), F.sum("c").alias("s"))
        one = W.partitionBy(*by, "f", "b").orderBy("v")
        left = one.rowsBetween(W.unboundedPreceding, 0)
        exact = exact.select(*by, "f", "v", F.coalesce(F.lead("v").over(one), F.col("after")).alias("next"), (F.col("n0") + F.sum("n").over(left)).alias("nl"), (F.col("s0") + F.sum("s").over(left)).alias("sl"), "all")
        exact = exact.where("next is not null").withColumn("gain", F.round(gained(F.col("sl"), F.col("nl")), 9)).where("gain > 0")
        first = F.min(F.struct((-F.col("gain")).alias("loss"), "f", "v", "next", "nl", "sl", "all")).alias("x")
        middle = (F.col("x.v") + F.col("x.next")) / 2
        middle = F.when((middle < F.col("x.next")) | F.isnan("x.next"), middle).otherwise(F.col("x.v")) if apart else middle
        split = between.unionByName(exact).groupBy(*by).agg(first).select(*by, F.col("x.f").cast("int").alias("split_on"), middle.alias("split_at"), (-F.col("x.loss")).alias("won"), (F.col("x.sl") / F.col("x.nl")).alias("to_left"), F.try_divide(-F.col("x.sl"), F.col("x.all") - F.col("x.nl")).alias("to_right"))
        split = cut(split if max_leaves is None else _within(split, nodes, keys, max_leaves))
        if split.isEmpty():
            break
        met = nodes.join(split, by, "left")
        done = met.select(*by, F.coalesce("split_on", "feature").alias("feature"), F.coalesce("split_at", "threshold").alias("threshold"), "prediction", F.coalesce("won", "gain").alias("gain"))
        new = met.where("split_on is not null").select(*keys, F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), (F.col("prediction") + F.col("to_left")).alias("prediction")), F.struct((2 * F.col("node") + 1).alias("node"), (F.col("prediction") + F.col("to_right")).alias("prediction")))).alias("x"))
        nodes = cut(done.unionByName(new.select(*keys, "x.node", *none, "x.prediction", F.lit(0.0).alias("gain"))))
    leaves = placed().groupBy(*by).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("t")).alias("s"))
    # Inner nodes get the sums of the leaves below them.
    up = leaves.select(*keys, "n", "w", "s", F.explode(F.expr(f"transform(sequence(0, {depth}), d -> shiftright(node, d))")).alias("node")).where("node > 0")
    sums = up.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), (F.sum("s") / F.sum("w")).alias("prediction"))
    return sums.join(nodes.select(*by, "feature", "threshold"), by, "left")


def _within(splits: DataFrame, nodes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best of a level's ``splits`` (won) that still fit ``most`` leaves."""
    used = nodes.groupBy(*keys).agg(F.count("feature").alias("_k"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("won"), "node"))
    return _meet(splits, used, keys).withColumn("_rn", rank).where(F.col("_rn") + F.col("_k") + 1 <= most).drop("_rn", "_k")


def compact(trees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys.., tree: one map a model, node -> (feature, threshold, prediction)."""
    entry = F.struct("node", F.struct("feature", "threshold", "prediction").alias("s"))
    return trees.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("tree"), F.max("depth").alias("levels"))


def leaf_node(tree: Column, levels: Column, features: Column) -> Column:
    """The leaf of a row, by a walk down its model's map."""

    def step(node: Column, _: Column) -> Column:
        s = F.try_element_at(tree, node)
        return F.when(s["feature"].isNull(), node).otherwise(2 * node + (F.element_at(features, s["feature"] + 1) > s["threshold"]).cast("long"))

    return F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), F.lit(1).cast("long"), step)).otherwise(F.lit(1).cast("long"))


#: Nodes of a tree that becomes nested tests, at most.
MOST_TESTS = 127


def _tests(nodes: dict, node: int, said: Callable) -> Column:
    """What the leaf of a row says, by nested tests; null where an entry that is tested is null."""
    r = nodes[node]
    if r["feature"] is None:
        return said(r)
    v = F.element_at("features", r["feature"] + 1)
    return F.when(v <= r["threshold"], _tests(nodes, 2 * node, said)).when(v > r["threshold"], _tests(nodes, 2 * node + 1, said))


def apply(df: DataFrame, trees: DataFrame, keys: Sequence[str], prediction: str = "score", leaf: str = "leaf") -> DataFrame:
    """``df`` with each row's leaf path and prediction; a row of an unknown model has neither."""
    if not keys and (nodes := {r["node"]: r for r in trees.select("node", "feature", "threshold", "prediction").limit(MOST_TESTS + 1).collect()}) and len(nodes) <= MOST_TESTS:
        # One small tree is an expression that Spark compiles; a map is walked entry by entry.
        return df.withColumns({prediction: _tests(nodes, 1, lambda r: F.lit(r["prediction"])), leaf: _tests(nodes, 1, lambda r: F.lit("R" + bin(r["node"])[3:].translate({48: "l", 49: "r"})))}).select(*[c for c in df.columns if c not in (leaf, prediction)], leaf, prediction)
    models = compact(trees, keys)
    joined = df.join(models, list(keys), "left") if keys else df.crossJoin(F.broadcast(models))
    node = F.when(F.col("tree").isNotNull(), leaf_node(F.col("tree"), F.col("levels"), F.col("features")))
    return joined.withColumn("_node", node).withColumn(leaf, path_of(F.col("_node"))).withColumn(prediction, F.col("tree")[F.col("_node")]["prediction"]).drop("tree", "levels", "_node")


def rule_text(feature: Column, threshold: Column) -> Column:
    return F.concat(F.lit("X_"), feature.cast("string"), F.lit(" <= "), F.round(threshold, 4).cast("string"))


def decision_path(leaves: DataFrame, trees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each test on the way to a leaf: leaf columns, step, rule (not negated on the right), goes_left."""
    inner = trees.where("not is_leaf").select(*keys, F.col("path").alias("_p"), F.col("depth").alias("step"), rule_text(F.col("feature"), F.col("threshold")).alias("rule"))
    above = F.expr("startswith(leaf, _p)") & (F.length("leaf") > F.length("_p"))
    met = leaves.join(inner, list(keys)) if keys else leaves.crossJoin(F.broadcast(inner))
    return met.where(above).withColumn("goes_left", F.expr("substring(leaf, length(_p) + 1, 1) = 'l'")).drop("_p")


def leaf_rules(trees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys.., leaf, rule (tests from the root, > on the right), support, prediction."""
    leaves = trees.where("is_leaf").select(*keys, F.col("path").alias("leaf"), F.col("n").alias("support"), "prediction")
    steps = decision_path(leaves, trees, keys)
    text = F.when(F.col("goes_left"), F.col("rule")).otherwise(F.regexp_replace("rule", "<=", ">"))
    return steps.groupBy(*keys, "leaf", "support", "prediction").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", text.alias("t")))), lambda s: s["t"]), " & ").alias("rule"))
