"""Boosted and bagged trees: MART, LambdaMART and random forests, for many models at once.

LambdaMART's target of a document is the sum over pairs of its query of what swapping the two in the present ranking would
change in NDCG, times the pair's logistic derivative; leaves take a Newton step. Only pairs with one of the k best ranked
count, as others don't change NDCG at k, so a query's documents meet its k best and no pair table is made: a document sums
over the k best, and the k best get the sums of the documents below them, added up with map-side combine. A query may be of
any size.

Models of up to ``CELLS`` rows times features go through all rounds in one task. A larger one without keys takes each round as
Spark jobs over blocks of whole queries; larger ones of several, or with queries that no task holds, as jobs with the score as
a column. Trees are grown over histograms then. All ways give the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from rankloom.operators import blocks, groups
from rankloom.operators import trees as T
from rankloom.operators.metrics import ideal_of
from rankloom.storage import cut, new_path, remove


@dataclass(frozen=True)
class Boost:
    """rounds and rate of boosting, depth and least rows of a split, k of NDCG@k; objective: ndcg or squared."""

    rounds: int = 30
    rate: float = 0.1
    depth: int = 3
    k: int = 10
    objective: str = "ndcg"
    min_split: int = 2

    def __post_init__(self) -> None:
        if self.objective not in ("ndcg", "squared"):
            raise ValueError("objective must be ndcg or squared")


NODES = [("round", ST.IntegerType()), ("node", ST.LongType()), ("feature", ST.IntegerType()), ("threshold", ST.DoubleType()), ("prediction", ST.DoubleType()), ("n", ST.LongType())]


# -- lambdas ------------------------------------------------------------------------------------------------------


def list_lambdas(s: np.ndarray, y: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(lambda, weight) of each document of some queries, in order of doc_id, by scores ``s`` and labels ``y``.

    ``first``: where each query begins, then the end. Scores are ranked to nine decimals, ties by doc_id. A query without a
    relevant document has none.
    """
    size, begin = np.diff(first), first[:-1]
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((-np.round(s, 9), owner))
    place = np.empty(len(s), np.int64)
    place[order] = np.arange(len(s)) - np.repeat(begin, size)
    discount = np.where(place < k, 1 / np.log2(place + 2), 0.0)
    ideal = ideal_of(y, begin, k)
    below, lam, weight, taken = place >= k, np.zeros(len(s)), np.zeros(len(s)), []
    share = np.repeat(np.divide(1.0, ideal, out=np.zeros(len(size)), where=ideal > 0), size)
    for j in range(min(k, int(size.max(initial=0)))):
        on = size > j
        top = order[np.where(on, begin + j, 0)]
        each = lambda v: np.repeat(v[top], size)  # noqa: E731, B023
        apart = each(y) - y
        delta = np.abs(apart * (each(discount) - discount)) * share
        if not on.all():
            delta *= np.repeat(on, size)
        sign = np.sign(apart)
        rho = 1 / (1 + np.exp(sign * (each(s) - s)))
        pull = delta * rho
        bend = pull * (1 - rho)
        pull *= -sign
        lam += pull
        weight += bend
        taken.append((top[on], *(np.bincount(owner, np.where(below, v, 0.0), len(size))[on] for v in (pull, bend))))
    for top, pull, bend in taken:
        lam[top] -= pull
        weight[top] += bend
    return lam, weight


def query_lambdas(s: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`list_lambdas` of one query."""
    return list_lambdas(s, y, np.array([0, len(s)]), k)


def lambdas(scored: DataFrame, k: int, keys: Sequence[str] = (), score: str = "s") -> DataFrame:
    """``scored`` (keys.., qid, doc_id, y, score) with lam and weight, as :func:`query_lambdas` gives them for each query.

    Ids and keys must not be null, and labels not negative.
    """
    by = [*keys, "qid"]
    own = W.partitionBy(*by)
    discount = lambda place: F.log(F.lit(2.0)) / F.log(place + 1.0)
    best = scored.withColumn("_r", F.row_number().over(own.orderBy(F.desc("y"), "doc_id"))).where(F.col("_r") <= k)
    ideal = best.groupBy(*by).agg(F.sum(F.col("y") * discount(F.col("_r"))).alias("_ideal"))
    first = scored.withColumn("_r", F.row_number().over(own.orderBy(F.desc(F.round(score, 9)), "doc_id"))).where(F.col("_r") <= k)
    top = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", "doc_id", F.col(score).alias("s"), "y"))).alias("_top"))
    met = scored.join(top.join(ideal, by), by)
    place = F.array_position(F.transform("_top", lambda t: t["doc_id"]), F.col("doc_id"))
    met = met.withColumn("_place", place).withColumn("_disc", F.when(F.col("_place") > 0, discount(F.col("_place"))).otherwise(0.0))

    def pair(t: Column) -> Column:
        sign = F.signum(t["y"] - F.col("y"))
        delta = F.coalesce(F.try_divide(F.abs(t["y"] - F.col("y")) * F.abs(discount(t["_r"]) - F.col("_disc")), F.when(F.col("_ideal") > 0, F.col("_ideal"))), F.lit(0.0))
        rho = F.lit(1.0) / (F.lit(1.0) + F.exp(sign * (t["s"] - F.col(score))))
        return F.struct((-sign * delta * rho).alias("l"), (delta * rho * (F.lit(1.0) - rho)).alias("w"))

    met = met.withColumn("_pairs", F.transform("_top", pair))
    below = met.where("_place = 0").select(*by, F.posexplode("_pairs").alias("_at", "p"))
    sums = below.groupBy(*by, (F.col("_at") + 1).cast("long").alias("_place")).agg(F.sum("p.l").alias("_l"), F.sum("p.w").alias("_w"))
    add = lambda field: F.aggregate(F.transform("_pairs", lambda p: p[field]), F.lit(0.0), lambda a, x: a + x)
    out = met.withColumn("_own_l", add("l")).withColumn("_own_w", add("w")).drop("_top", "_ideal", "_pairs", "_disc").join(sums, [*by, "_place"], "left")
    return out.select(*scored.columns, (F.col("_own_l") - F.coalesce("_l", F.lit(0.0))).alias("lam"), (F.col("_own_w") + F.coalesce("_w", F.lit(0.0))).alias("weight"))


# -- boosting -----------------------------------------------------------------------------------------------------


def _model_rounds(x: np.ndarray, y: np.ndarray, first: np.ndarray, c: Boost) -> Iterator[dict[str, np.ndarray]]:
    """The rounds' trees of one model, predictions in their leaves; round 0 is the base."""
    s = np.full(len(y), y.mean() if c.objective == "squared" else 0.0)
    yield {"round": np.zeros(1, int), "node": np.ones(1, int), "feature": np.full(1, -1), "threshold": np.full(1, np.nan), "prediction": s[:1].copy(), "n": np.full(1, len(y))}
    for r in range(1, c.rounds + 1):
        if c.objective == "squared":
            target, bend = y - s, np.ones(len(y))
        else:
            target, bend = list_lambdas(s, y, first, c.k)
        tree, leaf = T.grow_arrays(x, target, np.ones(len(y)), np.zeros(len(y), np.int64), c.depth, c.min_split)
        size = int(leaf.max()) + 1
        up, down = np.bincount(leaf, target, size), np.bincount(leaf, bend, size)
        step = c.rate * np.divide(up, down, out=np.zeros(size), where=down > 1e-12)
        s = s + step[leaf]
        is_leaf = tree["feature"] < 0
        yield {"round": np.full(len(is_leaf), r), **{k: tree[k] for k in ("node", "feature", "threshold", "n")}, "prediction": np.where(is_leaf, step[np.where(is_leaf, tree["node"], 0)], 0.0)}


def _whole(keys: list[str], c: Boost):
    def run(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = groups.matrix(table, "features"), groups.numbers(table, "y")
        lists = np.append(groups.starts_of(table, [*keys, "qid"]), table.num_rows)
        ends = np.append(first, table.num_rows)
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = lists[(lists >= a) & (lists <= z)] - a
            rounds = list(_model_rounds(x[a:z], y[a:z], own, c))
            cell = {k: np.concatenate([r[k] for r in rounds]) for k, _ in NODES}
            inner = cell["feature"] >= 0
            columns = [table.column(k).take(pa.array(np.full(len(inner), a))).combine_chunks() for k in keys]
            columns += [pa.array(cell["round"], pa.int32()), pa.array(cell["node"], pa.int64()), pa.array(cell["feature"], pa.int32(), mask=~inner), pa.array(cell["threshold"], pa.float64(), mask=~inner), pa.array(cell["prediction"], pa.float64()), pa.array(cell["n"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *[k for k, _ in NODES]])

    return run


def _by_rounds(rows: DataFrame, keys: list[str], c: Boost, cells: int) -> DataFrame:
    """The same trees, a round at a time."""
    meet = lambda a, b, how="inner": a.join(b, keys, how) if keys else a.crossJoin(F.broadcast(b))
    mean = F.avg("y") if c.objective == "squared" else F.lit(0.0)
    base = cut(rows.groupBy(*keys).agg(mean.alias("prediction"), F.count("*").alias("n")))
    none = [F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold")]
    out = base.select(*keys, F.lit(0).alias("round"), F.lit(1).cast("long").alias("node"), *none, "prediction", "n")
    state = cut(meet(rows, base.select(*keys, F.col("prediction").alias("s"))))
    columns = [*keys, "qid", "doc_id", "y", "features", "s"]
    for r in range(1, c.rounds + 1):
        if c.objective == "squared":
            marked = state.select(*columns, (F.col("y") - F.col("s")).alias("lam"), F.lit(1.0).alias("weight"))
        else:
            marked = cut(lambdas(state.select(*columns), c.k, keys))
        grown = T.grow(marked, keys, c.depth, "lam", c.min_split, cells=cells)
        placed = T.apply(marked, grown, keys, "_mean", "_leaf")
        bend = F.sum("weight")
        steps = cut(placed.groupBy(*keys, "_leaf").agg(F.when(bend > 1e-12, F.lit(c.rate) * F.sum("lam") / bend).otherwise(0.0).alias("_step")))
        state = cut(placed.join(steps, [*keys, "_leaf"]).select(*columns[:-1], (F.col("s") + F.col("_step")).alias("s")))
        tree = grown.withColumnRenamed("path", "_leaf").drop("prediction").join(steps, [*keys, "_leaf"], "left")
        out = out.unionByName(cut(tree.select(*keys, F.lit(r).alias("round"), "node", "feature", "threshold", F.coalesce("_step", F.lit(0.0)).alias("prediction"), "n")))
    return out


# -- one large model over blocks of whole queries -----------------------------------------------------------------

_blocked = blocks.whole_lists
BLOCKS = "x binary, code binary, y binary, first binary, s binary, lam binary, weight binary"
NAMES = [p.split()[0] for p in BLOCKS.split(", ")]


def _blocks(ends: list[np.ndarray], base: float, block: int):
    def run(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = groups.matrix(table, "features"), groups.numbers(table, "y")
        limits, at = np.append(first, table.num_rows), 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(limits, limits[at] + block)))
            to = min(to, len(first))
            a, z = int(limits[at]), int(limits[to])
            cells = (np.ascontiguousarray(x[a:z]), blocks.coded(x[a:z], ends), y[a:z], limits[at : to + 1] - a, np.full(z - a, base), np.zeros(z - a), np.zeros(z - a))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=NAMES)
            at = to

    return run


TYPES = dict(zip(NAMES, (float, np.int16, float, np.int64, float, float, float), strict=True))


def _read(batch: pa.RecordBatch, d: int) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each block of a batch."""
    for i in range(batch.num_rows):
        block = {k: np.frombuffer(batch.column(k)[i].as_buffer(), TYPES[k]) for k in batch.schema.names}
        yield {k: v.reshape(-1, d) if k in ("x", "code") else v for k, v in block.items()}


def _together(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of all blocks of each batch, which a task adds up at once."""
    for b in batches:
        if b.num_rows:
            found = list(_read(b, d))
            yield tuple(np.concatenate([f[k] for f in found]) if len(found) > 1 else found[0][k] for k in b.schema.names)


def _by_blocks(rows: DataFrame, c: Boost, d: int, block: int, bins: int | None) -> DataFrame:
    """The same trees for one model of any size, whose queries fit tasks: a round rewrites the blocks' scores and lambdas, a
    level sums bins of nodes in tasks, and only bins that may hold the best split are summed by value."""
    spark, n_bins = rows.sparkSession, bins or blocks.bins_of(d)
    blocks.small_batches(spark)
    ends = blocks.cuts(rows, n_bins)
    base, total = rows.agg(F.avg("y"), F.count("*")).first()
    base = base if c.objective == "squared" else 0.0
    width = 1 << (c.depth + 1)
    found = [(0, 1, None, None, float(base), int(total))]
    state, path = None, None
    made = groups.map_groups(rows.select("qid", "doc_id", "y", "features"), ["qid"], _blocks(ends, base, block), BLOCKS, ["doc_id"])
    feature, threshold, step = np.full(width, -1), np.zeros(width), np.zeros(width)
    for r in range(1, c.rounds + 1):

        def marked(batches: Iterator[pa.RecordBatch], tree=(feature, threshold, step)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for f in _read(b, d):
                    y, s = f["y"], f["s"] + tree[2][blocks.node_of(f["x"], tree[0], tree[1])]
                    lam, weight = (y - s, np.ones(len(y))) if c.objective == "squared" else list_lambdas(s, y, f["first"], c.k)
                    yield pa.RecordBatch.from_arrays([pa.array([k.tobytes()], pa.binary()) for k in (f["x"], f["code"], y, f["first"], s, lam, weight)], names=NAMES)

        last, path = path, new_path(spark)
        (made if state is None else state.select("x", "code", "y", "first", "s")).mapInArrow(marked, BLOCKS).write.parquet(path)
        state = spark.read.schema(BLOCKS).parquet(path)
        if last is not None:
            remove(spark, last)
        feature, threshold, mean = np.full(width, -1), np.zeros(width), np.zeros(width)
        for level in range(c.depth):
            _level(state, d, n_bins, c.min_split, level, feature, threshold, mean)
            if not (feature[1 << level : 2 << level] >= 0).any():
                break
        sums = _leaves(state, d, feature, threshold)
        n, up, down = np.zeros(width, np.int64), np.zeros(width), np.zeros(width)
        for node, k, a, b in sums:
            n[node], up[node], down[node] = k, a, b
        step = c.rate * np.divide(up, down, out=np.zeros(width), where=down > 1e-12)
        for node in range(width // 2 - 1, 0, -1):
            n[node] += n[2 * node] + n[2 * node + 1]
        for node in np.flatnonzero(n).tolist():
            inner = feature[node] >= 0
            found.append((r, node, int(feature[node]) if inner else None, float(threshold[node]) if inner else None, 0.0 if inner else float(step[node]), int(n[node])))
    return spark.createDataFrame(found, ST.StructType([ST.StructField(n, t) for n, t in NODES]))


def _leaves(state: DataFrame, d: int, feature: np.ndarray, threshold: np.ndarray) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(feature)))
        for x, lam, weight in _together(batches, d):
            node = blocks.node_of(x, feature, threshold)
            sums += [np.bincount(node, v, len(feature)) for v in (np.ones(len(x)), lam, weight)]
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(v[at]) for v in sums]], names=["node", "n", "l", "w"])

    parts = state.select("x", "lam", "weight").mapInArrow(run, "node long, n double, l double, w double")
    return [(r[0], int(r[1]), r[2], r[3]) for r in parts.groupBy("node").agg(F.sum("n"), F.sum("l"), F.sum("w")).collect()]


def _level(state: DataFrame, d: int, bins: int, min_split: int, level: int, feature: np.ndarray, threshold: np.ndarray, mean: np.ndarray) -> None:
    """Fill in the best splits of a level's nodes, and their children's means."""
    low = 1 << level

    def opened(batches: Iterator[pa.RecordBatch]) -> blocks.Opened:
        for x, code, lam in _together(batches, d):
            node = blocks.node_of(x, feature, threshold)
            on = slice(None) if low == 1 else node >= low
            yield x[on], code[on], node[on] - low, lam[on] - mean[node[on]], None, 0

    for k, (_, on, v, following, nl, sl, all_) in blocks.best_splits(state.select("x", "code", "lam"), opened, d, bins, min_split, low).items():
        node = low + k
        feature[node], threshold[node] = on, (v + following) / 2
        mean[2 * node], mean[2 * node + 1] = mean[node] + sl / nl, mean[node] - sl / (all_ - nl)


def fit(train: DataFrame, config: Boost | None = None, keys: Sequence[str] = (), cells: int = T.CELLS, block: int = blocks.BLOCK, bins: int | None = None) -> DataFrame:
    """The rounds' trees of all models: keys.., round (0 is the base), node, feature, threshold, prediction, n.

    ``train``: keys.., qid, doc_id, y, features. The objective ndcg is LambdaMART, squared is MART. Keys and ids must not be
    null; labels of LambdaMART must not be negative.
    """
    c, keys = config or Boost(), list(keys)
    rows = cut(train.select(*keys, *[k for k in ("qid", "doc_id") if k not in keys], F.col("y").cast("double").alias("y"), F.col("features").cast("array<double>").alias("features")))
    small, large = groups.parted(rows, keys, F.size("features"), cells)
    schema = ST.StructType([rows.schema[k] for k in keys] + [ST.StructField(n, t) for n, t in NODES])
    parts = [] if small is None else [groups.map_groups(small, keys, _whole(keys, c), schema, ["qid", "doc_id"])]
    if large is not None:
        d = 0 if keys else blocks.whole_lists(large, T.CELLS if cells else 0)
        parts.append(_by_blocks(large, c, d, block, bins).select(*schema.names) if d else _by_rounds(large, keys, c, cells).select(*schema.names))
    return cut(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def predict(df: DataFrame, ensemble: DataFrame, keys: Sequence[str] = (), score: str = "score", rounds: int | None = None) -> DataFrame:
    """``df`` with the sum of its model's trees, or of the first ``rounds`` of them; a row of an unknown model has none."""
    keys = list(keys)
    some = ensemble if rounds is None else ensemble.where(F.col("round") <= rounds)
    each = T.compact(some.withColumn("depth", F.length(F.bin("node")) - 1), [*keys, "round"])
    card = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("round", "levels", F.map_entries("tree").alias("e")))).alias("_trees"))
    card = card.select(*keys, F.transform("_trees", lambda t: F.struct(t["levels"].alias("levels"), F.map_from_entries(t["e"]).alias("tree"))).alias("_trees"))
    met = df.join(card, keys, "left") if keys else df.crossJoin(F.broadcast(card))
    value = F.aggregate("_trees", F.lit(0.0), lambda a, t: a + t["tree"][T.leaf_node(t["tree"], t["levels"], F.col("features"))]["prediction"])
    return met.withColumn(score, value).drop("_trees")


# -- random forests -----------------------------------------------------------------------------------------------

#: Probabilities that a Poisson variable of mean 1 is 0, at most 1, .. at most 6.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)


def _dice(tree: Column, *ids: str) -> Column:
    return F.pmod(F.xxhash64(tree.cast("long"), *[F.col(i) for i in ids]), F.lit(1 << 40))


def bootstrap_weight(tree: Column, *ids: str) -> Column:
    """How often a row is in a tree's sample: Poisson of mean 1, by a hash of the tree and the row's ids."""
    u = _dice(tree, *ids) / float(1 << 40)
    return sum(((u >= p).cast("int") for p in POISSON), F.lit(0))


def bootstrap_weights(dice: np.ndarray) -> np.ndarray:
    """The same inside tasks, from the hashes."""
    return np.searchsorted(POISSON, dice / float(1 << 40), side="right").astype(np.uint8)


def grow_forest(train: DataFrame, n_trees: int, depth: int, features: int, keys: Sequence[str] = (), cells: int = T.CELLS, bins: int | None = None) -> DataFrame:
    """Trees keys.., tree_no, node, .. as :func:`trees.grow` gives them, each of a bootstrap sample of its model's rows, a node
    splitting on one of ``features`` drawn features.

    Without keys, rows that no task holds are one pass a level for all trees, over blocks, and not copied for each tree.
    """
    if not keys:
        rows = cut(train.select("qid", "doc_id", F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("t")))
        n = rows.agg(F.sum(F.size("features"))).first()[0]
        if n is not None and n > cells and (d := blocks.width(rows)):
            drawn = lambda tree, node: T.drawn_features(tree, node, d, features)
            dice = F.array(*[_dice(F.lit(t), "qid", "doc_id") for t in range(n_trees)])
            found = blocks.grow(rows.select("features", "t", dice.alias("_dice")), d, depth, 2, n_trees, drawn, bootstrap_weights, bins)
            schema = "tree_no long, node long, feature int, threshold double, prediction double, n long"
            return T.finished(train.sparkSession.createDataFrame(found, schema), ["tree_no"])
    copies = train.withColumn("tree_no", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)).cast("array<bigint>")))
    drawn_rows = copies.withColumn("_w", bootstrap_weight(F.col("tree_no"), *keys, "qid", "doc_id")).where("_w > 0")
    return T.grow(drawn_rows, [*keys, "tree_no"], depth, "y", weight="_w", draw=("tree_no", features), cells=cells)


def _walk(features: list | None, feature: np.ndarray, threshold: np.ndarray) -> int:
    """The leaf of one row that may lack entries: 0 if a tested one is null; no number is more than any threshold."""
    node = 1
    while (f := int(feature[node])) >= 0:
        v = features[f] if features is not None and f < len(features) else None
        if v is None:
            return 0
        node = 2 * node + int(not v <= threshold[node])
    return node


def _one_forest(df: DataFrame, forest: DataFrame, out_of_bag: bool) -> DataFrame:
    """qid, doc_id, _s, _n: sum and number of what the trees of one forest, which tasks hold, say of each row."""
    nodes = forest.select("tree_no", "node", "feature", "threshold", "prediction").toArrow()
    names, tree = np.unique(nodes.column("tree_no").to_numpy(), return_inverse=True)
    node = nodes.column("node").to_numpy()
    span = int(node.max(initial=1)) + 1
    feature, threshold, said = np.full((len(names), span), -1), np.zeros((len(names), span)), np.full((len(names), span), np.nan)
    feature[tree, node] = nodes.column("feature").fill_null(-1).to_numpy()
    threshold[tree, node] = nodes.column("threshold").fill_null(0.0).to_numpy()
    said[tree, node] = nodes.column("prediction").to_numpy()
    dice = F.array(*[_dice(F.lit(int(t)), "qid", "doc_id") for t in names]) if out_of_bag else F.array()
    lean = df.select("qid", "doc_id", F.col("features").cast("array<double>").alias("features"), dice.cast("array<bigint>").alias("_dice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("features")
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False)
            even = not lists.null_count and not flat.null_count and not np.isnan(x).any() and b.num_rows and len(set(lists.value_lengths().to_pylist())) == 1
            x = x.reshape(b.num_rows, -1) if even else lists.to_pylist()
            use = bootstrap_weights(b.column("_dice").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)) == 0 if out_of_bag else np.ones((b.num_rows, len(names)), bool)
            sums, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for m in range(len(names)):
                own = np.flatnonzero(use[:, m])
                at = blocks.node_of(x[own], feature[m], threshold[m]) if even else np.array([_walk(x[i], feature[m], threshold[m]) for i in own], np.int64)
                v = said[m, at]
                known = ~np.isnan(v)
                sums[own[known]] += v[known]
                n[own[known]] += 1
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("doc_id"), pa.array(sums), pa.array(n)], names=["qid", "doc_id", "_s", "_n"])

    schema = ST.StructType([df.schema["qid"], df.schema["doc_id"], ST.StructField("_s", ST.DoubleType()), ST.StructField("_n", ST.LongType())])
    return lean.mapInArrow(run, schema)


def forest_scores(df: DataFrame, forest: DataFrame, keys: Sequence[str] = (), score: str = "score", out_of_bag: bool = False) -> DataFrame:
    """keys.., qid, doc_id, score: the mean of a row's trees; out of bag, of those whose sample it isn't in (null if of all).

    One forest is sent to tasks; rows meet their model's trees by a join on keys.
    """
    by = [*keys, "qid", "doc_id"]
    if not keys:
        return _one_forest(df, forest, out_of_bag).groupBy(*by).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias(score))
    names = forest.select("tree_no").distinct().agg(F.sort_array(F.collect_list("tree_no"))).first()[0]
    copies = df.withColumn("tree_no", F.explode(F.array(*[F.lit(t).cast("long") for t in names])))
    each = T.apply(copies, forest, [*keys, "tree_no"], "_p", "_leaf")
    own = F.when(bootstrap_weight(F.col("tree_no"), *by) == 0, F.col("_p")) if out_of_bag else F.col("_p")
    return each.groupBy(*by).agg(F.avg(own).alias(score))
