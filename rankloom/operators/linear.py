"""Linear rankers: ListNet, AdaRank and least squares, for many models at once.

ListNet's loss of a query is the cross-entropy between the softmax of its labels and that of its scores; the gradient is a sum
over documents. A sweep trains all learning rates at once and keeps the weights after several numbers of epochs. Models of up
to ``CELLS`` rows times features are swept whole by a task; for larger ones an epoch is a job: for one model a pass over blocks
of whole lists, for models by keys the queries' normalisers, then the gradients' sums.

AdaRank boosts on a distribution over queries: its weak rankers are features, whose NDCG for every query is found once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from rankloom.functions import vectors
from rankloom.operators import blocks, groups, metrics
from rankloom.operators import trees as T
from rankloom.storage import cut


# -- ListNet ------------------------------------------------------------------------------------------------------


def softmax_of(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The softmax of each column of ``s`` inside lists that begin at ``first``."""
    n = np.diff(np.append(first, len(s)))
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), n, axis=0))
    return e / np.repeat(np.add.reduceat(e, first), n, axis=0)


def listnet_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> float:
    """Mean cross-entropy of lists between softmax(y) and softmax(x w)."""
    return float(-(softmax_of(y[:, None], first) * np.log(softmax_of((x @ w)[:, None], first))).sum() / len(first))


def listnet_gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Its derivative, for each column of ``w``."""
    return x.T @ (softmax_of(x @ w, first) - softmax_of(y[:, None], first)) / len(first)


def _whole(keys: list[str], rates: list[float], epochs: list[int]):
    def run(table: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = groups.matrix(table, "_x"), groups.numbers(table, "y")
        lists = groups.starts_of(table, [*keys, "qid"])
        ends = np.append(begin, table.num_rows)
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            first = lists[(lists >= a) & (lists < z)] - a
            w, rows = np.zeros((x.shape[1], len(rates))), []
            for epoch in range(1, max(epochs) + 1):
                w = w - np.array(rates) * listnet_gradient(w, x[a:z], y[a:z], first)
                rows += [(r, epoch, w[:, i].tolist()) for i, r in enumerate(rates)] if epoch in epochs else []
            columns = [table.column(k).take(pa.array(np.full(len(rows), a))).combine_chunks() for k in keys]
            columns += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.float64(), pa.int32(), pa.list_(pa.float64())), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "rate", "epoch", "weights"])

    return run


def _by_epochs(rows: DataFrame, keys: list[str], rates: list[float], epochs: list[int]) -> DataFrame:
    meet = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    by = [*keys, "qid"]
    low = rows.groupBy(*by).agg(F.max("y").alias("_m"))
    total = rows.join(low, by).groupBy(*by, "_m").agg(F.sum(F.exp(F.col("y") - F.col("_m"))).alias("_t"))
    rows = cut(rows.join(total, by).select(*by, "_x", (F.exp(F.col("y") - F.col("_m")) / F.col("_t")).alias("_want")))
    shape = cut(rows.groupBy(*keys).agg(F.countDistinct("qid").alias("_lists"), F.max(F.size("_x")).alias("_d")))
    d = shape.agg(F.max("_d")).first()[0]
    at = F.array(*[F.lit(float(r)) for r in rates])
    weights = shape.select(*keys, "_lists", F.explode(at).alias("rate"), F.array_repeat(F.lit(0.0), d).alias("weights"))
    out = None
    for epoch in range(1, max(epochs) + 1):
        scored = meet(rows, weights).withColumn("_s", vectors.dot(F.col("_x"), F.col("weights")))
        one = [*by, "rate"]
        most = scored.groupBy(*one).agg(F.max("_s").alias("_m"))
        total = scored.join(most, one).groupBy(*one, "_m").agg(F.sum(F.exp(F.col("_s") - F.col("_m"))).alias("_t"))
        off = scored.join(total, one).withColumn("_off", F.exp(F.col("_s") - F.col("_m")) / F.col("_t") - F.col("_want"))
        sums = off.groupBy(*keys, "rate").agg(F.array(*[F.sum(F.col("_off") * F.col("_x")[i]) for i in range(d)]).alias("_g"))
        step = lambda v, g: v - F.col("rate") * g / F.col("_lists")
        weights = cut(weights.join(sums, [*keys, "rate"]).select(*keys, "_lists", "rate", F.zip_with("weights", "_g", step).alias("weights")))
        if epoch in epochs:
            part = weights.select(*keys, "rate", F.lit(epoch).alias("epoch"), "weights")
            out = part if out is None else out.unionByName(part)
    return out


def _by_blocks(rows: DataFrame, d: int, rates: list[float], epochs: list[int]) -> DataFrame:
    """The same sweeps of one large model: an epoch is a pass over blocks of whole lists, of which each task gives a gradient's sums."""
    state = blocks.lists(rows.withColumnRenamed("_x", "features"))
    w, n, found = np.zeros((d, len(rates))), 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, lists = np.zeros((d, len(rates))), 0
        for x, y, first in blocks.read_lists(batches, d):
            sums += listnet_gradient(w, x, y, first) * len(first)
            lists += len(first)
        yield pa.RecordBatch.from_arrays([pa.array([lists]), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "g"])

    for epoch in range(1, max(epochs) + 1):
        parts = state.mapInArrow(run, "n long, g array<double>").collect()
        n = sum(r["n"] for r in parts)
        w = w - np.array(rates) * np.sum([r["g"] for r in parts], axis=0).reshape(d, -1) / n
        found += [(r, epoch, w[:, i].tolist()) for i, r in enumerate(rates)] if epoch in epochs else []
    return rows.sparkSession.createDataFrame(found, "rate double, epoch int, weights array<double>")


def standardised(train: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys.., centre, spread: mean and population deviation of each feature of a model (1 where it doesn't vary)."""
    each = train.select(*keys, F.posexplode("features").alias("_f", "_v")).groupBy(*keys, "_f").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_d"))
    ranked = F.array_sort(F.collect_list(F.struct("_f", "_m", "_d")))
    spread = lambda e: F.when(e["_d"] > 1e-12, e["_d"]).otherwise(1.0)
    return each.groupBy(*keys).agg(ranked.alias("_e")).select(*keys, F.transform("_e", lambda e: e["_m"]).alias("centre"), F.transform("_e", spread).alias("spread"))


def _scaled(df: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    met = df.join(scales, keys) if keys else df.crossJoin(F.broadcast(scales))
    return met.withColumn("_x", F.transform("features", lambda v, i: (v - F.element_at("centre", i + 1)) / F.element_at("spread", i + 1))).drop("centre", "spread")


def listnet(train: DataFrame, rates: Sequence[float], epochs: Sequence[int], keys: Sequence[str] = (), cells: int = T.CELLS) -> DataFrame:
    """keys.., rate, epoch, weights, centre, spread: ListNet after each number of epochs for each learning rate.

    ``train``: keys.., qid, doc_id, y, features. Features are standardised by model; an epoch is one step along the mean
    gradient of the model's lists. Keys and ids must not be null.
    """
    keys, rates, epochs = list(keys), [float(r) for r in rates], sorted({int(e) for e in epochs})
    if not rates or not epochs or epochs[0] < 1:
        raise ValueError("one learning rate and one number of epochs at least")
    scales = cut(standardised(train, keys))
    rows = _scaled(train.select(*keys, *[k for k in ("qid", "doc_id") if k not in keys], F.col("y").cast("double").alias("y"), F.col("features").cast("array<double>").alias("features")), scales, keys)
    rows = cut(rows.drop("features"))
    small, large = groups.parted(rows, keys, F.size("_x"), cells)
    schema = ST.StructType([rows.schema[k] for k in keys] + [ST.StructField("rate", ST.DoubleType()), ST.StructField("epoch", ST.IntegerType()), ST.StructField("weights", ST.ArrayType(ST.DoubleType()))])
    parts = [] if small is None else [groups.map_groups(small, keys, _whole(keys, rates, epochs), schema, ["qid", "doc_id"])]
    if large is not None:
        d = 0 if keys else blocks.whole_lists(large.withColumnRenamed("_x", "features"), T.CELLS if cells else 0)
        parts.append(_by_blocks(large, d, rates, epochs) if d else _by_epochs(large, keys, rates, epochs).select(*schema.names))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return cut(out.join(scales, keys) if keys else out.crossJoin(F.broadcast(scales)))


def listnet_scores(df: DataFrame, models: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """``df`` with rate, epoch and score: a row for each sweep of its model."""
    keys = list(keys)
    met = df.join(models, keys) if keys else df.crossJoin(F.broadcast(models))
    x = F.transform("features", lambda v, i: (v - F.element_at("centre", i + 1)) / F.element_at("spread", i + 1))
    return met.withColumn(score, vectors.dot(x, F.col("weights"))).drop("weights", "centre", "spread")


def listnet_selection(parts: dict[str, DataFrame], rates: Sequence[float], epochs: Sequence[int], keys: Sequence[str], eval_at: int = 10, cells: int = T.CELLS) -> DataFrame:
    """keys.., rate, epoch, train, valid, test: the first sweep of each model with the largest mean NDCG on valid, by rate and epoch.

    ``parts``: train, valid and test, with keys. A part without documents of a model counts 0.
    """
    from rankloom.operators.selection import argmax

    keys = list(keys)
    models = listnet(parts["train"], rates, epochs, keys, cells)
    sweep = [*keys, "rate", "epoch"]
    out = models.select(*sweep)
    for name in ("train", "valid", "test"):
        scored = listnet_scores(parts[name], models, keys).withColumn("score", F.round("score", 9))
        mean = metrics.ndcg(scored, "score", eval_at, [*sweep, "qid"]).groupBy(*sweep).agg(F.avg("ndcg").alias(name))
        out = out.join(mean, sweep, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    ranked = out.withColumn("_valid", F.round("valid", 9)).withColumn("_sweep", F.struct("rate", "epoch"))
    return argmax(ranked, keys, "_valid", "_sweep").drop("_valid", "_sweep")


# -- AdaRank ------------------------------------------------------------------------------------------------------


def adarank(train: DataFrame, rounds: int = 10, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """keys.., round (from 1), feature, alpha: boosted features, by NDCG@k under weights of queries.

    A round takes the feature with the largest weighted NDCG, ties to the smaller, with half the logarithm of the weighted
    (1 + NDCG) over (1 - NDCG); then queries weigh exp(-NDCG) of the scores so far, which sum the features taken. Keys and ids
    must not be null.
    """
    keys = list(keys)
    by = [*keys, "qid"]
    rows = cut(train.select(*keys, *[c for c in ("qid", "doc_id") if c not in keys], "y", "features"))
    each = rows.select(*by, "doc_id", "y", F.posexplode("features").alias("_f", "_v"))
    weak = cut(metrics.ndcg(each, "_v", k, [*by, "_f"]).select(*by, "_f", "ndcg"))
    n = rows.groupBy(*keys).agg(F.countDistinct("qid").alias("_n"))
    queries = rows.select(*by).distinct()
    weigh = cut((queries.join(n, keys) if keys else queries.crossJoin(F.broadcast(n))).select(*by, (F.lit(1.0) / F.col("_n")).alias("_p")))
    out = None
    for r in range(1, rounds + 1):
        met = weak.join(weigh, by).groupBy(*keys, "_f").agg(F.sum(F.col("_p") * F.col("ndcg")).alias("_e"), F.sum("_p").alias("_all"))
        first = met.groupBy(*keys).agg(F.min(F.struct((-F.round("_e", 9)).alias("_loss"), "_f", "_e", "_all")).alias("_x"))
        alpha = F.lit(0.5) * F.log((F.col("_x._all") + F.col("_x._e")) / F.greatest(F.col("_x._all") - F.col("_x._e"), F.lit(1e-9)))
        taken = cut(first.select(*keys, F.lit(r).alias("round"), F.col("_x._f").cast("int").alias("feature"), alpha.alias("alpha")))
        out = taken if out is None else out.unionByName(taken)
        if r == rounds:
            break
        scored = adarank_scores(rows, out, keys).withColumn("score", F.round("score", 9))
        e = metrics.ndcg(scored, "score", k, by).select(*by, F.exp(-F.col("ndcg")).alias("_z"))
        whole = e.groupBy(*keys).agg(F.sum("_z").alias("_t"))
        weigh = cut((e.join(whole, keys) if keys else e.crossJoin(F.broadcast(whole))).select(*by, (F.col("_z") / F.col("_t")).alias("_p")))
    return cut(out)


def adarank_scores(df: DataFrame, model: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """``df`` with the sum of its model's features times their alphas."""
    keys = list(keys)
    card = model.groupBy(*keys).agg(F.collect_list(F.struct("round", "feature", "alpha")).alias("_taken")).withColumn("_taken", F.array_sort("_taken"))
    met = df.join(card, keys, "left") if keys else df.crossJoin(F.broadcast(card))
    return met.withColumn(score, F.aggregate("_taken", F.lit(0.0), lambda a, t: a + t["alpha"] * F.element_at("features", t["feature"] + 1))).drop("_taken")


# -- least squares ------------------------------------------------------------------------------------------------


def least_squares(train: DataFrame, ridge: float = 1e-10, keys: Sequence[str] = ()) -> DataFrame:
    """keys.., weights (the intercept last): least squares of y on the features, with an L2 penalty on all weights but the intercept.

    Sums of products are added up with map-side combine, one row a model; a task solves each model's few equations.
    """
    keys = list(keys)
    rows = train.select(*keys, F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0))).alias("_x"), F.col("y").cast("double").alias("y"))
    pairs = rows.select(*keys, "_x", "y", F.posexplode("_x").alias("_i", "_a")).select(*keys, "_i", "_a", "y", F.posexplode("_x").alias("_j", "_b"))
    sums = pairs.groupBy(*keys, "_i", "_j").agg(F.sum(F.col("_a") * F.col("_b")).alias("_xx"), F.sum(F.when(F.col("_j") == 0, F.col("_a") * F.col("y"))).alias("_xy"))

    def run(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(first, table.num_rows)
        i, j, xx, xy = (groups.numbers(table, c) for c in ("_i", "_j", "_xx", "_xy"))
        found = []
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            d = int(i[a:z].max()) + 1
            m, v = np.zeros((d, d)), np.zeros(d)
            m[i[a:z].astype(int), j[a:z].astype(int)] = xx[a:z]
            v[i[a:z][j[a:z] == 0].astype(int)] = xy[a:z][j[a:z] == 0]
            found.append(np.linalg.lstsq(m + ridge * np.diag([*[1.0] * (d - 1), 0.0]), v, rcond=None)[0].tolist())
        columns = [table.column(k).take(pa.array(first)).combine_chunks() for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.float64()))], names=[*keys, "weights"])

    schema = ST.StructType([rows.schema[k] for k in keys] + [ST.StructField("weights", ST.ArrayType(ST.DoubleType()))])
    return groups.map_groups(sums, keys, run, schema)
