"""Two-stage rule rankers: a shallow tree's score, plus the mean residual of the nearest neighbours in its leaf.

The nearest are found under a learned pairwise distance (a tree over pair features), or plain Euclid. All models of a
table are fitted together: the model is a column. The mixed variant looks for neighbours of the same query only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from rankloom.functions import vectors
from rankloom.operators import groups
from rankloom.operators import neighbours as N
from rankloom.operators import pairs as P
from rankloom.operators import rulecard as C
from rankloom.operators import trees as T
from rankloom.storage import cut


@dataclass(frozen=True)
class Config:
    """Settings of a ranker. objective: residuals, y or dist; distance None is Euclid; mixed: neighbours within the query;
    card: the learned distance is a rule card of these settings instead of one tree."""

    depth: int = 2
    distance_depth: int | None = 2
    k: int = 5
    subsample: float | int = 0.5
    use: tuple[str, ...] = ("pair", "abs_diff")
    objective: str = "residuals"
    mixed: bool = False
    min_split: int = 2
    max_leaves: int | None = None
    card: C.CardConfig | None = None

    @property
    def learned(self) -> bool:
        return self.distance_depth is not None or self.card is not None

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def pair_target(objective: str) -> Column:
    """Squared difference of residuals or labels, or squared Euclid of the features, of a pair (a, b)."""
    if objective == "dist":
        return vectors.squared_euclid(F.col("features_a"), F.col("features_b"))
    z = {"residuals": "value", "y": "y"}[objective]
    return F.pow(F.col(f"{z}_a") - F.col(f"{z}_b"), 2)


@dataclass
class Ranker:
    """A fitted ranker: stage-1 trees, the leaves' training rows, and the distance trees (None for Euclid)."""

    config: Config
    keys: list[str]
    trees: DataFrame
    store: DataFrame
    distances: DataFrame | None
    leaf_keys: list[str] = field(default_factory=list)

    def stage1(self, df: DataFrame) -> DataFrame:
        return T.apply(df, self.trees, self.keys)

    def measured(self, df: DataFrame) -> DataFrame:
        """Each row of ``df`` (with leaf and score) with its k nearest training rows of its leaf by a rule card's distance:
        neighbour, value, d, rank. The product of both is made, and the card joins on its keys."""
        own = [c for c in ("qid", "doc_id") if c not in self.leaf_keys]
        named = [] if "qid" in self.leaf_keys else ["neighbour_qid"]
        train = self.store.select(*self.leaf_keys, *[F.col("qid").alias(c) for c in named], F.col("doc_id").alias("neighbour"), F.col("features").alias("_g"), "value")
        met = df.select(*self.leaf_keys, *own, F.col("features").alias("_f")).join(train, self.leaf_keys)
        by = list(dict.fromkeys([*self.leaf_keys, "qid", "doc_id"]))
        width = self.store.select(F.size("features").alias("d")).first()
        met = met.withColumn("features", vectors.pair_features(F.col("_f"), F.col("_g"), self.config.use))
        met = C.predict(met, self.distances, self.pair_keys, width["d"] if width else 0).withColumnRenamed("distance", "d")
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.round("d", 9), *named, "neighbour")).cast("long")
        return met.select(*by, *named, "neighbour", "value", "d").withColumn("rank", rank).where(F.col("rank") <= self.config.k)

    def neighbours(self, df: DataFrame, euclid: bool = False) -> DataFrame:
        """The k nearest training rows of each row of ``df`` (with leaf and score): neighbour, value, d, rank, and pair_leaf
        by a learned tree."""
        if euclid or self.distances is None:
            return N.nearest(df, self.store, self.leaf_keys, self.config.k)
        if self.config.card is not None:
            return self.measured(df)
        return N.nearest(df, self.store, self.leaf_keys, self.config.k, T.compact(self.distances, self.pair_keys), self.config.use)

    @property
    def pair_keys(self) -> list[str]:
        return self.leaf_keys

    def predict_each(self, df: DataFrame, ks: Sequence[int]) -> DataFrame:
        """``df`` with leaf, score and full_<k> for each number of neighbours up to the configuration's: ranked once."""
        base = cut(self.stage1(df))
        by = list(dict.fromkeys([*self.keys, "qid", "doc_id"]))
        means = self.neighbours(base).groupBy(*by).agg(*[F.avg(F.when(F.col("rank") <= k, F.col("value"))).alias(f"_{k}") for k in dict.fromkeys(ks)])
        out = base.join(means, by, "left")
        return out.withColumns({f"full_{k}": F.col("score") + F.coalesce(f"_{k}", F.lit(0.0)) for k in ks}).drop(*[f"_{k}" for k in ks])

    def predict(self, df: DataFrame, euclid: bool = True) -> DataFrame:
        """``df`` with leaf, score, correction, full, and with ``euclid`` also euclid: score plus the Euclid correction.

        A row whose leaf (or leaf and query) has no training rows keeps its score: the correction is 0.
        """
        base = cut(self.stage1(df))
        by = list(dict.fromkeys([*self.keys, "qid", "doc_id"]))

        mean = lambda near, name: near.groupBy(*by).agg(F.avg("value").alias(name))
        out = base.join(mean(self.neighbours(base), "correction"), by, "left").withColumn("correction", F.coalesce("correction", F.lit(0.0)))
        if euclid and self.distances is None:
            out = out.withColumn("euclid", F.col("score") + F.col("correction"))
        elif euclid:
            out = out.join(mean(self.neighbours(base, euclid=True), "_e"), by, "left").withColumn("euclid", F.col("score") + F.coalesce("_e", F.lit(0.0))).drop("_e")
        return out.withColumn("full", F.col("score") + F.col("correction"))


def _learn(store: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """keys.., features, target of the pairs that a distance is learned from."""
    met = P.pairs(store, keys, config.subsample)
    return met.select(*keys, vectors.pair_features(F.col("features_a"), F.col("features_b"), config.use).alias("features"), pair_target(config.objective).alias("target"))


def _distance_trees(store: DataFrame, keys: list[str], config: Config, cells: int = T.CELLS) -> DataFrame:
    """The trees of :func:`_learn`'s pairs. Groups of up to ``cells`` pairs times features are paired inside tasks, which get
    the sides only; larger ones as a table of pairs."""
    known = F.lit(True)
    for c in keys:
        known &= F.col(c).isNotNull()
    store = store.where(known)
    sides = [F.col(c).alias(c) for c in dict.fromkeys([*keys, "qid", "doc_id", "features"])]
    z = {"residuals": "value", "y": "y"}.get(config.objective)
    each = P.tree_size(F.count("*"), config.subsample)
    width = F.max(F.size("features")) * sum({"pair": 2}.get(u, 1) for u in config.use)
    large = cut(store.groupBy(*keys).agg((each * each * width).alias("_size")).where(F.col("_size") > cells).select(*keys))
    few, many = (store, None) if large.isEmpty() else (store.join(large, keys, "left_anti"), store.join(large, keys, "left_semi"))
    parts = [P.subsample(few, keys, config.subsample, s).select(*sides, F.col(z).cast("double").alias("_z") if z else F.lit(0.0).alias("_z"), F.lit(i).alias("_side")) for i, s in enumerate("ab")]
    schema = ST.StructType([store.schema[k] for k in keys] + [ST.StructField("node", ST.LongType()), ST.StructField("feature", ST.IntegerType()), ST.StructField("threshold", ST.DoubleType()), ST.StructField("prediction", ST.DoubleType()), ST.StructField("n", ST.LongType())])
    order = ["_side", *[c for c in ("qid", "doc_id") if c not in keys]]
    out = groups.map_groups(parts[0].unionByName(parts[1]), keys, _paired(keys, config, z is None), schema, order)
    if many is not None:
        out = out.unionByName(T.grow(_learn(many, keys, config), keys, config.distance_depth, cells=cells).select(*schema.names))
    return T.finished(out, keys)


#: Pairs times features that trees grow on at once.
AT_ONCE = 400_000


def _paired(keys: list[str], config: Config, dist: bool):
    depth, use = config.distance_depth, config.use

    def run(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, z, side = groups.matrix(table, "features"), groups.numbers(table, "_z"), groups.numbers(table, "_side")
        ends, held, size = [*first[1:].tolist(), table.num_rows], [], 0
        for i, (lo, hi) in enumerate(zip(first.tolist(), ends, strict=True)):
            mid = lo + int(np.count_nonzero(side[lo:hi] == 0))
            if lo < mid < hi:
                a, b = x[lo:mid], x[mid:hi]
                shape = (mid - lo, hi - mid)
                columns = [np.broadcast_to(c, shape).ravel() for c in N.pair_columns(a, b, use)]
                target = sum(np.square(a[:, f : f + 1] - b[None, :, f]) for f in range(x.shape[1])) if dist else np.square(z[lo:mid, None] - z[None, mid:hi])
                held.append((lo, np.column_stack(columns), target.ravel()))
                size += held[-1][1].size
            if held and (size >= AT_ONCE or i + 1 == len(ends)):
                model = np.repeat(np.arange(len(held)), [len(t) for _, _, t in held])
                t = np.concatenate([t for _, _, t in held])
                found, _ = T.grow_arrays(np.concatenate([c for _, c, _ in held]), t, np.ones(len(t)), model, depth)
                at, inner = pa.array(np.array([lo for lo, _, _ in held])[found["model"]]), found["feature"] >= 0
                out = [table.column(k).take(at).combine_chunks() for k in keys]
                out += [pa.array(found["node"]), pa.array(found["feature"].astype(np.int32), mask=~inner), pa.array(found["threshold"], mask=~inner), pa.array(found["prediction"]), pa.array(found["n"])]
                yield pa.RecordBatch.from_arrays(out, names=[*keys, "node", "feature", "threshold", "prediction", "n"])
                held, size = [], 0

    return run


def stage_one(config: Config) -> tuple:
    """The settings that stage one hangs on: rankers of the same rows that share them have the same trees and training rows."""
    return config.depth, config.min_split, config.max_leaves


def fit(train: DataFrame, config: Config, keys: Sequence[str] = ("model_key",), first: Ranker | None = None) -> Ranker:
    """Fit all models of ``train`` (keys.., qid, doc_id, y, features); ``first``: a ranker of the same rows and keys with the
    same :func:`stage_one`, whose trees and training rows are taken."""
    keys = list(keys)
    if first is not None:
        trees, store = first.trees, first.store
    else:
        trees = T.grow(train.withColumnRenamed("y", "target"), keys, config.depth, min_split=config.min_split, max_leaves=config.max_leaves)
        store = cut(T.apply(train, trees, keys).withColumn("value", F.col("y") - F.col("score")))
    leaf_keys = [*keys, "leaf", *(["qid"] if config.mixed and "qid" not in keys else [])]
    distances = None
    if config.learned:
        if config.card is not None and "pair" not in config.use:
            raise ValueError("a rule card's distance needs both rows among the pair features")
        slim = store.select(*dict.fromkeys([*leaf_keys, "qid", "doc_id", "y", "features", "value"]))
        distances = _distance_trees(slim, leaf_keys, config) if config.card is None else C.fit(_learn(slim, leaf_keys, config), leaf_keys, config.card)
    return Ranker(config, keys, trees, store, distances, leaf_keys)


def dispatch(df: DataFrame, batches: DataFrame) -> DataFrame:
    """``df`` with the model_key of its query's batch (qid, batch); queries without a model are an error."""
    if df.join(batches, "qid", "left_anti").limit(1).count():
        raise ValueError("queries without a model")
    return df.join(batches.select("qid", F.col("batch").alias("model_key")), "qid")


def explain(ranker: Ranker, df: DataFrame) -> DataFrame:
    """A row for each row of ``df``: shallow_score, shallow_path, rule_shallow, correction, and its neighbours with their
    values, distances and pair leaves, nearest first."""
    base = cut(ranker.stage1(df))
    by = list(dict.fromkeys([*ranker.keys, "qid", "doc_id"]))
    near = ranker.neighbours(base)
    cells = F.struct("rank", "neighbour", "value", "d", *(["pair_leaf"] if ranker.distances is not None and ranker.config.card is None else []))
    grouped = near.groupBy(*by).agg(F.sort_array(F.collect_list(cells)).alias("neighbours"), F.avg("value").alias("correction"))
    rules = T.decision_path(base.select(*by, "leaf"), ranker.trees, ranker.keys).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "rule"))), lambda s: s["rule"]).alias("rule_shallow"))
    out = base.join(grouped, by, "left").join(rules, by, "left")
    return out.select(*by, F.col("score").alias("shallow_score"), F.col("leaf").alias("shallow_path"), F.coalesce("rule_shallow", F.array().cast("array<string>")).alias("rule_shallow"), F.coalesce("correction", F.lit(0.0)).alias("correction"), "neighbours")
