"""Rankers that work on pairs of documents, or straight on NDCG, without a table of pairs: RankBoost and coordinate ascent.

RankBoost's weight of a pair is a product of one factor for each of its documents, so what a document counts for is its own
factor times the sum of the other grades' factors in its query, and the weight that a threshold ranker moves is a running sum
over documents' counts. A round is a few sums with map-side combine, whatever the number of pairs.

Coordinate ascent tries all steps along a feature, for all models and restarts, in one job: over rows times steps, or for one
model of some size over blocks of whole queries, whose tasks give sums only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.functions import vectors
from rankloom.operators import blocks, metrics
from rankloom.operators import trees as T
from rankloom.operators.dataset import dice
from rankloom.storage import cut


def _meet(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return rows.join(small, keys, how) if keys else rows.crossJoin(F.broadcast(small))


# -- RankBoost ----------------------------------------------------------------------------------------------------


def pair_counts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` (keys.., qid, y, h) with count: the weight of the pairs in which a document is the better one, less that of
    those in which it is the worse one; and better: the first of the two.

    A pair of a query weighs exp(h of the worse - h of the better).
    """
    by = [*keys, "qid"]
    grades = rows.groupBy(*by, "y").agg(F.sum(F.exp(-F.col("h"))).alias("_a"), F.sum(F.exp("h")).alias("_b"))
    order = W.partitionBy(*by).orderBy("y")
    below, above = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    other = grades.select(*by, "y", F.coalesce(F.sum("_b").over(below), F.lit(0.0)).alias("_below"), F.coalesce(F.sum("_a").over(above), F.lit(0.0)).alias("_above"))
    met = rows.join(other, [*by, "y"])
    better = F.exp(-F.col("h")) * F.col("_below")
    return met.withColumn("better", better).withColumn("count", F.col("better") - F.exp("h") * F.col("_above")).drop("_below", "_above")


def rankboost(train: DataFrame, rounds: int = 20, thresholds: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """keys.., round (from 1), feature, threshold, alpha: threshold rankers, which say 1 above the threshold.

    ``train``: keys.., qid, doc_id, y, features. A feature's thresholds cut its range into ``thresholds`` + 1 equal parts. A
    round takes the ranker that moves the largest share r of the pairs' weight, by size, to nine decimals, ties to the smaller
    feature and threshold; alpha is half the logarithm of (1 + r) / (1 - r). Models without pairs of different grades, or
    where no ranker moves weight, end. Keys and ids must not be null.
    """
    keys = list(keys)
    base = train.select(*keys, *[k for k in ("qid", "doc_id") if k not in keys], F.col("y").cast("double").alias("y"), "features")
    long = base.select(*keys, F.posexplode("features").alias("_f", "_v"))
    ends = long.groupBy(*keys, "_f").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / (thresholds + 1)
    at = F.transform(F.sequence(F.lit(1), F.lit(thresholds)), lambda i: F.col("_lo") + i * width)
    cuts = cut(ends.withColumn("_at", at).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_at"))), lambda e: e["_at"]).alias("_cuts")))
    # How many of a feature's thresholds a document is above; it doesn't change from round to round.
    above = F.transform("features", lambda v, i: F.size(F.filter(F.element_at("_cuts", i + 1), lambda t: t < v)))
    columns = [*keys, *[k for k in ("qid", "doc_id") if k not in keys], "y", "_ranks"]
    rows = cut(_meet(base, cuts, keys).withColumn("_ranks", above).select(*columns).withColumn("h", F.lit(0.0)))
    out = None
    for r in range(1, rounds + 1):
        counted = pair_counts(rows, keys)
        total = counted.groupBy(*keys).agg(F.sum("better").alias("_z")).where("_z > 0")
        each = counted.select(*keys, "count", F.posexplode("_ranks").alias("_f", "_k")).groupBy(*keys, "_f", "_k").agg(F.sum("count").alias("_s"))
        up = W.partitionBy(*keys, "_f").orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
        moved = each.withColumn("_r", F.sum("_s").over(up)).where("_k > 0")
        share = _meet(moved, total, keys).withColumn("_r", F.col("_r") / F.col("_z")).where("round(abs(_r), 9) > 0")
        # A document above its k-th threshold is above those before it: with _k of them, threshold number _k is the highest.
        first = share.groupBy(*keys).agg(F.min(F.struct((-F.round(F.abs("_r"), 9)).alias("_loss"), "_f", "_k", "_r")).alias("_x")).where("_x is not null")
        r_ = F.greatest(F.lit(-1 + 1e-9), F.least(F.lit(1 - 1e-9), F.col("_x._r")))
        best = cut(first.select(*keys, F.col("_x._f").alias("_f"), F.col("_x._k").alias("_k"), (F.lit(0.5) * F.log((1 + r_) / (1 - r_))).alias("alpha")))
        if best.isEmpty():
            break
        named = _meet(best, cuts, keys).select(*keys, F.lit(r).alias("round"), F.col("_f").cast("int").alias("feature"), F.col("_cuts")[F.col("_f")][F.col("_k") - 1].alias("threshold"), "alpha")
        out = cut(named) if out is None else out.unionByName(cut(named))
        says = F.when(F.element_at("_ranks", F.col("_f") + 1) >= F.col("_k"), F.col("alpha")).otherwise(0.0)
        rows = cut(_meet(rows, best, keys).select(*columns, (F.col("h") + says).alias("h")))
    return out if out is not None else _meet(cuts, cuts.select(*keys, F.lit(0).alias("round"), F.lit(0).alias("feature"), F.lit(0.0).alias("threshold"), F.lit(0.0).alias("alpha")), keys).drop("_cuts").limit(0)


def rankboost_scores(df: DataFrame, model: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """``df`` with the sum of the alphas of its model's rankers that say 1."""
    keys = list(keys)
    card = model.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("round", "feature", "threshold", "alpha"))).alias("_taken"))
    met = df.join(card, keys, "left") if keys else df.crossJoin(F.broadcast(card))
    says = lambda t: F.when(F.element_at("features", t["feature"] + 1) > t["threshold"], t["alpha"]).otherwise(0.0)
    return met.withColumn(score, F.aggregate("_taken", F.lit(0.0), lambda a, t: a + says(t))).drop("_taken")


# -- coordinate ascent --------------------------------------------------------------------------------------------


def steps(n: int, first: float) -> list[float]:
    """No step, and n steps either way, each twice as far as the one before."""
    return [0.0] + [s * first * 2**i for i in range(n) for s in (1, -1)]


def coordinate_ascent(train: DataFrame, sweeps: int = 2, restarts: int = 2, n_steps: int = 6, first: float = 0.05, k: int = 10, keys: Sequence[str] = (), cells: int = 100_000) -> DataFrame:
    """keys.., weights, ndcg: linear rankers by line search on mean NDCG@k, the best of their restarts.

    ``train``: keys.., qid, doc_id, y, features. The first start weighs all features alike, the others by a hash. A sweep goes
    through the features; for each it takes the step with the largest mean NDCG, to nine decimals, ties to the earlier of
    :func:`steps`, so the mean never falls. Keys and ids must not be null. One model of more than ``cells`` rows times features
    is searched over blocks of whole queries.
    """
    keys = list(keys)
    by = [*keys, "_start"]
    base = cut(train.select(*keys, *[c for c in ("qid", "doc_id") if c not in keys], F.col("y").cast("double").alias("y"), "features"))
    d = base.agg(F.max(F.size("features"))).first()[0] or 0
    names = base.select(*keys).distinct() if keys else base.sparkSession.range(1).select()
    starts = names.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    salt = lambda i: F.conv(F.substring(dice(*by, salt=f"w{i}"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = F.array(*[F.when(F.col("_start") == 0, F.lit(1.0 / d)).otherwise(salt(i)) for i in range(d)])
    weights = cut(starts.withColumn("weights", weight))
    if not keys and (size := base.agg(F.sum(F.size("features"))).first()[0]) and size > cells and (same := blocks.whole_lists(base, T.CELLS)):
        return _ascent_over_blocks(base, same, weights, sweeps, steps(n_steps, first), k)
    tried = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(v).alias("_by")) for i, v in enumerate(steps(n_steps, first))])
    best = None
    for _ in range(sweeps):
        for i in range(d):
            scored = _meet(base, weights, keys).select(*by, *[c for c in ("qid", "doc_id") if c not in keys], "y", vectors.dot(F.col("features"), F.col("weights")).alias("_s"), F.col("features")[i].alias("_x"), F.explode(tried).alias("_t"))
            each = scored.select(*by, *[c for c in ("qid", "doc_id") if c not in keys], "y", "_t._i", F.round(F.col("_s") + F.col("_t._by") * F.col("_x"), 9).alias("_score"))
            mean = metrics.ndcg(each, "_score", k, [*by, "_i", "qid"]).groupBy(*by, "_i").agg(F.round(F.avg("ndcg"), 9).alias("_m"))
            best = cut(mean.groupBy(*by).agg(F.min(F.struct((-F.col("_m")).alias("_loss"), "_i")).alias("_b")).select(*by, F.col("_b._i").alias("_i"), (-F.col("_b._loss")).alias("ndcg")))
            by_ = F.element_at(F.transform(tried, lambda t: t["_by"]), F.col("_i") + 1)
            weights = cut(weights.join(best.drop("ndcg"), by).select(*by, F.transform("weights", lambda w, j: F.when(j == i, w + by_).otherwise(w)).alias("weights")))
    met = weights.join(best.drop("_i"), by)
    one = F.min(F.struct((-F.col("ndcg")).alias("_loss"), "_start", "weights")).alias("_b")
    return cut(met.groupBy(*keys).agg(one).select(*keys, F.col("_b.weights").alias("weights"), (-F.col("_b._loss")).alias("ndcg")))


def _ascent_over_blocks(base: DataFrame, d: int, starts: DataFrame, sweeps: int, tried: list[float], k: int) -> DataFrame:
    """The same search for one model: tasks try all steps of all starts on blocks of whole queries, and give sums of NDCG."""
    state = blocks.lists(base)
    w = np.array([r["weights"] for r in starts.orderBy("_start").collect()])
    best = np.zeros(len(w))
    for _ in range(sweeps):
        for i in range(d):

            def run(batches: Iterator[pa.RecordBatch], w=w.copy(), i=i) -> Iterator[pa.RecordBatch]:
                sums, n = np.zeros((len(w), len(tried))), 0
                for x, y, first in blocks.read_lists(batches, d):
                    ideal, n = metrics.ideal_of(y, first, k), n + len(first)
                    for a in range(len(w)):
                        s = np.zeros(len(x))
                        for j in range(d):
                            s = s + x[:, j] * w[a, j]
                        for b, by in enumerate(tried):
                            sums[a, b] += metrics.ndcg_of(np.round(s + by * x[:, i], 9), first, y, ideal, k).sum()
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "m"])

            parts = state.mapInArrow(run, "n long, m array<double>").collect()
            mean = np.round(np.sum([r["m"] for r in parts], axis=0).reshape(len(w), -1) / sum(r["n"] for r in parts), 9)
            taken = np.argmax(mean, axis=1)
            best = mean[np.arange(len(w)), taken]
            w[:, i] += np.array(tried)[taken]
    one = min(range(len(w)), key=lambda a: (-best[a], a))
    return base.sparkSession.createDataFrame([(w[one].tolist(), float(best[one]))], "weights array<double>, ndcg double")


def linear_scores(df: DataFrame, model: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """``df`` with its features times its model's weights."""
    keys = list(keys)
    met = df.join(model.select(*keys, F.col("weights").alias("_w")), keys, "left") if keys else df.crossJoin(F.broadcast(model.select(F.col("weights").alias("_w"))))
    return met.withColumn(score, vectors.dot(F.col("features"), F.col("_w"))).drop("_w")
