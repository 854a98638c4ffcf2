"""Ranking and regression metrics. NDCG averages gains over tied scores, as leaf scores tie often."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ndcg(df: DataFrame, score: str, k: int | Sequence[int] = 10, keys: Sequence[str] = ("qid",), label: str = "y") -> DataFrame:
    """keys.., k, n, ndcg: linear gains over log2 discounts; one document counts 1, no relevant document 0.

    Several cutoffs share one pass over the data. A null score ranks last.
    """
    cutoffs = [k] if isinstance(k, int) else list(k)
    by = list(keys)
    w = W.partitionBy(*by)
    ranked = df.select(*by, F.col(label).alias("_y"), F.col(score).alias("_s")).withColumn("_rn", F.row_number().over(w.orderBy(F.col("_s").desc_nulls_last(), F.desc("_y")))).withColumn("_irn", F.row_number().over(w.orderBy(F.desc("_y"))))
    gain = lambda rn, c: F.when(F.col(rn) <= c, F.log(F.lit(2.0)) / F.log(F.col(rn) + 1.0)).otherwise(0.0)
    ties = ranked.groupBy(*by, "_s").agg(F.count("*").alias("_n"), F.avg("_y").alias("_avg"), *[F.sum(gain("_rn", c)).alias(f"_g{c}") for c in cutoffs], *[F.sum(F.col("_y") * gain("_irn", c)).alias(f"_i{c}") for c in cutoffs])
    lists = ties.groupBy(*by).agg(F.sum("_n").alias("n"), *[F.sum(F.col("_avg") * F.col(f"_g{c}")).alias(f"_d{c}") for c in cutoffs], *[F.sum(f"_i{c}").alias(f"_i{c}") for c in cutoffs])
    value = lambda c: F.when(F.col("n") == 1, 1.0).when(F.col(f"_i{c}") == 0, 0.0).otherwise(F.try_divide(f"_d{c}", f"_i{c}"))
    each = F.array(*[F.struct(F.lit(c).cast("long").alias("k"), value(c).alias("ndcg")) for c in cutoffs])
    return lists.select(*by, "n", F.explode(each).alias("_e")).select(*by, "_e.k", "n", "_e.ndcg")


def ideal_of(y: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The ideal DCG@k of each list; lists begin at ``first``."""
    n = np.diff(np.append(first, len(y)))
    owner = np.repeat(np.arange(len(first)), n)
    place = np.arange(len(y)) - np.repeat(first, n)
    return np.bincount(owner, y[np.lexsort((-y, owner))] * np.where(place < k, 1 / np.log2(place + 2), 0.0), len(first))


def ndcg_of(s: np.ndarray, first: np.ndarray, y: np.ndarray, ideal: np.ndarray, k: int) -> np.ndarray:
    """:func:`ndcg` of each list inside a task, for scores that are numbers."""
    n = np.diff(np.append(first, len(y)))
    owner = np.repeat(np.arange(len(first)), n)
    order = np.lexsort((-s, owner))
    place = np.arange(len(y)) - np.repeat(first, n)
    gain = np.where(place < k, 1 / np.log2(place + 2), 0.0)
    ranked = s[order]
    tie = np.flatnonzero(np.append(True, (ranked[1:] != ranked[:-1]) | (owner[1:] != owner[:-1])))
    size = np.diff(np.append(tie, len(y)))
    reached = np.bincount(owner[tie], np.add.reduceat(y[order], tie) / size * np.add.reduceat(gain, tie), len(first))
    return np.where(n == 1, 1.0, np.divide(reached, ideal, out=np.zeros(len(first)), where=ideal != 0))


def summary(per_query: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """mean, population std and median of ndcg."""
    return per_query.groupBy(*keys).agg(F.avg("ndcg").alias("mean"), F.stddev_pop("ndcg").alias("std"), F.percentile("ndcg", F.lit(0.5)).alias("median"))


def trimmed(per_query: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Queries whose ndcg lies between two percentiles, both ends included (to 1e-9, for sums in another order)."""
    cut = per_query.agg(F.percentile("ndcg", F.lit(low)).alias("_lo"), F.percentile("ndcg", F.lit(high)).alias("_hi"))
    return per_query.crossJoin(F.broadcast(cut)).where("ndcg >= _lo - 1e-9 and ndcg <= _hi + 1e-9").drop("_lo", "_hi")


def log_weighted(per_query: DataFrame) -> DataFrame:
    """weighted (the weights' share times ndcg, averaged once more) and weighted_mean (the sum, a true weighted mean)."""
    w = F.log1p(F.col("n"))
    return per_query.agg((F.sum(w * F.col("ndcg")) / F.sum(w) / F.count("*")).alias("weighted"), (F.sum(w * F.col("ndcg")) / F.sum(w)).alias("weighted_mean"))


def comparison(df: DataFrame, scores: Sequence[str], cutoffs: Sequence[int]) -> DataFrame:
    """model, k, mean, std, median for each score column."""
    out = None
    for s in scores:
        part = summary(ndcg(df, s, cutoffs), ["k"]).withColumn("model", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out.select("model", "k", "mean", "std", "median")


def mae_r2(df: DataFrame, prediction: str, label: str = "y") -> DataFrame:
    """Mean absolute error and coefficient of determination."""
    mean = df.agg(F.avg(label).alias("_m"))
    e = F.col(label) - F.col(prediction)
    return df.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(e)).alias("mae"), (F.lit(1.0) - F.sum(e * e) / F.sum((F.col(label) - F.col("_m")) * (F.col(label) - F.col("_m")))).alias("r2"))
