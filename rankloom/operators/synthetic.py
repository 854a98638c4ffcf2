"""Synthetic ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.binning import equal_width
from rankloom.functions.vectors import total
from rankloom.operators.baselines import random_normal


def target(x: Column, weights: Sequence[float]) -> Column:
    """2.5 linear + 0.2 products of neighbours + 0.5 (sin of the first, cos of the second) + 0.1 exp(-squared length)."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    linear = total(F.zip_with(x, w, lambda a, b: a * b))
    near = total(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: a * b))
    waves = F.sin(x[0]) + F.cos(x[1])
    local = F.exp(-total(F.transform(x, lambda a: a * a)))
    return F.lit(2.5) * linear + F.lit(0.2) * near + F.lit(0.5) * waves + F.lit(0.1) * local


def generate(spark: SparkSession, queries: int, docs: int, features: int, grades: int = 5, noise: float = 2.0, seed: str = "g") -> DataFrame:
    """qid, doc_id, y (grade by equal widths), features: normal features, the target above plus noise. Reruns agree."""
    rows = spark.range(queries * docs).select((F.col("id") / docs).cast("long").alias("qid"), (F.col("id") % docs).alias("doc_id"))
    x = rows.withColumn("features", F.array(*[random_normal(f"{seed}{i}") for i in range(features)]))
    weights = [(-1) ** i / (i + 1) for i in range(features)]
    raw = x.withColumn("raw", target(F.col("features"), weights) + random_normal(f"{seed}e", 0.0, noise))
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return raw.crossJoin(F.broadcast(ends)).select("qid", "doc_id", equal_width(F.col("raw"), F.col("lo"), F.col("hi"), grades).cast("double").alias("y"), "features")


def hidden_linear(spark: SparkSession, queries: int = 36, docs: int = 12, features: int = 6, seed: str = "h") -> DataFrame:
    """qid, doc_id, linear_score, true_rank, relevance, features: lists ranked by a hidden linear score, graded by rank. Reruns agree."""
    from rankloom.functions.vectors import dot
    from rankloom.operators.dataset import rank_grades

    rows = spark.range(queries * docs).select((F.col("id") / docs).cast("long").alias("qid"), (F.col("id") % docs).alias("doc_id"))
    x = rows.withColumn("features", F.array(*[random_normal(f"{seed}{i}") for i in range(features)]))
    hidden = F.array(*[F.lit((-1) ** i * (features - i) / features) for i in range(features)])
    scored = x.withColumn("linear_score", dot(F.col("features"), hidden))
    return rank_grades(scored, "linear_score").select("qid", "doc_id", "linear_score", "true_rank", "relevance", "features")
