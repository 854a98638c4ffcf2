"""Model selection tables: grids, configurations to do, best configurations."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def grid(spark: SparkSession, parameters: dict[str, Sequence], fixed: dict | None = None) -> DataFrame:
    """One row for each combination of values, with the fixed ones added."""
    names = [*parameters, *(fixed or {})]
    rows = [(*values, *(fixed or {}).values()) for values in itertools.product(*parameters.values())]
    kind = {int: "int", float: "double", str: "string", bool: "boolean"}
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {kind[type(v)]}" for n, v in zip(names, rows[0], strict=True)))


def configs_to_do(all_: DataFrame, done: DataFrame, ignore: Sequence[str] = ("hash",)) -> DataFrame:
    """Configurations of the grid that were not run, whatever columns to ignore say."""
    cols = [c for c in all_.columns if c not in ignore]
    return all_.select(cols).exceptAll(done.select(cols).distinct())


def explode_results(df: DataFrame) -> DataFrame:
    """A row for each configuration of a selection row: the row's columns, idx (from 0), config, result."""
    z = F.arrays_zip(F.col("configs").alias("config"), F.col("results").alias("result"))
    return df.select("*", F.posexplode(z).alias("idx", "z")).select(*df.columns, F.col("idx").cast("long").alias("idx"), "z.config", "z.result")


def argmax(df: DataFrame, keys: Sequence[str], value: str, index: str) -> DataFrame:
    """The first row with the largest value of each group."""
    w = W.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), index)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_config(df: DataFrame) -> DataFrame:
    """``df`` with ``config``: that at idx_best, counted from 0."""
    return df.withColumn("config", F.element_at("configs", F.col("idx_best") + 1))


def drop_tied(df: DataFrame) -> DataFrame:
    """Without rows whose results are all equal."""
    return df.where(~F.forall("results", lambda r: r.eqNullSafe(F.element_at("results", 1))))


def distribution(df: DataFrame, keys: Sequence[str], config: str, top: int = 12) -> DataFrame:
    """keys.., config, n, share of its group; the ``top`` most frequent of each group."""
    n = df.groupBy(*keys, config).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    at = F.row_number().over(w.orderBy(F.desc("n"), config))
    return n.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_at", at).where(F.col("_at") <= top).drop("_at")


def best_per_metric(df: DataFrame, index: str, metrics: Sequence[str]) -> DataFrame:
    """metric, index, value: the first best configuration for each metric column."""
    long = df.unpivot(index, list(metrics), "metric", "value")
    return argmax(long, ["metric"], "value", index).select("metric", index, "value")
