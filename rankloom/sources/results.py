"""Experiment results as JSON and CSV, and fitted rankers as Parquet."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.rtr import Config, Ranker
from rankloom.operators.rulecard import CardConfig

SELECTION = "qxm int, query array<bigint>, configs array<struct<{fields}>>, idx_best int, results array<double>"


def read_selection(spark: SparkSession, path: str, config: str, multi_line: bool = True) -> DataFrame:
    """Model-selection rows: qxm, query, configs (structs of the fields in ``config``), idx_best, results."""
    return spark.read.schema(SELECTION.format(fields=config)).json(path, multiLine=multi_line)


def read_best_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """qxm, eval_k, and the three parts of result as train, valid, test; by qxm, largest cutoff first."""
    raw = spark.read.schema("qxm int, eval_k int, result array<double>").json(path, multiLine=multi_line)
    part = lambda i: F.try_element_at("result", F.lit(i))
    return raw.select("qxm", "eval_k", part(1).alias("train"), part(2).alias("valid"), part(3).alias("test")).orderBy("qxm", F.desc("eval_k"))


def config_results(selection: DataFrame, dataset: str, model: str) -> DataFrame:
    """A row for each query group and configuration: dataset, model, the configuration's fields, ndcg."""
    z = F.explode(F.arrays_zip(F.col("configs").alias("c"), F.col("results").alias("ndcg"))).alias("z")
    return selection.select("qxm", "query", z).select(F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), "qxm", "query", "z.c.*", "z.ndcg")


def query_configs(selection: DataFrame) -> DataFrame:
    """qxm, groups: the query groups of each size with their best configurations."""
    best = selection.select("qxm", F.struct("query", F.element_at("configs", F.col("idx_best") + 1).alias("config")).alias("g"))
    return best.groupBy("qxm").agg(F.sort_array(F.collect_list("g")).alias("groups"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; a later run replaces an earlier one."""
    df.write.mode("overwrite").csv(path, header=True)


def save_ranker(ranker: Ranker, path: str) -> None:
    """Trees, leaf rows and distance trees as Parquet, settings as JSON."""
    spark = ranker.trees.sparkSession
    ranker.trees.write.mode("overwrite").parquet(f"{path}/trees")
    ranker.store.write.mode("overwrite").parquet(f"{path}/store")
    if ranker.distances is not None:
        ranker.distances.write.mode("overwrite").parquet(f"{path}/distances")
    said = {"config": dataclasses.asdict(ranker.config), "keys": ranker.keys, "leaf_keys": ranker.leaf_keys, "distances": ranker.distances is not None}
    spark.createDataFrame([(json.dumps(said),)], T.StructType([T.StructField("value", T.StringType())])).write.mode("overwrite").text(f"{path}/settings")


def load_ranker(spark: SparkSession, path: str) -> Ranker:
    said = json.loads(spark.read.text(f"{path}/settings").first()[0])
    config = said["config"] | {"use": tuple(said["config"]["use"]), "card": CardConfig(**said["config"]["card"]) if said["config"].get("card") else None}
    distances = spark.read.parquet(f"{path}/distances") if said["distances"] else None
    return Ranker(Config(**config), said["keys"], spark.read.parquet(f"{path}/trees"), spark.read.parquet(f"{path}/store"), distances, said["leaf_keys"])


def log_row(df: DataFrame, config: dict, columns: Sequence[str] = ()) -> DataFrame:
    """``df`` with the configuration's values as columns named conf_..."""
    return df.select(*(columns or df.columns), *[F.lit(v).alias(f"conf_{k}") for k, v in config.items()])
