"""Experiment analytics: configuration tables, block summaries, matched main effects, pivots and deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def config_table(results: DataFrame, configs: Sequence[str]) -> DataFrame:
    """dataset, model, config columns, ndcg (mean), ndcg_std (sample), n_queries, from one row a query and configuration.

    Null configuration values form groups of their own.
    """
    return results.groupBy("dataset", "model", *configs).agg(F.avg("ndcg").alias("ndcg"), F.stddev_samp("ndcg").alias("ndcg_std"), F.count("ndcg").alias("n_queries"))


def centred(table: DataFrame) -> DataFrame:
    """With ndcg_centered (minus the mean) and regret (minus the best) of the dataset and model."""
    w = W.partitionBy("dataset", "model")
    return table.withColumn("ndcg_centered", F.col("ndcg") - F.avg("ndcg").over(w)).withColumn("regret", F.col("ndcg") - F.max("ndcg").over(w))


def active_features(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, levels: those with more than one level, null counted as a level."""
    counts = table.agg(*[(F.countDistinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f) for f in features])
    return counts.unpivot([], list(features), "feature", "levels").where("levels > 1")


def summarise_blocks(rows: DataFrame, items: Sequence[str], value: str, blocks: Sequence[str]) -> DataFrame:
    """Items with blocks weighted equally: mean, median, std, se, ci95 over block means; n_blocks, n_matches."""
    items = list(items)
    per = rows.groupBy(*items, *blocks).agg(F.avg(value).alias("v"), F.count("*").alias("_n"))
    out = per.groupBy(*items).agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.count("v").alias("n_blocks"), F.sum("_n").cast("long").alias("n_matches"))
    se = F.col("std") / F.sqrt(F.greatest("n_blocks", F.lit(1)))
    return out.withColumn("se", se).withColumn("ci95", 1.96 * F.col("se"))


def effects(table: DataFrame, features: Sequence[str], context: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """A row for each feature and setting of all others: effect_range, directional_effect, n_levels, best and worst level.

    Levels are ordered by their own type (false before true, numbers by size, text by letters). Settings where fewer than
    two levels were run give no row. The loop is over feature names only.
    """
    out = None
    for f in features:
        rest = [*context, *[g for g in features if g != f]]
        level = table.where(F.col("ndcg").isNotNull()).groupBy(*rest, f).agg(F.avg("ndcg").alias("v"))
        known = F.col(f).isNotNull()
        hi, lo = F.max_by(F.when(known, F.col("v")), F.when(known, F.col(f))), F.min_by(F.when(known, F.col("v")), F.when(known, F.col(f)))
        first = lambda d: F.sort_array(F.collect_list(F.struct((d * F.col("v")).alias("s"), F.col(f).cast("string").alias("level"))))[0]["level"]
        row = level.groupBy(*rest).agg((F.max("v") - F.min("v")).alias("effect_range"), F.when(F.count(f) > 1, hi - lo).alias("directional_effect"), F.count("*").alias("n_levels"), first(F.lit(-1.0)).alias("best_level"), first(F.lit(1.0)).alias("worst_level"))
        row = row.where("n_levels > 1").select(*context, F.lit(f).alias("feature"), "effect_range", "directional_effect", "n_levels", "best_level", "worst_level")
        out = row if out is None else out.unionByName(row)
    return out


def main_effects(table: DataFrame, features: Sequence[str], context: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Impact and direction of each feature, summarised over blocks."""
    rows = effects(table, features, context)
    impact = summarise_blocks(rows, ["feature"], "effect_range", context)
    signed = summarise_blocks(rows.where("directional_effect is not null"), ["feature"], "directional_effect", context)
    signed = signed.select("feature", F.col("mean").alias("mean_direction"), F.col("median").alias("median_direction"), F.col("ci95").alias("ci95_direction"), F.col("n_blocks").alias("n_direction_blocks"), F.col("n_matches").alias("n_direction_matches"))
    return impact.join(signed, "feature", "left")


def ordered_levels(table: DataFrame, feature: str) -> DataFrame:
    """level, place: the non-null levels in their type's order; booleans have false first."""
    levels = table.select(F.col(feature).alias("level")).where("level is not null").distinct()
    return levels.withColumn("place", F.row_number().over(W.orderBy("level")).cast("long"))


def best_worst(summary: DataFrame, by: Sequence[str], level: str, value: str) -> DataFrame:
    """by.., best, worst: levels with the largest and smallest mean, ties to the smaller level."""
    pick = lambda d: F.sort_array(F.collect_list(F.struct((d * F.col(value)).alias("v"), F.col(level).alias("l"))))[0]["l"]
    return summary.groupBy(*by).agg(pick(F.lit(-1.0)).alias("best"), pick(F.lit(1.0)).alias("worst"))


def is_best(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.withColumn("is_best", F.max(value).over(W.partitionBy(*keys)) == F.col(value))


def pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """One column for each listed value; listing them saves a pass over the data."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(value))


def baseline_delta(df: DataFrame, baseline: str, keys: Sequence[str] = ("dataset", "qxm")) -> DataFrame:
    """Other models with delta: their mean minus the baseline model's."""
    base = df.where(F.col("model") == baseline).select(*keys, F.col("mean").alias("_b"))
    return df.where(F.col("model") != baseline).join(base, list(keys), "left").withColumn("delta", F.col("mean") - F.col("_b")).drop("_b")


def latex_table(df: DataFrame, index: str, columns: Sequence[str]) -> str:
    """A small result table as LaTeX rows; cells are formatted already."""
    lines = [" & ".join([str(r[index]), *[str(r[c]) if r[c] is not None else "" for c in columns]]) + r" \\" for r in df.orderBy(index).collect()]
    head = " & ".join([index, *columns]) + r" \\"
    return "\n".join([r"\begin{tabular}{l" + "r" * len(columns) + "}", head, r"\hline", *lines, r"\end{tabular}"])
