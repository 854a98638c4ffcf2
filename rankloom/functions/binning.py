"""Binning: equal width over a whole column, and quantile cuts as numpy and pandas place them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def equal_width(y: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0 to ``bins`` - 1 of equal widths from low to high; the highest value is in the last bin, and so is a constant."""
    return F.when(high == low, F.lit(bins - 1)).otherwise(F.least(F.floor(F.lit(float(bins)) * (y - low) / (high - low)), F.lit(bins - 1))).cast("long")


def quantile_edges(df: DataFrame, by: Sequence[str], y: str, most: int) -> DataFrame:
    """Distinct inner edges of the quantile cut of ``y`` into least(most, distinct values) parts, by group: by.., edge.

    Positions are ``i * (1 / k)`` of the way through the sorted values, interpolated from the nearer side.
    """
    by = list(by)
    keys = [F.col(c) for c in by]
    order = W.partitionBy(*keys).orderBy(y) if keys else W.orderBy(y)
    ranked = df.select(*keys, F.col(y).alias("_y"), (F.row_number().over(order) - 1).alias("_at"))
    sizes = df.groupBy(*keys).agg(F.least(F.lit(most), F.countDistinct(y)).alias("_k"), F.count(y).alias("_n"))
    steps = sizes.select(*keys, "_k", "_n", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_i"))
    share = F.when(F.col("_i") == F.col("_k"), F.lit(1.0)).otherwise(F.col("_i").cast("double") * (F.lit(1.0) / F.col("_k").cast("double")))
    h = share * F.lit(100.0) / F.lit(100.0) * (F.col("_n") - 1).cast("double")
    at = steps.withColumn("_h", h).withColumn("_lo", F.floor("_h")).withColumn("_hi", F.least(F.floor("_h") + 1, F.col("_n") - 1))
    lo = ranked.select(*keys, F.col("_at").cast("long").alias("_lo"), F.col("_y").alias("_a"))
    hi = ranked.select(*keys, F.col("_at").cast("long").alias("_hi"), F.col("_y").alias("_b"))
    both = at.join(lo, [*by, "_lo"]).join(hi, [*by, "_hi"])
    t = F.col("_h") - F.floor("_h")
    edge = F.when(t < 0.5, F.col("_a") + (F.col("_b") - F.col("_a")) * t).otherwise(F.col("_b") - (F.col("_b") - F.col("_a")) * (F.lit(1.0) - t))
    distinct = both.select(*keys, edge.alias("edge")).distinct()
    ends = W.partitionBy(*keys)
    return distinct.withColumn("_low", F.min("edge").over(ends)).withColumn("_high", F.max("edge").over(ends)).where("edge > _low and edge < _high").select(*keys, "edge")


def quantile_cut(df: DataFrame, by: Sequence[str], y: str, most: int, out: str = "bin") -> DataFrame:
    """``df`` with the quantile bin of ``y`` inside its group: the number of inner edges below the value; null values get 0."""
    by = list(by)
    edges = quantile_edges(df.where(F.col(y).isNotNull()), by, y, most)
    lists = edges.groupBy(*by).agg(F.collect_list("edge").alias("_edges")) if by else edges.agg(F.collect_list("edge").alias("_edges"))
    # A group has ``most`` edges at most.
    joined = df.join(lists, by, "left") if by else df.crossJoin(F.broadcast(lists))
    return joined.withColumn(out, F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(y))), F.lit(0)).cast("long")).drop("_edges")


def global_edges(df: DataFrame, y: str, most: int) -> list[float]:
    """Inner edges of the quantile cut of a whole column, by exact percentiles: no task sorts all rows in one window."""
    k, n = df.agg(F.least(F.lit(most), F.countDistinct(y)), F.count(y)).first()
    if not n:
        return []
    shares = [1.0 if i == k else i * (1.0 / k) for i in range(k + 1)]
    at = sorted({min(n - 1, j) for s in shares for h in [s * 100.0 / 100.0 * (n - 1)] for j in (int(h), int(h) + 1)})
    # Range partitions hold consecutive values; their sizes say which one has a position.
    parts = df.where(F.col(y).isNotNull()).select(F.col(y).alias("_y")).repartitionByRange("_y").sortWithinPartitions("_y").withColumn("_p", F.spark_partition_id())
    numbered = parts.withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)).persist()
    sizes = {r["_p"]: r["count"] for r in numbered.groupBy("_p").count().collect()}
    before, start = {}, 0
    for p in sorted(sizes):
        before[p], start = start, start + sizes[p]
    want = [(p, a - before[p], a) for a in at for p in sizes if before[p] <= a < before[p] + sizes[p]]
    spots = df.sparkSession.createDataFrame(want, "_p int, _in long, at long")
    values = {r["at"]: r["_y"] for r in numbered.join(F.broadcast(spots), ["_p", "_in"]).select("at", "_y").collect()}
    numbered.unpersist()
    edges = set()
    for s in shares:
        h = s * 100.0 / 100.0 * (n - 1)
        a, b, t = values[int(h)], values[min(n - 1, int(h) + 1)], h - int(h)
        edges.add(a + (b - a) * t if t < 0.5 else b - (b - a) * (1.0 - t))
    return sorted(edges)[1:-1]
