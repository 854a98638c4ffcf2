"""Algebra of ranked lists: filters, samples, sorts, set operations and summaries over qid, doc_id, y, features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from rankloom.storage import cut


def by_query() -> WindowSpec:
    """The documents of a query. Made when asked for, as windows need a session."""
    return W.partitionBy("qid")


def dice(*columns: str, salt: str) -> Column:
    """A repeatable random order: md5 of the columns and a salt. The same in every engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(salt)))


def query_ids(df: DataFrame) -> DataFrame:
    return df.select("qid").distinct()


def placed(ids: DataFrame, *order: Column | str, out: str = "_at") -> DataFrame:
    """``ids`` with their place, from 0, in an order without ties.

    Rows are dealt to tasks by ranges of the order and counted there; only the tasks' counts meet in one, so a table of any
    number of queries has its places.
    """
    ranged = cut(ids.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_p").withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_p", "_in", "_before")


def _of_queries(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("qid"), "qid", "left_semi")


# -- filters ------------------------------------------------------------------------------------------------------


def first_queries(df: DataFrame, k: int) -> DataFrame:
    """Documents of the k smallest query ids."""
    return _of_queries(df, query_ids(df).orderBy("qid").limit(k))


def min_group(df: DataFrame, least: int) -> DataFrame:
    """Queries with at least so many documents."""
    return df.withColumn("_n", F.count("*").over(by_query())).where(F.col("_n") >= least).drop("_n")


def random_queries(df: DataFrame, k: int, salt: str = "q") -> DataFrame:
    """k queries without replacement, or all if there are no more."""
    return _of_queries(df, query_ids(df).orderBy(dice("qid", salt=salt), "qid").limit(k))


def sample_queries(df: DataFrame, size: float, salt: str = "s") -> DataFrame:
    """A float up to 1 is a share of the queries, else a count; at most all of them."""
    if isinstance(size, float) and not 0 < size <= 1 or not isinstance(size, float) and size < 1:
        raise ValueError("a share in (0, 1] or a count of 1 or more")
    k = math.floor(query_ids(df).count() * size) if isinstance(size, float) else size
    return random_queries(df, max(1, k), salt)


def cap_items(df: DataFrame, most: int, salt: str = "c") -> DataFrame:
    """At most so many documents of each query, drawn by md5."""
    w = by_query().orderBy(dice("qid", "doc_id", salt=salt), "doc_id")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def delete_items(df: DataFrame, items: DataFrame) -> DataFrame:
    """Without the (qid, doc_id) of ``items``."""
    return df.join(items.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")


def delete_queries(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("qid"), "qid", "left_anti")


def query_slice(df: DataFrame, start: int | None, stop: int | None, step: int = 1) -> DataFrame:
    """Documents of the queries at positions start, start + step .. below stop, by ascending id; negative ends count back."""
    ids = query_ids(df)
    if (start or 0) < 0 or (stop or 0) < 0:
        n = ids.count()
        start, stop = (x + n if x is not None and x < 0 else x for x in (start, stop))
    at = placed(ids, "qid")
    keep = (F.col("_at") >= (start or 0)) & ((F.col("_at") - (start or 0)) % step == 0)
    return _of_queries(df, at.where(keep if stop is None else keep & (F.col("_at") < stop)))


# -- sorts and ranks ----------------------------------------------------------------------------------------------


def sort_by_query(df: DataFrame) -> DataFrame:
    return df.orderBy("qid", "doc_id")


def rank_by(df: DataFrame, score: str, out: str = "rank") -> DataFrame:
    """1-based rank inside the query, best score first, ties by doc_id."""
    return df.withColumn(out, F.row_number().over(by_query().orderBy(F.col(score).desc_nulls_last(), "doc_id")).cast("long"))


def rank_grades(df: DataFrame, score: str, bands: Sequence[tuple[int, int]] = ((2, 4), (4, 3), (7, 2), (9, 1))) -> DataFrame:
    """Grade by true rank: (last rank, grade) bands, 0 beyond them."""
    ranked = rank_by(df, score, "true_rank")
    grade = F.lit(0)
    for last, g in sorted(bands, reverse=True):
        grade = F.when(F.col("true_rank") <= last, F.lit(g)).otherwise(grade)
    return ranked.withColumn("relevance", grade.cast("long"))


def group_offsets(df: DataFrame) -> DataFrame:
    """qid, n, offset: where each query's documents begin in sorted order.

    The running sum is over one row a query, not over documents: inside ranges of queries, then over the ranges.
    """
    n = cut(df.groupBy("qid").agg(F.count("*").alias("n")).repartitionByRange("qid").withColumn("_p", F.spark_partition_id()))
    upto = lambda w: F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    ranges = n.groupBy("_p").agg(F.sum("n").alias("n")).select("_p", upto(W.orderBy("_p")).alias("_before"))
    return n.withColumn("_in", upto(W.partitionBy("_p").orderBy("qid"))).join(F.broadcast(ranges), "_p").select("qid", "n", (F.col("_before") + F.col("_in")).cast("long").alias("offset"))


# -- set operations -----------------------------------------------------------------------------------------------


def concat(*parts: DataFrame) -> DataFrame:
    """All rows of tables with the same columns."""
    names = {tuple(sorted(p.columns)) for p in parts}
    if len(names) != 1:
        raise ValueError("tables differ in columns")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def concat_by_query(*parts: DataFrame) -> DataFrame:
    """All rows with their place: by query, then table, then doc_id; ``position`` counts inside the query."""
    marked = concat(*[p.withColumn("src", F.lit(i).cast("long")) for i, p in enumerate(parts)])
    return marked.withColumn("position", F.row_number().over(by_query().orderBy("src", "doc_id")).cast("long"))


# -- summaries ----------------------------------------------------------------------------------------------------


def query_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("qid").agg(F.count("*").alias("n"))


def describe(df: DataFrame) -> DataFrame:
    """One row: documents, queries, features."""
    return df.agg(F.count("*").alias("docs"), F.countDistinct("qid").alias("queries"), F.max(F.size("features")).cast("long").alias("features"))


def dataset_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """A row for each named table: documents, queries, features, documents per query, target range."""
    out = None
    for name, df in parts.items():
        per = df.groupBy("qid").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.max(F.size("features")).alias("d"))
        row = per.agg(F.sum("n").alias("docs"), F.count("*").alias("queries"), F.max("d").cast("long").alias("features"), F.avg("n").alias("mean_docs"), F.min("n").alias("min_docs"), F.max("n").alias("max_docs"), F.min("lo").alias("min_y"), F.max("hi").alias("max_y")).withColumn("dataset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def query_summary(df: DataFrame, value: str = "y") -> DataFrame:
    """Per query: size, max, min and mean of a column, to three decimals."""
    return df.groupBy("qid").agg(F.count("*").alias("size"), F.round(F.max(value), 3).alias("max"), F.round(F.min(value), 3).alias("min"), F.round(F.avg(value), 3).alias("mean"))
