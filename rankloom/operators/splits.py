"""Splits, folds and batches. Sizes follow floor and array-split rules exactly; membership follows md5 order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankloom.operators.dataset import by_query, dice, placed, query_ids


def holdout_queries(df: DataFrame, train: float, valid: float, salt: str = "h") -> DataFrame:
    """``df`` with ``split`` by query: floor(n * train) queries train, then floor of the rest's share valid, then test."""
    ids = query_ids(df)
    n = ids.count()
    n_train = int(n * train)
    rest = n - n_train
    n_valid = int(rest * (valid / (1 - train))) if train < 1 else 0
    split = F.when(F.col("_at") < n_train, F.lit("train")).when(F.col("_at") < n_train + n_valid, F.lit("valid")).otherwise(F.lit("test"))
    marked = placed(ids.withColumn("_dice", dice("qid", salt=salt)), "_dice", "qid")
    return df.join(marked.select("qid", split.alias("split")), "qid")


def holdout_per_query(df: DataFrame, train: float, valid: float, salt: str = "p") -> DataFrame:
    """``df`` with ``split`` inside each query: fewer than three documents train; a single one left over is valid."""
    n = F.count("*").over(by_query())
    at = F.row_number().over(by_query().orderBy(dice("qid", "doc_id", salt=salt), "doc_id"))
    n_train = F.floor(F.col("_n") * F.lit(train))
    rest = F.col("_n") - n_train
    test = 1 - train - valid
    n_valid = rest if test <= 1e-5 else F.when(rest <= 1, rest).otherwise(F.floor(rest * F.lit(valid / (valid + test))))
    split = F.when((F.col("_n") < 3) | (F.col("_at") <= n_train), F.lit("train")).when(F.col("_at") <= n_train + n_valid, F.lit("valid")).otherwise(F.lit("test"))
    return df.withColumn("_n", n).withColumn("_at", at).withColumn("split", split).drop("_n", "_at")


def query_kfold(df: DataFrame, n: int) -> DataFrame:
    """``df`` with ``fold`` 0 to n - 1: every query's documents in n chunks in order of doc_id; fold f tests on chunk f."""
    if n < 2:
        raise ValueError("two folds at least")
    return df.withColumn("fold", (F.ntile(n).over(by_query().orderBy("doc_id")) - 1).cast("long"))


def query_batches(df: DataFrame, per_batch: int) -> DataFrame:
    """qid, batch: the queries in order of id in ceil(Q / per_batch) batches whose sizes differ by one at most."""
    ids = placed(query_ids(df), "qid")
    n = ids.count()
    k = max(1, -(-n // per_batch))
    size, more = n // k, n % k  # the first batches have one more
    batch = F.when(F.col("_at") < more * (size + 1), F.expr(f"_at div {size + 1}")).otherwise(more + F.expr(f"(_at - {more * (size + 1)}) div {max(size, 1)}"))
    return ids.select("qid", batch.cast("long").alias("batch"))


def stratified(df: DataFrame, by: str, train: float, salt: str = "t") -> DataFrame:
    """``df`` with ``split`` train or test: floor of each stratum's share trains.

    Strata are few and large, so ranks are found in two levels: stratum sizes up to each md5 prefix, then a window inside
    one prefix. No task holds a stratum.
    """
    key = dice("qid", "doc_id", salt=salt)
    marked = df.withColumn("_d", key).withColumn("_b", F.substring("_d", 1, 3))
    sizes = marked.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy(by)
    before = sizes.select(F.col(by).alias("_s"), F.col("_b").alias("_k"), (F.sum("_n").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    inner = F.row_number().over(W.partitionBy(by, "_b").orderBy("_d", "doc_id"))
    ranked = marked.withColumn("_at", inner).join(before, F.col(by).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_k")))
    split = F.when(F.col("_before") + F.col("_at") <= F.floor(F.col("_all") * F.lit(train)), F.lit("train")).otherwise(F.lit("test"))
    return ranked.withColumn("split", split).select(*df.columns, "split")


def fold_leakage(df: DataFrame) -> DataFrame:
    """Documents that are in train and test of a fold; none, if folds are right."""
    folds = df.select("fold").distinct().withColumnRenamed("fold", "f")
    test = df.select(F.col("fold").alias("f"), "qid", "doc_id")
    train = df.join(folds, F.col("fold") != F.col("f")).select("f", "qid", "doc_id")
    return train.intersect(test)


def fold_distribution(df: DataFrame, n: int) -> DataFrame:
    """fold, qid, n_train, n_test."""
    sizes = df.groupBy("qid").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("fold") == f, 1)).alias(f"t{f}") for f in range(n)])
    rows = F.array(*[F.struct(F.lit(f).cast("long").alias("fold"), F.col(f"t{f}").alias("n_test")) for f in range(n)])
    return sizes.select("qid", "n", F.explode(rows).alias("r")).select("r.fold", "qid", (F.col("n") - F.col("r.n_test")).alias("n_train"), "r.n_test")
