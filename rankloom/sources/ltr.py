"""Ranked-list tables: ``qid, doc_id, y, features`` from LETOR text, CSV, JSON, Parquet or relational tables.

Rows carry an explicit ``doc_id``, so no operator depends on row positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rankloom.functions import vectors
from rankloom.functions.binning import equal_width
from rankloom.operators import dataset, splits

SPLITS = ("train", "valid", "test")


# -- LETOR text ---------------------------------------------------------------------------------------------------


def parse_letor(lines: DataFrame, n_features: int, column: str = "value") -> DataFrame:
    """LETOR lines ``label qid:Q 1:v 2:v ... # comment`` -> qid, y, features (1-based, absent values 0)."""
    body = F.split(F.trim(F.regexp_replace(column, "#.*$", "")), r"\s+")
    pairs = F.transform(F.slice(body, 3, F.greatest(F.size(body) - 2, F.lit(0))), lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int").alias("key"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double").alias("value")))
    values = F.map_from_entries(pairs)
    dense = F.transform(F.sequence(F.lit(1), F.lit(n_features)), lambda i: F.coalesce(F.try_element_at(values, i), F.lit(0.0)))
    return lines.where(F.length(F.trim(column)) > 0).select(
        F.regexp_extract(body[1], r"^qid:(\d+)", 1).cast("long").alias("qid"), body[0].cast("double").cast("long").cast("double").alias("y"), dense.alias("features")
    )


def sparse_letor(lines: DataFrame, column: str = "value") -> DataFrame:
    """As :func:`parse_letor`, with features as a map from 1-based position to value."""
    body = F.split(F.trim(F.regexp_replace(column, "#.*$", "")), r"\s+")
    pairs = F.transform(F.slice(body, 3, F.greatest(F.size(body) - 2, F.lit(0))), lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int"), F.split_part(p, F.lit(":"), F.lit(2)).cast("double")))
    return lines.where(F.length(F.trim(column)) > 0).select(F.regexp_extract(body[1], r"^qid:(\d+)", 1).cast("long").alias("qid"), body[0].cast("double").cast("long").cast("double").alias("y"), F.map_from_entries(pairs).alias("features"))


def feature_count(lines: DataFrame, column: str = "value") -> int:
    """The largest feature position in LETOR lines."""
    top = lines.select(F.array_max(F.transform(F.regexp_extract_all(F.col(column), F.lit(r"(?:^|\s)(\d+):"), 1), lambda x: x.cast("int"))).alias("d"))
    return top.agg(F.max("d")).first()[0] or 0


def significant(v: Column, digits: int = 6) -> Column:
    """The shortest text of ``digits`` significant digits: fixed where the exponent lies from -4 to digits - 1, else scientific.

    Where the shortest decimal form of a value goes on with a single 5 after the last digit, it is rounded up.
    """
    bare = lambda t: F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    # Java's own text of a number is its shortest decimal form, in fixed notation from 1e-3 to 1e7.
    own = v.cast("string")
    short = (F.abs(v) >= 1e-3) & (F.abs(v) < 10**digits) & (F.length(own) <= digits + 1)
    long = F.format_string(f"%.{digits - 1}e", v)
    exponent = F.try_to_number(F.regexp_extract(long, r"e([+-]\d+)$", 1), F.lit("S999")).cast("int")
    fixed = F.coalesce(*[F.when(exponent == e, F.format_string(f"%.{digits - 1 - e}f", v)) for e in range(-4, digits)])
    plain = F.when(F.endswith(own, F.lit(".0")), F.substring_index(own, ".", 1)).otherwise(own)
    return F.when(short, plain).when(own == "0.0", "0").otherwise(F.coalesce(bare(fixed), F.concat(bare(F.regexp_extract(long, r"^[^e]*", 0)), F.regexp_extract(long, r"e.*$", 0))))


def fixed(v: Column, decimals: int) -> Column:
    """As a format with so many decimals gives it: the shortest decimal form of a value rounded half up."""
    slow = F.format_string(f"%.{decimals}f", v)
    return F.when((v > 0) & (v < 1e9), v.cast(f"decimal({10 + decimals},{decimals})").cast("string")).otherwise(slow)


def letor_line(decimals: int | None = None) -> Column:
    """A LETOR line of y, qid and features; ``decimals`` fixed digits, or the shortest form of six significant digits."""
    number = significant if decimals is None else lambda v: fixed(v, decimals)
    cells = F.transform("features", lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), number(v)))
    return F.concat_ws(" ", F.col("y").cast("long").cast("string"), F.concat(F.lit("qid:"), F.col("qid").cast("string")), F.array_join(cells, " "))


def write_letor(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """LETOR text, lines in order of qid and doc_id."""
    df.repartitionByRange("qid").sortWithinPartitions("qid", "doc_id").select(letor_line(decimals).alias("value")).write.mode("overwrite").text(path)


def read_letor(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """LETOR text with doc_id numbered inside each query; checks a given feature count against the data."""
    lines = spark.read.text(path)
    d = feature_count(lines)
    if n_features is not None and n_features != d:
        raise ValueError(f"{n_features} features were announced, the text has {d}")
    rows = parse_letor(lines, d)
    return rows.withColumn("doc_id", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("y"), "features")).cast("long")).select("qid", "doc_id", "y", "features")


# -- loaders ------------------------------------------------------------------------------------------------------


class SplitLoader:
    """train, valid and test splits under a folder: Parquet if it was written before, else parsed and written."""

    def __init__(self, spark: SparkSession, folder: str, cache: str, force: bool = False):
        self.spark, self.folder, self.cache, self.force = spark, folder.rstrip("/"), cache.rstrip("/"), force

    def get(self, split: str) -> DataFrame | None:
        """A split, or None if there is no file for it."""
        path = f"{self.cache}/{split}.parquet"
        if self.force or not _exists(self.spark, path):
            if not _exists(self.spark, f"{self.folder}/{split}.txt"):
                return None
            read_letor(self.spark, f"{self.folder}/{split}.txt").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def all(self) -> dict[str, DataFrame]:
        """The splits there are; they must agree on the number of features."""
        found = {s: df for s in SPLITS if (df := self.get(s)) is not None}
        widths = {s: df.agg(F.max(F.size("features"))).first()[0] for s, df in found.items()}
        if len(set(widths.values())) > 1:
            raise ValueError(f"splits differ in features: {widths}")
        return found


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df``, if it has all the columns."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv_union(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str, drop: Sequence[str] = ("id_c", "rank"), rename: dict[str, str] | None = None, prefix: str = "fitness_") -> DataFrame:
    """CSV files as one table: columns dropped, renamed, and a common prefix taken off."""
    df = spark.read.csv(list(paths), schema=schema, header=True).drop(*drop)
    for old, new in (rename if rename is not None else {"id_j": "qid"}).items():
        df = df.withColumnRenamed(old, new)
    return df.toDF(*[c.removeprefix(prefix) for c in df.columns]).orderBy("qid")


def preprocess(df: DataFrame, get_first: int | None = 500, min_items: int | None = 10, max_items: int | None = 400, split: tuple[float, float] | None = (0.5, 0.2), keep: Sequence[int] | None = None) -> DataFrame:
    """The usual steps before an experiment, each left out by None, in this order: queries with at least ``min_items``
    documents, the first of them, ``max_items`` documents of each, the features at some positions, and a column ``split``
    of train, valid and test inside each query."""
    if min_items is not None:
        df = dataset.min_group(df, min_items)
    if get_first is not None:
        df = dataset.first_queries(df, get_first)
    if max_items is not None:
        df = dataset.cap_items(df, max_items)
    if keep is not None:
        df = df.withColumn("features", vectors.keep_positions(F.col("features"), keep))
    return df if split is None else splits.holdout_per_query(df, *split)


def split_parts(df: DataFrame) -> dict[str, DataFrame]:
    """train, valid and test of a table with a ``split`` column."""
    return {s: df.where(F.col("split") == s).drop("split") for s in SPLITS}


def from_arrays(spark: SparkSession, x: Sequence[Sequence[float]], y: Sequence[float], q: Sequence[int]) -> DataFrame:
    """Rows given as features, labels and query ids of one length; doc_id counts rows from 0."""
    if not len(x) == len(y) == len(q):
        raise ValueError("features, labels and query ids differ in number")
    rows = [(int(k), i, float(v), [float(f) for f in row]) for i, (row, v, k) in enumerate(zip(x, y, q, strict=True))]
    return spark.createDataFrame(rows, "qid long, doc_id long, y double, features array<double>")


def from_wide(df: DataFrame, features: Sequence[str] | None = None, label: str = "label", query: str = "qid") -> DataFrame:
    """A wide table (label, query id, a column for each feature) as ranked lists; by default its columns named by numbers, in their order."""
    names = list(features) if features is not None else sorted((c for c in df.columns if c.isdigit()), key=int)
    require_columns(df, [label, query, *names])
    doc = F.row_number().over(W.partitionBy(query).orderBy(F.desc(label), *[F.col(f"`{c}`") for c in names])).cast("long")
    return df.select(F.col(query).cast("long").alias("qid"), doc.alias("doc_id"), F.col(label).cast("double").alias("y"), F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("features"))


def each_query(df: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(qid, its documents) by ascending id. Ids come to the driver a few at a time; documents stay where they are."""
    for r in query_ids_in_order(df).toLocalIterator():
        yield r["qid"], df.where(F.col("qid") == r["qid"])


def query_ids_in_order(df: DataFrame) -> DataFrame:
    return dataset.query_ids(df).orderBy("qid")


def rows_at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The documents at positions of the table sorted by query and document; negative positions count back.

    Positions are found by counting documents before each query, so no task sorts the whole table.
    """
    offsets = dataset.group_offsets(df)
    if any(p < 0 for p in positions):
        n = df.count()
        positions = [p + n if p < 0 else p for p in positions]
    inner = F.row_number().over(W.partitionBy("qid").orderBy("doc_id")) - 1
    at = df.withColumn("_in", inner).join(offsets.select("qid", "offset"), "qid")
    return at.where((F.col("offset") + F.col("_in")).isin([int(p) for p in positions])).drop("_in", "offset")


def query_range(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents of the queries with ids from ``low`` up to ``high``, both included; an end left out is open."""
    keep = F.lit(True)
    if low is not None:
        keep &= F.col("qid") >= low
    if high is not None:
        keep &= F.col("qid") <= high
    return df.where(keep)


def read_query_groups(spark: SparkSession, path: str) -> DataFrame:
    """``{qxm: {group: [qid]}}`` JSON -> qxm, group_id, qid; null groups are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<bigint>>>").alias("m"))
    groups = raw.select(F.explode("m").alias("qxm", "g")).select("qxm", F.explode("g").alias("group_id", "qids"))
    return groups.where("qids is not null").select(F.col("qxm").cast("int"), F.col("group_id").cast("int"), F.explode("qids").alias("qid"))


def from_splits(parts: dict[int, DataFrame]) -> DataFrame:
    """Tables of (doc_id, y, features) by query id as one ranked-list table."""
    out = None
    for qid, df in parts.items():
        df = df.withColumn("qid", F.lit(qid).cast("long")).select("qid", "doc_id", "y", "features")
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no parts")
    return out


# -- ranked lists from the star-schema tables ---------------------------------------------------------------------


def lineitem_lists(spark: SparkSession, sf_dir: str, bins: int = 4) -> DataFrame:
    """Suppliers as queries, their line items as documents: qid, doc_id, y (price band), price, features."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    edges = li.agg(F.min("l_extendedprice").alias("mn"), F.max("l_extendedprice").alias("mx"))
    days = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("double")
    features = F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber").cast("double"), days)
    doc = F.row_number().over(W.partitionBy("l_suppkey").orderBy(*order)).cast("long")
    return li.crossJoin(F.broadcast(edges)).select(F.col("l_suppkey").alias("qid"), doc.alias("doc_id"), equal_width(F.col("l_extendedprice"), F.col("mn"), F.col("mx"), bins).cast("double").alias("y"), F.col("l_extendedprice").alias("price"), features.alias("features"))


def event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as queries, their events as documents graded by type: qid, doc_id, y, features (value, hour)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    grade = F.expr("CASE event_type WHEN 'purchase' THEN 3.0D WHEN 'signup' THEN 2.0D WHEN 'click' THEN 1.0D ELSE 0.0D END")
    return e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("doc_id"), grade.alias("y"), F.array("value", F.hour("ts").cast("double")).alias("features"))


def embedding_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as documents of 20 queries: qid, doc_id, y (label), features."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select((F.col("vec_id") % 20).alias("qid"), F.col("vec_id").alias("doc_id"), F.col("label").cast("double").alias("y"), F.col("embedding").cast("array<double>").alias("features"))
