"""Shared storage and small helpers.

Intermediate results that are read more than once are written as Parquet to the folder the cluster names in
``spark.checkpoint.dir``: every executor and the driver see it, and a lost executor loses nothing.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.storage import clear_at_exit, remove, shared_dir

#: White space of the word contracts: space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of texts on its way to Python, and the setting that bounds them.
BATCH, BATCH_BYTES = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Tables of one run of an operator under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/rankloom-{name}-{uuid.uuid4().hex[:12]}", 0
        clear_at_exit(spark, self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back; lineage ends here."""
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.rankloom_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            remove(self.spark, df.rankloom_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; null stays null."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % modulus).cast("int")


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether the id falls in the held-out fold. A null id has no remainder; it is held out, so that nothing is learned from it."""
    return F.coalesce(crc_mod(column, modulus) == remainder, F.lit(True))


def short_batches(spark: SparkSession, most: int = BATCH) -> None:
    """From now on the session sends texts to Python in batches of about ``most`` bytes; a lower bound of its own stays.

    The JVM holds a task's batches outside its heap, both ways, and doubles a batch's buffers as texts come in; without
    this a batch is 10,000 rows or 64 MiB. No result depends on it.
    """
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES))
    if own > most:
        spark.conf.set(BATCH_BYTES, str(most))


def tidy(run: Callable) -> Callable:
    """``run`` for a task whose Python worker gives its free memory back at the end: the process lives on beside the JVM."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return task


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``taken`` has it, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def place(df: DataFrame, name: str) -> int:
    """Where the column of a name is; one that differs in case only, if there is no other."""
    names = df.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever dots, blanks or upper-case twins the other columns' names have."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{place(df, n)}").alias(n) for n in names])


def map_rows(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names: ``run`` finds and gives columns by their place."""
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=numbered.names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(tidy(renamed), numbered).toDF(*schema.names)
