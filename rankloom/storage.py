"""Cutting lineage: intermediate tables of iterative operators go to the cluster's shared folder as Parquet.

A reliable checkpoint would compute its input twice; a written table is computed once, is columnar, and survives lost
executors as well.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHARED: dict[str, str] = {}
_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one, the same for all of an application, only if a local session leaves that unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _SHARED:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _SHARED[app] = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
        clear_at_exit(spark, _SHARED[app])
    return _SHARED[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that remote folders work as well."""
    jvm, jsc = spark._jvm, spark._jsc
    if jvm is None or jsc is None or jsc.sc().isStopped():
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def clear_at_exit(spark: SparkSession, path: str) -> None:
    def clear() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  at exit the JVM may be gone; the folder is the cluster's to clean
            pass

    atexit.register(clear)


def _root(spark: SparkSession) -> str:
    """This application's folder for the tables of :func:`cut`."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark)}/rankloom-{uuid.uuid4().hex[:12]}"
        clear_at_exit(spark, _ROOTS[app])
    return _ROOTS[app]


def clear(spark: SparkSession) -> None:
    """Delete all tables that :func:`cut` has written for this application; nothing that still reads them may be used after."""
    if root := _ROOTS.pop(spark.sparkContext.applicationId, None):
        remove(spark, root)


def new_path(spark: SparkSession) -> str:
    """A path of its own in this application's folder."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once and read back."""
    spark = df.sparkSession
    at = new_path(spark)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
