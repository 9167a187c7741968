"""Reliable checkpoints for loops whose plan would grow with every step, and tables of what Python computed."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PART = 1 << 20  # bytes of a plan's result, as Catalyst guesses it from its files
SMALL = 100_000  # rows of ids that every executor may get


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names. A temporary one stands in for it in local mode only: on a cluster its machines couldn't share it."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{SETTING} names no folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="grapholith-")
        spark.conf.set(SETTING, named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the cluster's checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: nothing is left to ask
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back by column; removed when Python ends.

    The write's own shuffle files go with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``keys`` over all cores: a table of few row groups is read by few tasks, which would do all that Python does with its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def in_parts(df: DataFrame, key: str) -> DataFrame:
    """Rows by ``key`` in parts that stay the same size however many rows there are, so that a task which tells equal rows apart holds no more of them.

    Without it a task holds what a part of the scan has, and then what adaptive execution puts together.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(1, min(size // PART + 1, 100_000)), key)


def near(ids: DataFrame, rows: int) -> DataFrame:
    """``ids``, sent to every executor if there are few; ``rows`` is their counted number."""
    return F.broadcast(ids) if rows <= SMALL else ids
