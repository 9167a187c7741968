"""Shared-folder tables that cut lineage, so that a lost executor costs one stage at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.lineage import kept, remove

_UNKNOWN = 1 << 60  # Spark tells the largest number where it knows no size


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of :func:`lineage.kept`; removed by :func:`drop`, or when Python ends."""
    return kept(df, name)


def drop(written: DataFrame) -> None:
    """Remove a table of :func:`table` that nothing reads any more."""
    remove(written.sparkSession, written._table)


def whole(df: DataFrame, id_col: str) -> Column:
    """The id as a 64-bit integer; a column of another kind is refused before anything runs."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"ids must be integers, {id_col} is {kind.simpleString()}")
    return F.col(id_col).cast("bigint")


def input_bytes(df: DataFrame) -> int:
    """Size of a plan's result: Catalyst's guess, its scans' files at most; measured in one pass where a scan has no size."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size, scans = (int(str(x)) for x in (plan.stats().sizeInBytes(), sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))))
    if scans < _UNKNOWN:
        return min(size, scans)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(df.agg(F.sum(sum(texts, F.lit(8)).cast("bigint"))).first()[0] or 0) // 2


def buckets(df: DataFrame, each: int, least: int = 12) -> int:
    """Bucket count that follows the input's size, so that one bucket stays the same size."""
    return int(min(max(least, input_bytes(df) // each + 1), 2_000_000))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows: texts can be long, and a Python worker's memory is small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
