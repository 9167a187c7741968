"""Incremental ingest: new markdown files of a folder flow through the same Columns as the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..sources import bundle as bd

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def changes(spark: SparkSession, root: str, files_per_trigger: int = 10_000) -> DataFrame:
    """A stream of (rel_path, text, seen_at): each new file once."""
    raw = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").option("maxFilesPerTrigger", files_per_trigger).load(root)
    rel = F.element_at(F.split("path", root.rstrip("/").rpartition("/")[2] + "/"), -1)
    return raw.select(rel.alias("rel_path"), t.normalise_input(F.decode("content", "UTF-8")).alias("text"), F.col("modificationTime").alias("seen_at"))


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append parsed concepts as Parquet until what is there now is read."""
    c = bd.concepts(stream).drop("md")
    return c.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, late: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """(window, n): files by the time they changed; later ones than the watermark are left out."""
    return stream.withWatermark("seen_at", late).groupBy(F.window("seen_at", every)).agg(F.count(F.lit(1)).alias("n"))
