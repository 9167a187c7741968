"""A bounded sample of labelled documents' features, for fitting in the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .words import raw, slices

MOST = 20_000  # labelled rows that a model is fitted on: those whose ids hash lowest

Features = Callable[[np.ndarray, np.ndarray], np.ndarray]


def by_slices(texts: pa.Array, f: Features, width: int) -> np.ndarray:
    """One row of features a text, over slices of bounded size; every text is taken whole."""
    data, offsets = raw(texts)
    out = np.zeros((len(offsets) - 1, width))
    for i, j in slices(offsets):
        out[i:j] = f(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return out


def chosen(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text, fold) of at most ``most`` labelled ids, in eight folds, written once.

    Rows without a label, an id or a text are left out. An id labelled twice has the
    larger label; a repeated document counts as often as it comes.
    """
    scratch.small_batches(docs.sparkSession)
    told = labels.select(F.col(id_col).cast("bigint").alias("__of"), F.col(label).cast("double").alias("__y")).where("__of is not null and __y is not null")
    some = told.groupBy("__of").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__of"), "__of").limit(most)
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    rows = texts.join(F.broadcast(some), F.col("__id") == F.col("__of"))  # at most ``most`` pairs of numbers are broadcast
    fold = F.expr("cast(pmod(xxhash64(__id, 1), 8) as int)")
    return scratch.table(rows.select(F.col("__id").alias("id"), F.col("__y").alias("y"), F.col("__text").alias("text"), fold.alias("fold")), "labelled")


def matrix(rows: DataFrame, f: Features, width: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, folds) of chosen rows, ``most`` at most, in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = by_slices(b.column(2), f, width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "fold", "x"])

    got = rows.mapInArrow(run, "id bigint, y double, fold int, x binary").orderBy(F.xxhash64("id"), "id", "x").limit(most).toPandas()
    return np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, width), got["y"].to_numpy(), got["fold"].to_numpy()
