"""Quality classifier: a generalised additive model with pairwise interactions.

Features are rates over the whole text: letters, marks, words, repeats. Cyclic
boosting of shallow trees fills one look-up table per feature and per chosen pair;
a text's score is the sum of its bins' entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, scratch
from .trees import Additive, fit_additive
from .words import bounds, hashes, mix

NAMES = ("log_words", "word_length", "word_spread", "upper", "digits", "non_ascii", "commas", "sentence_ends", "exclaims", "pipes", "symbols", "blanks", "newlines", "distinct", "repeats", "top_word", "distinct_pairs", "capitalised")
KEEP = 0.5
_U = np.uint64


def _set(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


def _span(a: str, b: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[ord(a) : ord(b) + 1] = True
    return t


_UPPER, _LOWER, _DIGIT = _span("A", "Z"), _span("a", "z"), _span("0", "9")
_HIGH = np.arange(256) > 127
_CLASSES = [_UPPER, _UPPER | _LOWER | _HIGH, _DIGIT, _HIGH, _set(",;:"), _set(".?"), _set("!"), _set("|\t"), _set("#$%&*@^~_=+<>{}[]\\/`\"'()-"), _set(" "), _set("\n\r")]


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a row's bytes are in the mask."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the most frequent one) per row."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    k = np.sort((rows.astype(np.uint64) << _U(40)) | (keys >> _U(24)))
    firsts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    of = (k[firsts] >> _U(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.r_[firsts, len(k)]))
    return np.bincount(of, minlength=n).astype(float), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rates of each text; all are 0 for an empty one."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    upper, letters, *rest = (per_row(c[data], offsets) for c in _CLASSES)
    s, e, rows = bounds(data, offsets)
    words = np.bincount(rows, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (e - s).astype(float)
    mean = np.bincount(rows, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(rows, length**2, n) / some - mean**2, 0))
    h = hashes(data, s, e)
    distinct, top = _distinct(h, rows, n)
    same_row = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, bool)
    again = np.bincount(rows[1:][same_row & (h[1:] == h[:-1])], minlength=n)
    pairs, _ = _distinct(mix(h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:])[same_row], rows[1:][same_row], n) if len(rows) > 1 else (np.zeros(n), None)
    capitals = np.bincount(rows[_UPPER[data[s]]], minlength=n) if len(s) else np.zeros(n)
    return np.stack([np.log1p(words), mean, spread, upper / np.maximum(letters, 1), *(r / size for r in rest), distinct / some, again / some, top / some, pairs / np.maximum(words - 1, 1), capitals / some], 1)


def fit(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fitted on at most ``most`` labelled rows; without any, every text scores 0.5."""
    x, y, _ = labelled.matrix(labelled.chosen(docs, labels, "quality", most, id_col, text_col), features, len(NAMES), most)
    return fit_additive(x, y)


def score(model: Additive, text: Column) -> Column:
    """The probability of good quality; 0 for a text without words, null or empty."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = labelled.by_slices(texts, features, len(NAMES))
        return pa.array(np.where(x[:, 0] > 0, model.score(x), 0.0))

    return run(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, most: int = labelled.MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality, kept) of every row; ``kept``: the probability is at least ``keep``.

    Texts that are null, empty or without words score 0 and aren't kept. Repeated
    rows are scored each; an empty table gives no rows; other columns are left behind.
    """
    model = fit(docs, labels, most, id_col, text_col)
    scratch.small_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(model, F.col(text_col)).alias("quality"))
    return scored.withColumn("kept", F.col("quality") >= keep)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, most: int = labelled.MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`classify` rejects; all columns stay."""
    model = fit(docs, labels, most, id_col, text_col)
    scratch.small_batches(docs.sparkSession)
    return docs.where(score(model, F.col(text_col)) >= keep)
