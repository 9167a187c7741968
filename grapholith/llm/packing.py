"""Packing by concatenate and cut.

Token ids of all documents, in the order of their ids and each followed by an end
mark, form one stream that is cut into windows of a fixed length. Pass one writes
the ids per partition with running sums; the partition totals, a few numbers in
the driver, give every partition's global offset. Pass two cuts windows inside each
partition without a shuffle: only the pieces at a partition's two ends travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .spm import MODEL, SLICE, Vocabulary, _lists, codec
from .words import raw, slices

END = 2
MOST_PARTS = 65_536  # partitions, so that their totals stay under 1 MB in the driver and the tasks
_SCHEMA_CUT = "window_id bigint, at int, whole boolean, ids array<int>, doc_ids array<bigint>, doc_starts array<int>, doc_offsets array<bigint>"


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(scratch.whole(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n = min(scratch.buckets(slim, 6_000_000), MOST_PARTS)
    return slim.repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")


def width(v: Vocabulary, end: int) -> str:
    """The type of a packed id: 16 bits where all ids fit."""
    return "<u2" if max(len(v.names), end) < 1 << 16 and end >= 0 else "<i4"


def _packed(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """(part, local, n, doc_id, ids): ids with the end mark, packed (:func:`width`), ``local`` the running sum before."""
    v = Vocabulary(path)
    kind = width(v, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, total = codec(v), TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j in slices(raw(b.column(1))[1], SLICE):
                ids, offsets = own.encode_slice(b.column(1).slice(i, j - i))
                ids, offsets = np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
                n = np.diff(offsets)
                local = total + offsets[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(local), pa.array(n), b.column(0).slice(i, j - i), _packed(ids.astype(kind), offsets)], ["part", "local", "n", "doc_id", "ids"])
                total += int(offsets[-1])

    return _ordered(docs, id_col, text_col).mapInArrow(run, "part int, local bigint, n bigint, doc_id bigint, ids binary")


def _cut(length: int, before: np.ndarray, whole_ones: bool, kind: str):
    """Cut contiguous rows (part, local, doc_id, packed ids) into windows: the whole ones, or the pieces at the ends of a run."""

    class Run:
        def __init__(self, start: int):
            self.start = self.next = start
            self.ids: list[np.ndarray] = []
            self.docs: list[tuple[int, int, int]] = []  # doc, global start, offset in the document

        def add(self, doc: int, ids: np.ndarray) -> None:
            self.docs.append((doc, self.next, 0))
            self.ids.append(ids)
            self.next += len(ids)

        def take(self, last: bool) -> list[tuple]:
            stop = self.next if last else self.next // length * length
            if stop <= self.start:
                return []
            flat, out, k = np.concatenate(self.ids), [], 0
            begin = self.start
            while begin < stop:
                w = begin // length
                cut = min((w + 1) * length, stop)
                here = []
                while k < len(self.docs) and self.docs[k][1] < cut:
                    here.append(self.docs[k])
                    k += 1
                out.append((w, begin % length, cut - begin == length, flat[begin - self.start : cut - self.start], [d for d, _, _ in here], [g - w * length for _, g, _ in here], [o for _, _, o in here]))
                following = self.docs[k][1] if k < len(self.docs) else self.next
                if following > cut:  # the last document goes on in the next window
                    d, g, o = self.docs[k - 1]
                    k -= 1
                    self.docs[k] = (d, cut, o + cut - g)
                begin = cut
            self.docs = self.docs[k:]
            self.ids, self.start = [flat[stop - self.start :]], stop
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Run | None = None
        names = ["window_id", "at", "whole", "ids", "doc_ids", "doc_starts", "doc_offsets"]

        def batch(rows: list[tuple]) -> pa.RecordBatch | None:
            rows = [r for r in rows if r[2] == whole_ones]
            if not rows:
                return None
            w, at, whole, ids, docs, starts, offs = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(at, pa.int32()), pa.array(whole, pa.bool_()), _lists(np.concatenate(ids).astype(np.int32), np.r_[0, np.cumsum([len(x) for x in ids])]), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32())), pa.array(offs, pa.list_(pa.int64()))], names)

        for b in batches:
            starts = before[b.column(0).to_numpy()] + b.column(1).to_numpy()
            values, offsets = raw(b.column(3))
            values, offsets = np.frombuffer(values, kind), offsets // np.dtype(kind).itemsize
            done: list[tuple] = []
            for k, (start, doc) in enumerate(zip(starts.tolist(), b.column(2).to_pylist())):
                if now is not None and start != now.next:
                    done += now.take(True)
                    now = None
                now = now or Run(start)
                now.add(doc, values[offsets[k] : offsets[k + 1]])
            if now is not None:
                done += now.take(False)
            if out := batch(done):
                yield out
        if now is not None and (out := batch(now.take(True))):
            yield out

    return run


def pack(docs: DataFrame, length: int = 2048, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Windows of ``length`` ids; the last one may be shorter.

    One row a window: its ids, and in ``doc_ids``, ``doc_starts`` and
    ``doc_offsets`` a boundary record per document in it: the id, where in the
    window it starts, and how many of its ids lie in earlier windows. A null text is left out; an empty text gives its end mark alone. Rows
    with a null id come first; rows with equal ids follow each other by text.
    An empty table gives no window. Other columns are left behind.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    kind = width(Vocabulary(path), end)
    rows = scratch.table(tokenised(docs, path, id_col, text_col, end), "tokens")
    totals = {r["part"]: r["total"] for r in rows.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    counts = np.array([totals.get(p, 0) for p in range(max(totals, default=-1) + 1)], np.int64)
    before = np.cumsum(counts) - counts
    names = ["window_id", "ids", "doc_ids", "doc_starts", "doc_offsets"]
    tokens = rows.select("part", "local", "doc_id", "ids")
    pieces = tokens.mapInArrow(_cut(length, before, False, kind), _SCHEMA_CUT)
    met = pieces.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "doc_ids", "doc_starts", "doc_offsets"))).alias("p"))
    joined = met.select("window_id", F.flatten("p.ids").alias("ids"), F.flatten("p.doc_ids").alias("doc_ids"), F.flatten("p.doc_starts").alias("doc_starts"), F.flatten("p.doc_offsets").alias("doc_offsets"))
    return tokens.mapInArrow(_cut(length, before, True, kind), _SCHEMA_CUT).select(names).unionByName(joined)
