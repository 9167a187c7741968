"""Nearest neighbours of a stated set of queries, cell by cell: the frame that exact and approximate search share.

1. Vectors get a few features whose distance bounds that of the vectors (or does so with
   known probability). A kd-tree over the features of a bounded sample cuts the
   space into cells; it only shapes the layout, never the result. Cells of many equal
   features are split by hash.
2. Queries visit the cells in waves, the nearest boxes first: one cell, then 3, 12, 48 more
   and so on. After each wave the lists of a query are merged and its radius shrinks to
   its present k-th distance; it stops when the next box lies beyond the radius.
3. Cells of many rows are searched in parts and cells of many visitors in several tasks,
   so a task holds ``2 * CELL`` rows and ``VISITORS`` queries at most.

The tree has at most ``MOST_CELLS`` leaves: what the driver holds and sends is 20 MB at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

CELL, MOST_CELLS, SAMPLE, VISITORS = 4096, 65_536, 20_000, 40_000
WIDEST = 4096  # boxes of a query in one wave; the next ones come in the waves after
_NUMBER = (1 << 18) - 1
DIGITS = 6  # distances are rounded to so many decimals; equal ones rank by id

Features = Callable[[np.ndarray], np.ndarray]
Kernel = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]
_NN = "array<struct<distance: double, neighbor_id: bigint>>"
_NN_ARROW = pa.list_(pa.struct([("distance", pa.float64()), ("neighbor_id", pa.int64())]))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one vector an id, the least of several; without null ids and vectors that are null, empty or not finite."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(scratch.whole(df, id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null and size(v) > 0").where(~bad).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def kd_splits(f: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of each inner node in heap order: medians of the widest feature."""
    feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    parts = {0: np.arange(len(f))}
    for node in range(2**depth - 1):
        rows = parts.pop(node, np.zeros(0, np.int64))
        if len(rows) > 1:
            k = int(np.argmax(np.ptp(f[rows], axis=0)))
            at = float(np.median(f[rows, k]))
            feature[node], cut[node] = k, at
            right = f[rows, k] > at
            parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
    return feature, cut


def leaf(f: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf of each row of features, from 0."""
    feature, cut = tree
    node, every = np.zeros(len(f), np.int64), np.arange(len(f))
    for _ in range((len(feature) + 1).bit_length() - 1):
        node = 2 * node + 1 + (f[every, feature[node]] > cut[node])
    return node - len(feature)


def _placed(features: Features, trees: dict[int, tuple[int, tuple[np.ndarray, np.ndarray]]] | None):
    """(id, dim, v, f[, cell]) from (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = flat[starts[own, None] + np.arange(dim)].astype(np.float64)
                f = features(x)
                cols = [pa.array(ids[own]), pa.array(np.full(len(own), dim, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in f], pa.binary())]
                if trees is not None:
                    first, tree = trees[int(dim)]
                    cols.append(pa.array((first + leaf(f, tree)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(cols, ["id", "dim", "v", "f", "cell"][: len(cols)])

    return run


def _box(t: pa.Table) -> pa.Table:
    f = np.stack([np.frombuffer(x, np.float64) for x in t["f"].to_pylist()])
    return pa.table([t["cell"][:1], t["dim"][:1], pa.array([len(f)], pa.int64()), pa.array([f.min(0).tobytes()], pa.binary()), pa.array([f.max(0).tobytes()], pa.binary())], ["cell", "dim", "n", "low", "high"])


def _boxes_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes of each batch's cells: a partial aggregation before the shuffle."""
    for b in batches:
        cell = b.column(4).to_numpy()
        order = np.argsort(cell, kind="stable")
        t = pa.Table.from_batches([b]).take(pa.array(order))
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(order)]):
            if z > a:
                yield from _box(t.slice(int(a), int(z - a)).combine_chunks()).to_batches()


def _merged_boxes(t: pa.Table) -> pa.Table:
    low, high = (np.stack([np.frombuffer(x, np.float64) for x in t[c].to_pylist()]) for c in ("low", "high"))
    return pa.table([t["cell"][:1], t["dim"][:1], pa.array([sum(t["n"].to_pylist())], pa.int64()), pa.array([low.min(0).tobytes()], pa.binary()), pa.array([high.max(0).tobytes()], pa.binary())], ["cell", "dim", "n", "low", "high"])


def lists(qi: np.ndarray, ids: np.ndarray, dist: np.ndarray, n: int, k: int) -> pa.Array:
    """The k first (distance, id) of each of n queries as lists."""
    dist = np.round(dist, DIGITS)
    order = np.lexsort((ids, dist, qi))
    qi, ids, dist = qi[order], ids[order], dist[order]
    start = np.searchsorted(qi, np.arange(n + 1))
    keep = np.arange(len(qi)) - start[qi] < k if len(qi) else np.zeros(0, bool)
    counts = np.bincount(qi[keep], minlength=n)
    values = pa.StructArray.from_arrays([pa.array(dist[keep]), pa.array(ids[keep])], ["distance", "neighbor_id"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


class Boxes:
    """Cells by dimension with their bounds, and the number of parts of each."""

    def __init__(self, rows: list, factor: float, most: int):
        self.factor, self.by = factor, {}
        for dim in {r["dim"] for r in rows}:
            own = sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["cell"])
            self.by[dim] = (np.array([r["cell"] for r in own]), *(np.stack([np.frombuffer(r[c], np.float64) for r in own]) for c in ("low", "high")))
        self.parts = np.zeros(max((r["cell"] for r in rows), default=-1) + 1, np.int64)
        for r in rows:
            self.parts[r["cell"]] = -(-r["n"] // most)
        self.largest = max((len(c) for c, _, _ in self.by.values()), default=0)

    def visits(self, b: pa.RecordBatch, radius: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, cells): the boxes number ``start`` to ``stop`` of each query (id, dim, v, f), the nearest first, that lie within its radius."""
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims):
            cells, low, high = self.by.get(int(dim), (np.zeros(0, np.int64), None, None))
            own, m = np.flatnonzero(dims == dim), min(stop, len(cells))
            if start >= m:
                continue
            f = np.stack([np.frombuffer(b.column(3)[int(r)].as_py(), np.float64) for r in own])
            size = max(1, 2_000_000 // len(cells))
            for i in range(0, len(own), size):
                rows = own[i : i + size]
                gap = np.zeros((len(rows), len(cells)))
                for k in range(f.shape[1]):
                    y = f[i : i + size, k : k + 1]
                    gap += np.maximum(np.maximum(low[:, k] - y, y - high[:, k]), 0) ** 2
                key = gap.view(np.int64) & ~_NUMBER | np.arange(len(cells))  # at most the gap, and no two are equal: all waves see one order
                if m < len(cells):
                    key = np.partition(key, m - 1, axis=1)[:, :m]
                key = np.sort(key, axis=1)[:, start:]
                limit = self.factor * (radius[rows, None] + 2 * 10.0**-DIGITS) * (1 + 1e-9)
                r, c = np.nonzero(np.sqrt((key & ~_NUMBER).view(np.float64)) <= limit)
                yield rows[r], cells[key[r, c] & _NUMBER]


def radii(nn: pa.Array, k: int) -> np.ndarray:
    """The k-th distance of each list; infinite where there are fewer."""
    nn = nn.combine_chunks() if isinstance(nn, pa.ChunkedArray) else nn
    out = np.full(len(nn), np.inf)
    full = nn.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) >= k
    if full.any():
        out[full] = nn.values.field("distance").to_numpy()[nn.offsets.to_numpy()[1:][full] - 1]
    return out


def _repeated(cell: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each of ``times`` copies of the rows."""
    r = np.repeat(np.arange(len(cell)), times)
    return r, np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)


def _wave(state: DataFrame, placed: DataFrame, boxes: Boxes, kernel: Kernel, k: int, start: int, stop: int) -> DataFrame | None:
    """The queries' lists after visits to boxes ``start`` to ``stop``; None when no query has one to visit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, c in boxes.visits(b, radii(b.column(4), k), start, stop):
                cell, n = np.unique(c, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    subs = np.zeros(len(boxes.parts), np.int64)  # tasks that share the visitors of a cell
    for r in state.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        subs[r["cell"]] = -(-r["n"] // VISITORS)
    if not subs.any():
        return None
    names = ["cell", "part", "sub", "guest", "id", "dim", "v", "radius"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            radius, ids = radii(b.column(4), k), b.column(0).to_numpy()
            for r, c in boxes.visits(b, radius, start, stop):
                n, part = _repeated(c, boxes.parts[c])
                r, c = r[n], c[n]
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array((ids[r] % subs[c]).astype(np.int32)), pa.array(np.ones(len(r), bool)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(radius[r])], names)

    def host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, part = b.column(3).to_numpy(), b.column(4).to_numpy()
            r, sub = _repeated(cell, subs[cell])
            at = pa.array(r)
            yield pa.RecordBatch.from_arrays([b.column(3).take(at), pa.array((part[r] % boxes.parts[cell[r]]).astype(np.int32)), pa.array(sub.astype(np.int32)), pa.array(np.zeros(len(r), bool)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.zeros(len(r)))], names)

    def search(t: pa.Table) -> pa.Table:
        guest = t["guest"].to_numpy()
        hosts, guests = t.filter(pa.array(~guest)), t.filter(pa.array(guest))
        if not len(guests) or not len(hosts):
            return pa.table([pa.array([], pa.int64()), pa.array([], _NN_ARROW)], ["id", "nn"])
        dim, ids = t["dim"][0].as_py(), guests["id"].to_numpy()
        got = lists(*kernel(hosts["id"].to_numpy(), _matrix(hosts["v"], dim), ids, _matrix(guests["v"], dim), guests["radius"].to_numpy(), k), len(ids), k)
        some = pa.array(np.flatnonzero(got.value_lengths().to_numpy() > 0))
        return pa.table([pa.array(ids).take(some), got.take(some)], ["id", "nn"])

    schema = "cell int, part int, sub int, guest boolean, id bigint, dim int, v binary, radius double"
    hosts = placed.select("id", "dim", "v", "cell", F.expr("pmod(xxhash64(id), 2147483647)").alias("part"))
    met = state.mapInArrow(visit, schema).unionByName(hosts.mapInArrow(host, schema))
    found = met.groupBy("cell", "part", "sub").applyInArrow(search, f"id bigint, nn {_NN}")
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("dim", "int"), ("v", "binary"), ("f", "binary"))]
    merged = state.unionByName(found.select("id", *nothing, "nn")).groupBy("id")
    return merged.agg(F.max("dim").alias("dim"), F.max("v").alias("v"), F.max("f").alias("f"), F.slice(F.array_sort(F.flatten(F.collect_list("nn"))), 1, k).alias("nn"))


def nearest(df: DataFrame, k: int, features: Features, kernel: Kernel, factor: float, id_col: str, vector_col: str, cell: int = CELL, queries: DataFrame | None = None) -> DataFrame:
    """(id_col, rank, neighbor_id, distance): for each query, or each row without ``queries``, its k nearest rows of the same length and another id."""
    spark = df.sparkSession
    scratch.small_batches(spark, 2000)
    rows = scratch.table(vectors(df, id_col, vector_col), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(cell, sum(sizes.values()) // MOST_CELLS + 1)
    plain = "id bigint, dim int, v binary, f binary"
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).mapInArrow(_placed(features, None), plain).select("dim", "f").collect()
    trees, first = {}, 0
    for dim, n in sorted(sizes.items()):
        f = [np.frombuffer(r["f"], np.float64) for r in picked if r["dim"] == dim]
        depth = max(0, int(np.ceil(np.log2(n / each))))
        tree = kd_splits(np.stack(f), depth) if f and depth else (np.zeros(0, np.int64), np.zeros(0))
        trees[dim] = (first, tree)
        first += len(tree[0]) + 1
    placed = scratch.table(rows.mapInArrow(_placed(features, trees), f"{plain}, cell int"), "placed")
    schema = "cell int, dim int, n bigint, low binary, high binary"
    boxes = Boxes(placed.mapInArrow(_boxes_of_batch, schema).groupBy("cell").applyInArrow(_merged_boxes, schema).collect(), factor, 2 * cell)
    asked = rows if queries is None else vectors(queries, id_col, vector_col)
    state = asked.mapInArrow(_placed(features, None), plain).withColumn("nn", F.lit(None).cast(_NN))
    start, stop, state_table = 0, 1, None
    while True:
        before, state = state_table, scratch.table(state, "queries")
        state_table = state
        if before is not None:
            scratch.drop(before)
        if (after := _wave(state, placed, boxes, kernel, k, start, stop)) is None:
            break
        state, start, stop = after, stop, min(4 * stop, stop + WIDEST)
    every = state.select(F.col("id").alias(id_col), F.posexplode("nn").alias("at", "x"))
    return every.select(id_col, (F.col("at") + 1).alias("rank"), "x.neighbor_id", "x.distance")
