"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments; each has a mean and a deviation. The squared distance
of two vectors is at least the sum over the segments of their length times the
squared differences of both. Bounds with 1, then 4, then 16 segments drop pairs
beyond the radius, coarse to fine; exact distances are computed for the survivors.
Means and deviations of four segments, scaled so that their distance is such a
bound, also lay out the cells (:mod:`.cells`) and drop whole cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .cells import CELL, DIGITS, nearest

K = 10
LEVELS = (1, 4, 16)
_ROWS = 256  # queries at a time


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations: their squared distance bounds that of the rows from below."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, z in zip(cuts[:-1], cuts[1:]):
        part = x[:, a:z]
        mean = part.mean(1)
        out += [mean, np.sqrt(np.maximum((part**2).mean(1) - mean**2, 0))]
    return np.stack(out, 1) * np.repeat(np.sqrt(np.diff(cuts)), 2)


def features(x: np.ndarray) -> np.ndarray:
    return statistics(x, 4)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T), 0)


def exact(q: np.ndarray, rows: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances of the pairs (q[rows], x[at]), by differences, a bounded number at a time."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), 16_384):
        out[i : i + 16_384] = np.sqrt(((q[rows[i : i + 16_384]] - x[at[i : i + 16_384]]) ** 2).sum(1))
    return out


def kernel(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of all pairs that can be among a query's k nearest; where the radius is infinite, seeds give one."""
    levels = [s for s in LEVELS if s == 1 or s <= x.shape[1]]
    stats, own = ([statistics(y, s) for s in levels] for y in (x, q))
    error = 1e-9 * float((x**2).sum(1).max(initial=0)) + 1e-12  # of sums by products
    slack = error + 1e-9 * (q**2).sum(1)
    by = np.argsort(own[0][:, 0], kind="stable")  # queries of one block need about the same rows
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(q), _ROWS):
        block = by[i : i + _ROWS]
        r = radius[block].copy()
        if (blank := np.flatnonzero(np.isinf(r))).size and len(ids) > k:
            bound = _squares(own[-1][block[blank]], stats[-1])
            bound[q_ids[block[blank], None] == ids] = np.inf
            seeds = np.argpartition(bound, k - 1, axis=1)[:, :k]
            d = exact(q[block[blank]], np.repeat(np.arange(len(blank)), k), x, seeds.ravel()).reshape(-1, k)
            r[blank] = np.where(np.isfinite(np.take_along_axis(bound, seeds, 1)).all(1), d.max(1), np.inf)
        limit = ((r + 2 * 10.0**-DIGITS) ** 2 + slack[block])[:, None]
        cols, alive = np.arange(len(ids)), np.ones((len(block), len(ids)), bool)
        for a, b in zip(own, stats):
            alive &= _squares(a[block], b[cols]) <= limit
            some = alive.any(0)
            cols, alive = cols[some], alive[:, some]
        rows, at = np.nonzero(alive)
        if len(rows) > alive.size // 8:  # most pairs survive: their distances come from one product, and the k nearest narrow the limit
            d = np.where(alive, _squares(q[block], x[cols]), np.inf)
            if len(cols) > k + 1:
                kth = np.partition(d, k, axis=1)[:, k]
                limit = np.minimum(limit, ((np.sqrt(kth) + 2 * 10.0**-DIGITS) ** 2 + slack[block])[:, None])
            rows, at = np.nonzero((d <= limit) & np.isfinite(d))
        rows, at = block[rows], cols[at]
        other = q_ids[rows] != ids[at]
        rows, at = rows[other], at[other]
        found.append((rows, ids[at], exact(q, rows, x, at)))
    return tuple(np.concatenate(c) for c in zip(*found))


def top_k(df: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, queries: DataFrame | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for each query its k nearest rows of another id, exactly.

    ``queries`` has the columns of ``df``; without it, all rows are queries.

    Euclidean distances, rounded to six decimals; equal ones rank by id. Rows whose
    id is null or whose vector is null, empty or not finite take no part; of rows
    that repeat an id the least vector counts. Vectors of different length aren't
    compared. Where there are fewer than k others, all are told; an empty table gives
    no rows; other columns are left behind.
    """
    return nearest(df, k, features, kernel, 1.0, id_col, vector_col, cell, queries)
