"""Approximate nearest neighbours by stable projections in a kd-tree with a chi-square stopping test.

Gaussian projections keep Euclidean distance: a pair at distance d lies at d times the
root of a chi-square variable in ``DIMS`` projected dimensions. A kd-tree orders the
projected points; its leaves are verified from the nearest on, and a query stops
when the next leaf lies so far that a point within its present k-th distance
would have been met before with probability ``SURE``. The upper levels of the tree are
the cells of :mod:`.cells`, visited in waves with the same test between them; the lower ones
are built in each task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .cells import CELL, kd_splits, leaf, nearest
from .topk import _squares, exact

K, DIMS, SURE = 10, 8, 0.95
_LEAF = 64


def chi_square(x: float, m: int) -> float:
    """P(chi-square of an even m <= x)."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - float(np.exp(-x / 2)) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(dim: int, m: int = DIMS) -> np.ndarray:
    return np.random.default_rng(7919 + dim).standard_normal((dim, m))


def features(x: np.ndarray) -> np.ndarray:
    return x @ directions(x.shape[1])


def kernel(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of the k nearest verified points of each query, within its radius."""
    reach = quantile(sure, DIMS)
    f, g = features(x), features(q)
    tree = kd_splits(f, max(0, int(np.ceil(np.log2(max(1, len(x) / _LEAF))))))
    of = leaf(f, tree) if len(tree[0]) else np.zeros(len(x), np.int64)
    order = np.argsort(of, kind="stable")
    names, starts = np.unique(of[order], return_index=True)
    stops = np.r_[starts[1:], len(order)]
    low = np.minimum.reduceat(f[order], starts, axis=0)
    high = np.maximum.reduceat(f[order], starts, axis=0)
    n = len(q)
    best = np.repeat((radius[:, None] + 1e-5) ** 2, k, 1)
    who = np.full((n, k), -1, np.int64)
    for i in range(0, n, 8192):
        j = min(n, i + 8192)
        gap = np.zeros((j - i, len(names)))
        for m in range(DIMS):
            y = g[i:j, m : m + 1]
            gap += np.maximum(np.maximum(low[:, m] - y, y - high[:, m]), 0) ** 2
        near = np.argsort(gap, axis=1, kind="stable")
        live = np.arange(j - i)
        for step in range(len(names)):
            at = near[live, step]
            live = live[gap[live, at] <= reach * best[i + live, -1]]  # the stopping test: later leaves are farther still
            if not len(live):
                break
            at = near[live, step]
            by = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[by])) + 1
            for group in np.split(by, cuts):
                rows, box = live[group] + i, at[group[0]]
                points = order[starts[box] : stops[box]]
                d = _squares(q[rows], x[points])
                d[q_ids[rows, None] == ids[points]] = np.inf
                if not (d < best[rows, -1:]).any():
                    continue
                both, names_ = np.concatenate([best[rows], d], 1), np.concatenate([who[rows], np.broadcast_to(points, d.shape)], 1)
                pick = np.argpartition(both, k - 1, axis=1)[:, :k]
                both, names_ = np.take_along_axis(both, pick, 1), np.take_along_axis(names_, pick, 1)
                s = np.argsort(both, axis=1)
                best[rows], who[rows] = np.take_along_axis(both, s, 1), np.take_along_axis(names_, s, 1)
    rows, col = np.nonzero((who >= 0) & np.isfinite(best))
    at = who[rows, col]
    return rows, ids[at], exact(q, rows, x, at)


def neighbours(df: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, queries: DataFrame | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for each query k near rows of another id; each true one is there with probability 0.95.

    ``queries`` has the columns of ``df``; without it, all rows are queries.

    Distances are exact, rounded to six decimals; equal ones rank by id. Rows whose
    id is null or whose vector is null, empty or not finite take no part; of rows
    that repeat an id the least vector counts. Vectors of different length aren't
    compared. Where there are fewer than k others, all are told; an empty table gives
    no rows; other columns are left behind.
    """
    return nearest(df, k, features, kernel, float(np.sqrt(quantile(SURE, DIMS))), id_col, vector_col, cell, queries)
