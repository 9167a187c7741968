"""Small learners on binned features, fitted in the driver on a bounded sample.

Additive tables grown by cyclic boosting of shallow trees, with pairs; gradient-boosted
trees; and isotonic regression. All of them predict by array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS, PAIR_BINS = 64, 8


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles without repeats; a value's bin is the number of cuts that it reaches."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def log_odds(y: np.ndarray) -> float:
    p = (y.sum() + 0.5) / (len(y) + 1)
    return float(np.log(p / (1 - p)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
    gain = np.where((hl >= least) & (ht - hl >= least), gain, 0)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow(g: np.ndarray, h: np.ndarray, leaves: int, least: float, l2: float = 1.0) -> np.ndarray:
    """A value per bin: the tree of at most ``leaves`` leaves, best cuts first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, a, k, b = max((*(_best_cut(g[a:b], h[a:b], least, l2)[:1]), a, a + _best_cut(g[a:b], h[a:b], least, l2)[1], b) for a, b in parts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, least: float, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """(gain, values) of a cut of the first axis with a cut of the second on either side."""
    best, at = -1.0, (0, 0, 0)
    for k in range(1, g.shape[0]):
        sides = [_best_cut(g[a].sum(0), h[a].sum(0), least, l2) for a in (slice(0, k), slice(k, None))]
        if (gain := sides[0][0] + sides[1][0]) > best:
            best, at = gain, (k, sides[0][1], sides[1][1])
    out = np.zeros_like(g)
    k, p, q = at
    for a, c in ((slice(0, k), p), (slice(k, None), q)):
        for b in (slice(0, c), slice(c, None)):
            out[a, b] = g[a, b].sum() / (h[a, b].sum() + l2)
    return best, out


@dataclass
class Additive:
    """Generalised additive model with pairwise interactions: look-up tables that are summed."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for b, t in zip(binned(x, self.cuts), self.tables):
            z += t[b]
        if self.pairs:
            c = binned(x, self.coarse)
            for (i, j), t in self.pairs.items():
                z += t[c[i], c[j]]
        return sigmoid(z)


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, leaves: int = 3, pairs: int = 6, least: float = 2.0) -> Additive:
    """Cyclic boosting: each round visits every feature, then every chosen pair."""
    cuts = [cut_points(x[:, f], BINS) for f in range(x.shape[1])]
    coarse = [cut_points(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    m = Additive(cuts, coarse, [np.zeros(len(c) + 1) for c in cuts], base=log_odds(y) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return m
    b, c = binned(x, cuts), binned(x, coarse)
    z = np.full(len(y), m.base)
    for _ in range(rounds):
        for f, t in enumerate(m.tables):
            p = sigmoid(z)
            step = rate * shallow(np.bincount(b[f], y - p, len(t)), np.bincount(b[f], p * (1 - p), len(t)), leaves, least)
            t += step
            z += step[b[f]]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at, p = c[i] * shape[1] + c[j], sigmoid(z)
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    ranked = sorted(((_shallow_pair(*grids(i, j), least)[0], i, j) for i in range(len(cuts)) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    m.pairs = {k: np.zeros((len(coarse[k[0]]) + 1, len(coarse[k[1]]) + 1)) for k in chosen}
    for _ in range(rounds // 2):
        for (i, j), t in m.pairs.items():
            step = rate * _shallow_pair(*grids(i, j), least)[1]
            t += step
            z += step[c[i], c[j]]
    return m


@dataclass
class Boosted:
    """Gradient-boosted trees of one depth, as arrays in heap order."""

    cuts: list[np.ndarray]
    depth: int
    base: float
    features: list[np.ndarray] = field(default_factory=list)
    bins: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack(binned(x, self.cuts)) if len(self.cuts) else np.zeros((0, len(x)), np.int64)
        z, every = np.full(len(x), self.base), np.arange(len(x))
        for f, k, v in zip(self.features, self.bins, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[f[node], every] >= k[node])
            z += v[node - (2**self.depth - 1)]
        return z


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, depth: int = 3, least: float = 2.0, l2: float = 1.0) -> Boosted:
    cuts = [cut_points(x[:, f], BINS) for f in range(x.shape[1])]
    m = Boosted(cuts, depth, log_odds(y) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return m
    b = binned(x, cuts)
    z = np.full(len(y), m.base)
    for _ in range(rounds):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p)
        feats, at, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 1 << 30), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for f, c in enumerate(cuts):
                width = len(c) + 1
                gs, hs = (np.bincount((node - first) * width + b[f], v, n * width).reshape(n, width) for v in (g, h))
                for k in range(n):
                    gain, cut = _best_cut(gs[k], hs[k], least, l2)
                    if gain > best[k] + 1e-9:
                        best[k], feats[first + k], at[first + k] = gain, f, cut
            chosen = np.stack(b)[feats[node], np.arange(len(y))]
            node = 2 * node + 1 + (chosen >= at[node])
        leaf = node - (2**depth - 1)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        m.features.append(feats)
        m.bins.append(at)
        m.values.append(v)
        z += v[leaf]
    return m


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities), both rising: pooled adjacent violators; interpolate between them."""
    if not len(z):
        return np.zeros(1), np.zeros(1)
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, v in zip(z.tolist(), y.tolist()):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, last = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = last
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    p = np.repeat([b[0] / b[1] for b in blocks], 2)
    return at, p


def calibrated(z: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.interp(z, *steps)
