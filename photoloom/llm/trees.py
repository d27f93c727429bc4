"""Gradient-boosted trees for a logistic loss, in NumPy: trained on the driver on a bounded sample, applied in the tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays: feature (-1 at a leaf), cut, value; the children of node ``i`` are ``2 i + 1`` and ``2 i + 2``."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    #: A margin to start from.
    start: Callable[[np.ndarray], np.ndarray] | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base) + (self.start(x) if self.start else 0.0)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                go = 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node])
                node = np.where(f >= 0, go, node)
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))

    def calibrated(self, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> Boosted:
        """The same trees with slope and shift that fit held-out labels best (logistic; the slope is slightly held to 1, so that it
        stays finite where the labels are told apart without a fault)."""
        m = self.margin(x)
        centre = float(np.median(m))
        a, hold, w = np.stack([m - centre, np.ones_like(m)], axis=1), np.array([0.5, 1e-3]), np.array([1.0, 0.0])

        def loss(w: np.ndarray) -> float:
            z = a @ w
            return float((np.logaddexp(0, z) - y * z).sum() + (hold * (w - [1.0, 0.0]) ** 2).sum() / 2)

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            grad = a.T @ (p - y) + hold * (w - [1.0, 0.0])
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold), grad)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        return replace(self, slope=float(w[0]), shift=float(w[1] - w[0] * centre)) if w[0] > 0 else self


def fit_boosted(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 5, share: float = 1.0) -> Boosted:
    """Newton boosting with histogram cuts. Each tree sees a random ``share`` of the features, so that no single one that tells the
    training rows apart does all the work, and rows with another mixture of evidence are judged by all of it."""
    rng = np.random.default_rng(3)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(prior / (1 - prior))))
    margin = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        n = 2 ** (depth + 1) - 1
        seen = rng.choice(x.shape[1], max(1, round(share * x.shape[1])), replace=False)
        feature, cut, value = np.full(n, -1), np.zeros(n), np.zeros(n)
        node = np.zeros(len(x), dtype=int)
        for k in range(n):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[k] = -rate * gs / (hs + 1.0)
            best = (1e-6, -1, 0)
            if k < 2**depth - 1 and len(rows) >= 2 * least:
                for j in np.sort(seen):
                    e = edges[j]
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    if (i := int(gain.argmax())) < len(gain) and gain[i] > best[0]:
                        best = (gain[i], j, i)
            if best[1] >= 0:
                feature[k], cut[k] = best[1], edges[best[1]][best[2]]
                node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
        leaf = node
        margin += value[leaf]
        model.trees.append((feature, cut, value))
    return model
