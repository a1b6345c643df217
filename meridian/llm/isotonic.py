"""Isotonic regression by pooling adjacent violators."""

from __future__ import annotations

import numpy as np


def pooled(low: np.ndarray, high: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[list[float]]:
    """[low, high, mean, weight] of the pools of the non-decreasing least-squares fit, of distinct runs of scores in ascending order."""
    pools: list[list[float]] = []
    for a, b, value, w in zip(low.tolist(), high.tolist(), y.tolist(), weight.tolist()):
        pools.append([a, b, value, w])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, b2, v2, w2 = pools.pop()
            last = pools[-1]
            last[1], last[2], last[3] = b2, (last[2] * last[3] + v2 * w2) / (last[3] + w2), last[3] + w2
    return pools


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints of the non-decreasing least-squares fit; equal x are one level before anything is pooled."""
    level, at = np.unique(x, return_inverse=True)
    total = np.bincount(at, weight)
    pools = pooled(level, level, np.bincount(at, weight * y) / total, total)
    return np.array([e for p in pools for e in p[:2]]), np.array([p[2] for p in pools for _ in "ab"])
