"""Special functions over NumPy arrays; Spark has none of them."""

from __future__ import annotations

import math
from collections.abc import Generator

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x: np.ndarray | float) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def chi2_sf_1df(x: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square with one degree of freedom."""
    return np.asarray(_erfc(np.sqrt(np.maximum(np.asarray(x, float), 0) / 2)), float)


def descent(start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 60, close: float = 1e-10, h: float = 1e-3) -> Generator[np.ndarray, np.ndarray, tuple[np.ndarray, float, bool]]:
    """Bounded damped Newton steps with differences as derivatives: point, value and whether it settled.

    A generator: it yields batches of points as rows and is sent their values, so that many searches can share one evaluation.
    With the shorter steps it asks for the surroundings of the full one, so that a step usually takes one batch.
    """
    n = len(start)
    e = h * np.eye(n)
    pairs = [(i, j) for i in range(n) for j in range(i)]

    def around(p: np.ndarray) -> np.ndarray:
        return np.array([p, *(p + x for x in e), *(p - x for x in e), *(p + e[i] + e[j] for i, j in pairs), *(p - e[i] - e[j] for i, j in pairs)])

    p, settled = np.clip(start, low, high), False
    v = yield around(p)
    value = float(v[0])
    for _ in range(steps):
        up, down, both, neither = v[1 : n + 1], v[n + 1 : 2 * n + 1], v[2 * n + 1 : 2 * n + 1 + len(pairs)], v[2 * n + 1 + len(pairs) :]
        g, hess = (up - down) / (2 * h), np.diag((up - 2 * value + down) / h**2)
        for (i, j), a, b in zip(pairs, both, neither, strict=True):
            hess[i, j] = hess[j, i] = (a + b - up[i] - up[j] - down[i] - down[j] + 2 * value) / (2 * h**2)
        free = ~((p <= low) & (g > 0) | (p >= high) & (g < 0))
        if not free.any():
            return p, value, True
        w, q = np.linalg.eigh(hess[np.ix_(free, free)])
        w = np.maximum(np.abs(w), 1e-8 * max(np.abs(w).max(), 1e-300))
        step = np.zeros(n)
        step[free] = -q @ ((q.T @ g[free]) / w)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        tries = np.array([np.clip(p + step * 0.5**k, low, high) for k in range(12)])
        got = yield np.concatenate([tries, around(tries[0])])
        values, v = got[:12], got[12:]
        k = int(np.argmin(values))
        if values[k] >= value - close * (abs(value) + close):
            settled = bool(np.abs(step).max() < 1e-2 or values[k] >= value)
            if values[k] < value:
                p, value = tries[k], float(values[k])
            break
        p, value = tries[k], float(values[k])
        if k:
            v = yield around(p)
    return p, value, settled
