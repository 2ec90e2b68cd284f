"""Regressions over many overlapping windows of one stretch of rows, from sums of products.

Rows are summed once by cells between all windows' bounds; a window's normal
equations are the sums of its cells, and all windows are solved at once. Cells
lie at fixed rows of the series, so a window's numbers don't depend on which
others it is computed with.
"""

from __future__ import annotations

import numpy as np


class Cells:
    """Sums of columns (rows by columns) between consecutive ``bounds``."""

    def __init__(self, columns: np.ndarray, bounds: np.ndarray):
        self.bounds = bounds
        self.sums = np.add.reduceat(columns[: bounds[-1]], bounds[:-1], axis=0)

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums over the rows [low, high) of each window; both are bounds."""
        a, b = np.searchsorted(self.bounds, low), np.searchsorted(self.bounds, high)
        at = a[:, None] + np.arange(int((b - a).max(initial=0)))
        part = self.sums[np.minimum(at, len(self.sums) - 1)]
        return np.where((at < b[:, None])[:, :, None], part, 0.0).sum(axis=1)


def products(x: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Per row all that a regression of y on the columns of x needs: 1, y y, x y and x x; zeros where ``use`` is false."""
    k = x.shape[1]
    i, j = np.triu_indices(k)
    columns = np.column_stack([np.ones(len(y)), y * y, x * y[:, None], x[:, i] * x[:, j]])
    return np.where(use[:, None], columns, 0.0)


def regressions(sums: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Of windows' summed ``products``: rows ``n``, coefficients ``beta``, residual deviation ``s`` and the second moments ``xx``. Singular designs get the shortest coefficients."""
    n, yy, xy = sums[:, 0], sums[:, 1], sums[:, 2 : 2 + k]
    xx = np.zeros((len(sums), k, k))
    i, j = np.triu_indices(k)
    xx[:, i, j] = xx[:, j, i] = sums[:, 2 + k :]
    beta = np.einsum("nij,nj->ni", np.linalg.pinv(xx, hermitian=True), xy)
    rest = yy - 2 * np.einsum("ni,ni->n", beta, xy) + np.einsum("ni,nij,nj->n", beta, xx, beta)
    s = np.sqrt(np.maximum(rest, 0.0) / np.maximum(n - k, 1.0))
    return {"n": n, "beta": beta, "s": np.maximum(s, 1e-12), "xx": xx}


def t_scales(r: np.ndarray, use: np.ndarray, nu: float, rounds: int = 40) -> np.ndarray:
    """Likelihood scales of Student t samples (a row each, the entries in ``use``) with known degrees of freedom, by Newton steps on the log scale."""
    sq = np.where(use, r * r, 0.0)
    n = np.maximum(use.sum(axis=1), 1)
    s2, going = np.maximum(sq.sum(axis=1) / n, 1e-24), np.ones(len(sq), dtype=bool)
    for _ in range(rounds):
        u = sq / s2[:, None]
        # the score of log s2 and its slope; the score falls, so a bounded step can't run away
        score = ((nu + 1) * u / (nu + u)).sum(axis=1) / n - 1
        slope = ((nu + 1) * nu * u / (nu + u) ** 2).sum(axis=1) / n
        # a sample stops by itself, so that its scale doesn't depend on the others
        step = np.where(going, np.clip(score / np.maximum(slope, 1e-12), -2.0, 2.0), 0.0)
        s2 = np.maximum(s2 * np.exp(step), 1e-24)
        going &= np.abs(step) >= 1e-13
        if not going.any():
            break
    return np.sqrt(s2)


def speeds(a: list[dict], b: list[dict], scale_a: np.ndarray, scale_b: np.ndarray, nu: float) -> dict[str, np.ndarray]:
    """Fisher-Rao distances per unit step between fits of the same regressions, without and with the log scale, whose information is 2 nu / (nu + 3)."""
    flow = np.zeros(len(scale_a))
    for p, q in zip(a, b, strict=True):
        move, spread = q["beta"] - p["beta"], np.log(q["s"]) - np.log(p["s"])
        known = sum(0.5 * f["xx"] / (f["n"] * f["s"] ** 2)[:, None, None] for f in (p, q))
        flow = flow + np.einsum("ni,nij,nj->n", move, known, move) + 2.0 * spread * spread
    scale = np.log(scale_b) - np.log(scale_a)
    whole = flow + 2 * nu / (nu + 3) * scale * scale
    return {"v_flow": np.sqrt(np.maximum(flow, 0.0)), "v_total": np.sqrt(np.maximum(whole, 0.0)), "dlog_sigma": scale, "da1": b[0]["beta"][:, 1] - a[0]["beta"][:, 1]}
