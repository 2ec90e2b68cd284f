"""Gaussian kernel densities, and metrics made from them, at many points at once.

All derivatives of the surprise phi = -log rho come from weighted moments of the
sample: with weights w_i ~ exp(-|x - X_i|^2 / 2h^2) and u_i = (x - X_i) / h,
grad phi = mean_w(u) / h and hess phi = (I - cov_w(u)) / h^2. A batch of points
costs one matrix of weights and one product with the sample's features.
"""

from __future__ import annotations

import numpy as np


class Density:
    """An isotropic Gaussian kernel density of the finite rows of ``x`` with bandwidth ``h``."""

    def __init__(self, x: np.ndarray, h: float):
        x = np.asarray(x, dtype=float)
        self.x = x[np.isfinite(x).all(axis=1)]
        self.n, self.d = self.x.shape
        self.h = float(h)
        i, j = np.triu_indices(self.d)
        self.pairs = (i, j)

    def weights(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalized weights (points, sample) and the log of their sum."""
        at = np.atleast_2d(at)
        # squared distances without a (points, sample, d) array; centred for accuracy
        c = self.x.mean(axis=0)
        a, b = (at - c) / self.h, (self.x - c) / self.h
        q = a @ b.T - 0.5 * (b * b).sum(axis=1) - 0.5 * (a * a).sum(axis=1)[:, None]
        top = q.max(axis=1, keepdims=True)
        w = np.exp(q - top)
        total = w.sum(axis=1, keepdims=True)
        return w / total, (top + np.log(total))[:, 0]

    def log_density(self, at: np.ndarray) -> np.ndarray:
        return self.weights(at)[1] - np.log(self.n) - 0.5 * self.d * np.log(2 * np.pi * self.h**2)

    def full(self, upper: np.ndarray) -> np.ndarray:
        """Symmetric matrices from their upper triangles."""
        i, j = self.pairs
        out = np.empty((len(upper), self.d, self.d))
        out[:, i, j] = upper
        out[:, j, i] = upper
        return out

    def moments(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted mean of u and of its products."""
        at = np.atleast_2d(at)
        c = self.x.mean(axis=0)
        b = (self.x - c) / self.h
        i, j = self.pairs
        sums = w @ np.concatenate([b, b[:, i] * b[:, j]], axis=1)
        a = (at - c) / self.h
        m, s = sums[:, : self.d], self.full(sums[:, self.d :])
        second = a[:, :, None] * a[:, None, :] - a[:, :, None] * m[:, None, :] - m[:, :, None] * a[:, None, :] + s
        return a - m, second

    def gradient(self, at: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        w = self.weights(at)[0] if w is None else w
        return self.moments(at, w)[0] / self.h

    def hessian(self, at: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """The observed information, the Hessian of the surprise."""
        w = self.weights(at)[0] if w is None else w
        m, s = self.moments(at, w)
        return (np.eye(self.d) - (s - m[:, :, None] * m[:, None, :])) / self.h**2

    def scores(self, block: int = 512) -> np.ndarray:
        """The surprise's gradient at every sample without that sample's own kernel."""
        out = np.empty_like(self.x)
        c = self.x.mean(axis=0)
        b = (self.x - c) / self.h
        half = 0.5 * (b * b).sum(axis=1)
        for a in range(0, self.n, block):
            q = b[a : a + block] @ b.T - half - half[a : a + block, None]
            q[np.arange(len(q)), np.arange(a, a + len(q))] = -np.inf
            w = np.exp(q - q.max(axis=1, keepdims=True))
            w /= w.sum(axis=1, keepdims=True)
            out[a : a + block] = (b[a : a + block] - w @ b) / self.h
        return out

    def local_mean(self, values: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Kernel-weighted mean of per-sample values."""
        return w @ values

    def fisher(self, scores: np.ndarray, w: np.ndarray, ridge: float = 0.0) -> np.ndarray:
        """Local mean of the scores' outer products."""
        i, j = self.pairs
        return self.full(w @ (scores[:, i] * scores[:, j])) + ridge * np.eye(self.d)

    def reference_scores(self) -> np.ndarray:
        """Scores of one Gaussian fitted to the sample."""
        return (self.x - self.x.mean(axis=0)) @ np.linalg.pinv(np.cov(self.x, rowvar=False))


def scott(n: int, d: int) -> float:
    return float(n) ** (-1.0 / (d + 4))
