"""Curvature of metrics that are known as functions, for many points at once.

A point's curvature needs the metric on a small lattice around it: Christoffel
symbols at the point and at its neighbours one step away along each axis, each
from central differences. All lattice points of all points go through the
metric in one call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np

Metric = Callable[[np.ndarray], np.ndarray]


@dataclass
class Curvature:
    """Per point: metric, its inverse, Christoffel symbols (upper index first), Ricci, scalar and Einstein curvature; ``ok`` where the metric could be inverted."""

    g: np.ndarray
    inverse: np.ndarray
    gamma: np.ndarray
    riemann: np.ndarray
    ricci: np.ndarray
    scalar: np.ndarray
    einstein: np.ndarray
    eigenvalues: np.ndarray
    det: np.ndarray
    ok: np.ndarray


def lattice(d: int) -> list[tuple[int, ...]]:
    """Offsets, in steps, at which the metric is needed."""
    axes = [tuple(s * (k == a) for k in range(d)) for a in range(d) for s in (1, -1)]
    near = [(0,) * d, *axes]
    return sorted({tuple(x + y for x, y in zip(p, q, strict=True)) for p, q in product(near, near)})


def _inverse(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses, with those of singular matrices marked."""
    ok = np.isfinite(g).all(axis=(-1, -2))
    safe = np.where(ok[..., None, None], g, np.eye(g.shape[-1]))
    ok &= np.linalg.det(safe) != 0
    safe = np.where(ok[..., None, None], safe, np.eye(g.shape[-1]))
    return np.linalg.inv(safe), ok


def curvature(metric: Metric, at: np.ndarray, step: float = 1e-3) -> Curvature:
    at = np.atleast_2d(np.asarray(at, dtype=float))
    n, d = at.shape
    offsets = lattice(d)
    where = {o: k for k, o in enumerate(offsets)}
    spots = at[:, None, :] + step * np.array(offsets, dtype=float)[None]
    g = metric(spots.reshape(-1, d)).reshape(n, len(offsets), d, d)
    unit = [tuple(int(k == a) for k in range(d)) for a in range(d)]
    ok = np.ones(n, dtype=bool)

    def christoffel(o: tuple[int, ...]) -> np.ndarray:
        nonlocal ok
        inv, good = _inverse(g[:, where[o]])
        ok &= good
        shift = lambda a, s: where[tuple(x + s * y for x, y in zip(o, unit[a], strict=True))]
        dg = np.stack([(g[:, shift(a, 1)] - g[:, shift(a, -1)]) / (2 * step) for a in range(d)], axis=1)  # n, l, i, j
        lower = dg.transpose(0, 2, 3, 1)  # n, i, j, l: derivative of g_ij along l
        first = dg.transpose(0, 1, 2, 3)  # n, i, j, l: derivative of g_jl along i
        sum_ = first + first.transpose(0, 2, 1, 3) - lower
        return 0.5 * np.einsum("nkl,nijl->nkij", inv, sum_)

    origin = (0,) * d
    gamma = christoffel(origin)
    moved = np.stack([(christoffel(unit[a]) - christoffel(tuple(-x for x in unit[a]))) / (2 * step) for a in range(d)], axis=1)  # n, m, r, i, s
    riemann = np.einsum("nmris->nrsmi", moved) - np.einsum("nirms->nrsmi", moved)
    riemann += np.einsum("nrml,nlis->nrsmi", gamma, gamma) - np.einsum("nril,nlms->nrsmi", gamma, gamma)
    ricci = np.einsum("nrsri->nsi", riemann)
    own = g[:, where[origin]]
    inv, _ = _inverse(own)
    scalar = np.einsum("nsi,nsi->n", inv, ricci)
    einstein = ricci - 0.5 * scalar[:, None, None] * own
    finite = np.isfinite(own).all(axis=(1, 2))
    safe = np.where(finite[:, None, None], own, np.eye(d))
    return Curvature(own, inv, gamma, riemann, ricci, scalar, einstein, np.linalg.eigvalsh(0.5 * (safe + safe.transpose(0, 2, 1))), np.linalg.det(safe), ok)


def tensor_norm(t: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """sqrt |t_ij t_ab g^ia g^jb| of each tensor."""
    return np.sqrt(np.abs(np.einsum("nij,nab,nia,njb->n", t, t, inverse, inverse, optimize=True)))


def sphere(radius: float = 1.0) -> Metric:
    """Metric of a sphere in stereographic coordinates: scalar curvature d (d - 1) / radius^2 everywhere."""

    def metric(x: np.ndarray) -> np.ndarray:
        f = 4 * radius**4 / (radius**2 + (x * x).sum(axis=1)) ** 2
        return f[:, None, None] * np.eye(x.shape[1])

    return metric


#: Weights of the surprise's and the rigidity's gradients and of the rigidity itself in the stress tensor.
W_PHI, W_LAM_GRAD, W_LAM = 1.00, 0.75, 0.25


def stress(grad_phi: np.ndarray, lam: np.ndarray, grad_lam: np.ndarray, g: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The information stress tensor at each point."""
    outer = lambda v: v[:, :, None] * v[:, None, :]
    square = lambda v: np.einsum("ni,nij,nj->n", v, inverse, v)
    trace = W_PHI * square(grad_phi) + W_LAM_GRAD * square(grad_lam)
    return W_PHI * outer(grad_phi) + W_LAM_GRAD * outer(grad_lam) + (W_LAM * lam - 0.5 * trace)[:, None, None] * g
