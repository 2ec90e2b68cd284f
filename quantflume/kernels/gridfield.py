"""Fields on regular grids: density, metric, connection and curvature by finite differences."""

from __future__ import annotations

import numpy as np

from quantflume.kernels.curvature import W_LAM, W_LAM_GRAD, W_PHI

#: Regularisation, floors, clips and the grids' margins.
EPS, METRIC_REG, DET_FLOOR, CLIP = 1e-9, 1e-6, 1e-9, 1e6
MARGIN, Q_LOW, Q_HIGH = 0.10, 0.01, 0.99
BANDWIDTH_2D, BANDWIDTH_3D = 0.35, 0.45


def axis(values: np.ndarray, n: int) -> np.ndarray:
    """Equally spaced from the 1 % to the 99 % quantile, a tenth of the span wider on each side."""
    lo, hi = np.quantile(values, [Q_LOW, Q_HIGH])
    span = max(hi - lo, EPS)
    return np.linspace(lo - MARGIN * span, hi + MARGIN * span, n)


def kernel_sums(samples: np.ndarray, axes: list[np.ndarray], h: float, values: np.ndarray | None = None, block: int = 1024) -> np.ndarray:
    """Sum over the samples of values * exp(-distance^2 / 2h^2) at every grid node.

    The kernel is a product over the axes, so a block of samples needs one small
    matrix for each axis and a contraction of them.
    """
    out = np.zeros([len(a) for a in axes])
    letters = "ijk"[: len(axes)]
    for a in range(0, len(samples), block):
        part = samples[a : a + block]
        k = [np.exp(-0.5 * ((g[None, :] - part[:, [c]]) / h) ** 2) for c, g in enumerate(axes)]
        if values is not None:
            k[0] = k[0] * values[a : a + block, None]
        out += np.einsum(",".join(f"n{x}" for x in letters) + "->" + letters, *k, optimize=True)
    return out


def density(samples: np.ndarray, axes: list[np.ndarray], h: float) -> np.ndarray:
    d = len(axes)
    return kernel_sums(samples, axes, h) / len(samples) / (2 * np.pi * h * h) ** (d / 2)


def derivative(f: np.ndarray, steps: list[float], dims: int) -> np.ndarray:
    """Derivatives along the first ``dims`` axes, stacked in front; zeros on grids under three nodes."""
    if min(f.shape[:dims]) < 3:
        return np.zeros((dims, *f.shape))
    return np.stack([np.gradient(f, steps[k], axis=k, edge_order=2) for k in range(dims)])


def interpolate(axes: list[np.ndarray], values: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Multilinear values (extra trailing dimensions allowed) at points, moved to the grid's edge where outside."""
    d = len(axes)
    idx, frac = [], []
    for k, g in enumerate(axes):
        p = np.clip(points[:, k], g[0], g[-1])
        i = np.clip(np.searchsorted(g, p, side="right") - 1, 0, len(g) - 2)
        idx.append(i)
        frac.append((p - g[i]) / np.maximum(g[i + 1] - g[i], EPS))
    out = 0.0
    for corner in np.ndindex(*(2,) * d):
        w = np.ones(len(points))
        for k, c in enumerate(corner):
            w = w * (frac[k] if c else 1 - frac[k])
        v = values[tuple(i + c for i, c in zip(idx, corner, strict=True))]
        out = out + w.reshape(-1, *(1,) * (v.ndim - 1)) * v
    return out


def _christoffel(inverse: np.ndarray, dg: np.ndarray) -> np.ndarray:
    """(..., k, i, j) from the inverse metric and derivatives (l, ..., i, j)."""
    dg = np.moveaxis(dg, 0, -3)  # ..., l, i, j
    sums = dg.swapaxes(-3, -2) + np.moveaxis(dg, -3, -1) - dg  # ..., l, i, j: d_i g_lj + d_j g_il - d_l g_ij
    return np.clip(0.5 * np.einsum("...kl,...lij->...kij", inverse, sums), -CLIP, CLIP)


def field_2d(e: np.ndarray, j: np.ndarray, n: int = 200, h: float = BANDWIDTH_2D) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Axes and named fields of the two-dimensional surprise: gradient, Hessian metric, inverse and connection."""
    axes = [axis(e, n), axis(j, n)]
    steps = [float(a[1] - a[0]) for a in axes]
    rho = density(np.column_stack([e, j]), axes, h)
    phi = -np.log(rho + EPS)
    grad = derivative(phi, steps, 2)
    second = np.stack([derivative(g, steps, 2) for g in grad])
    hess = np.stack([second[0, 0], second[0, 1], second[1, 1]])
    g = np.empty((*phi.shape, 2, 2))
    g[..., 0, 0], g[..., 0, 1], g[..., 1, 1] = hess[0] + METRIC_REG, hess[1], hess[2] + METRIC_REG
    g[..., 1, 0] = g[..., 0, 1]
    det = g[..., 0, 0] * g[..., 1, 1] - g[..., 0, 1] ** 2
    safe = np.where(np.abs(det) < DET_FLOOR, np.where(det >= 0, DET_FLOOR, -DET_FLOOR), det)
    inverse = np.empty_like(g)
    inverse[..., 0, 0], inverse[..., 1, 1] = g[..., 1, 1] / safe, g[..., 0, 0] / safe
    inverse[..., 0, 1] = inverse[..., 1, 0] = -g[..., 0, 1] / safe
    dg = derivative(g, steps, 2)
    gamma = _christoffel(inverse, dg)
    out = {"rho_field": rho, "phi_field": phi, "grad_phi_e": grad[0], "grad_phi_j": grad[1], "grad_phi_norm": np.sqrt((grad**2).sum(axis=0)), "hess_phi_ee": hess[0], "hess_phi_ej": hess[1], "hess_phi_jj": hess[2]}
    out |= {"g_ee": g[..., 0, 0], "g_ej": g[..., 0, 1], "g_jj": g[..., 1, 1], "g_trace": g[..., 0, 0] + g[..., 1, 1], "g_det": det, "g_det_safe": safe}
    out |= {"g_inv_ee": inverse[..., 0, 0], "g_inv_ej": inverse[..., 0, 1], "g_inv_jj": inverse[..., 1, 1], "field_curvature": g[..., 0, 0] + g[..., 1, 1]}
    names = {"ee": (0, 0), "ej": (0, 1), "jj": (1, 1)}
    for k, (a, b) in names.items():
        out |= {f"dE_g_{k}": dg[0][..., a, b], f"dJ_g_{k}": dg[1][..., a, b]}
    for u, upper in enumerate("ej"):
        out |= {f"gamma_{upper}_{k}": gamma[..., u, a, b] for k, (a, b) in names.items()}
    return axes, out


def invert_with_care(g: np.ndarray) -> np.ndarray:
    """Inverses of symmetric 3 x 3 metrics, regularised a little, and ten and a hundred times more where they are near singular."""
    eye = np.eye(g.shape[-1])
    m = 0.5 * (g + np.swapaxes(g, -1, -2)) + METRIC_REG * eye
    det = np.linalg.det(m)
    m = np.where((~np.isfinite(det) | (np.abs(det) < DET_FLOOR))[..., None, None], m + 10 * METRIC_REG * eye, m)
    m = np.where((np.linalg.det(m) == 0)[..., None, None], m + 100 * METRIC_REG * eye, m)
    return np.linalg.inv(m)


def field_3d(samples: np.ndarray, lam: np.ndarray, shape: tuple[int, int, int] = (48, 48, 32), h: float = BANDWIDTH_3D) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Axes and fields of the three-dimensional surprise: scalar curvature, norms, gravity, and the Einstein and stress tensors."""
    axes = [axis(samples[:, k], n) for k, n in enumerate(shape)]
    steps = [float(a[1] - a[0]) for a in axes]
    rho = density(samples, axes, h)
    phi = -np.log(rho + EPS)
    grad = derivative(phi, steps, 3)
    second = np.stack([derivative(g, steps, 3) for g in grad])
    g = np.moveaxis(0.5 * (second + second.swapaxes(0, 1)), (0, 1), (-2, -1)) + METRIC_REG * np.eye(3)
    inverse = invert_with_care(g)
    weight = kernel_sums(samples, axes, h)
    lam_field = kernel_sums(samples, axes, h, lam) / np.maximum(weight, EPS)
    gl, gp = np.moveaxis(derivative(lam_field, steps, 3), 0, -1), np.moveaxis(grad, 0, -1)
    square = lambda v: np.einsum("...i,...ij,...j->...", v, inverse, v, optimize=True)
    t = W_PHI * gp[..., :, None] * gp[..., None, :] + W_LAM_GRAD * gl[..., :, None] * gl[..., None, :] + (W_LAM * lam_field - 0.5 * (W_PHI * square(gp) + W_LAM_GRAD * square(gl)))[..., None, None] * g
    gamma = _christoffel(inverse, derivative(g, steps, 3))
    dgamma = np.moveaxis(derivative(gamma, steps, 3), 0, -4)  # ..., m, k, i, j
    ricci = np.einsum("...kkij->...ij", dgamma) - np.einsum("...jkik->...ij", dgamma)
    ricci += np.einsum("...kij,...lkl->...ij", gamma, gamma, optimize=True) - np.einsum("...lik,...kjl->...ij", gamma, gamma, optimize=True)
    scalar = np.clip(np.einsum("...ij,...ij->...", inverse, ricci), -CLIP, CLIP)
    einstein = ricci - 0.5 * scalar[..., None, None] * g
    norm = lambda x: np.sqrt(np.maximum(np.einsum("...ij,...ab,...ia,...jb->...", x, x, inverse, inverse, optimize=True), 0))
    t_norm, g_norm = norm(t), norm(einstein)
    gravity = np.clip(np.sign(scalar) * np.log1p(np.abs(scalar)) * np.log1p(t_norm) * np.log1p(g_norm), -CLIP, CLIP)
    return axes, {"field_curvature_scalar": scalar, "field_stress_tensor_norm": t_norm, "field_einstein_norm": g_norm, "field_gravity": gravity, "G_info": einstein, "T_info": t}
