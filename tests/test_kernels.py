import numpy as np
import pytest

from quantflume.kernels import curvature as cv
from quantflume.kernels import gridfield, volatility, windows
from quantflume.kernels.density import Density, scott
from tests import simulators

POINTS = np.array([[0.3, -0.2, 0.1], [0.0, 0.0, 0.0], [-0.4, 0.25, 0.6]])

def test_flat_metric_has_no_curvature():
    c = cv.curvature(lambda x: np.broadcast_to(np.diag([2.0, 3.0, 5.0]), (len(x), 3, 3)), POINTS)
    assert np.abs(c.scalar).max() < 1e-9 and c.ok.all()


@pytest.mark.parametrize("dim,radius", [(2, 1.0), (2, 2.0), (3, 1.0), (3, 0.5)])
def test_sphere_has_constant_curvature(dim, radius):
    c = cv.curvature(cv.sphere(radius), POINTS[:, :dim])
    assert np.allclose(c.scalar, dim * (dim - 1) / radius**2, rtol=1e-4)
    if dim == 3 and radius == 1:
        assert np.allclose(c.einstein, -c.g, atol=1e-3)


def test_density_derivatives_against_differences():
    rng = np.random.default_rng(0)
    k, at, d = Density(rng.standard_normal((400, 3)), 0.4), rng.standard_normal((5, 3)), 1e-4
    for a in range(3):
        e = np.eye(3)[a] * d
        assert np.allclose(-(k.log_density(at + e) - k.log_density(at - e)) / (2 * d), k.gradient(at)[:, a], rtol=1e-5, atol=1e-6)
        assert np.allclose((k.gradient(at + e) - k.gradient(at - e)) / (2 * d), k.hessian(at)[:, a], rtol=1e-4, atol=1e-5)


def test_tight_cloud_is_flat():
    k = Density(np.random.default_rng(1).standard_normal((500, 3)) * 1e-4, 0.45)
    assert np.allclose(k.hessian(np.zeros((1, 3)))[0], np.eye(3) / 0.45**2, rtol=1e-6, atol=1e-6)
    assert np.abs(cv.curvature(k.hessian, np.zeros((1, 3))).scalar).max() < 1e-5


def test_fisher_is_semidefinite_and_the_hessian_is_not_between_modes():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.5, (200, 3)) for m in (-1.5, 1.5)])
    k = Density(x, 0.4)
    s, at = k.scores(), rng.standard_normal((20, 3))
    w = k.weights(at)[0]
    assert np.linalg.eigvalsh(k.fisher(s, w)).min() > -1e-9
    assert np.linalg.eigvalsh(k.hessian(np.zeros((1, 3)))).min() < 0
    # leave-one-out scores, sample by sample
    for i in (0, 7, 399):
        rest = Density(np.delete(x, i, axis=0), 0.4)
        assert np.allclose(rest.gradient(x[i : i + 1])[0], s[i], atol=1e-9)


def test_both_informations_agree_on_average():
    rng = np.random.default_rng(3)
    k = Density(rng.standard_t(5, (800, 2)), 0.35)
    draws = k.x[rng.integers(0, 800, 6000)] + 0.35 * rng.standard_normal((6000, 2))
    h, g = k.hessian(draws).mean(axis=0), k.gradient(draws)
    f = (g[:, :, None] * g[:, None, :]).mean(axis=0)
    assert np.allclose(h, f, atol=0.12)


def test_reference_scores_resemble_the_local_ones_on_gaussian_data():
    rng = np.random.default_rng(4)
    k = Density(rng.standard_normal((1500, 3)), 0.7)
    at = rng.standard_normal((60, 3))
    w = k.weights(at)[0]
    a, b = np.trace(k.fisher(k.scores(), w), axis1=1, axis2=2), np.trace(k.fisher(k.reference_scores(), w), axis1=1, axis2=2)
    assert np.corrcoef(np.argsort(np.argsort(a)), np.argsort(np.argsort(b)))[0, 1] > 0.8
    assert scott(1500, 3) == 1500 ** (-1 / 7)


def test_grid_interpolation_and_density():
    axes = [np.linspace(0, 1, 5), np.linspace(-1, 1, 7)]
    f = axes[0][:, None] * 2 + axes[1][None, :] * 3 + 1
    p = np.array([[0.3, 0.2], [1.0, 1.0], [2.0, -5.0]])
    assert np.allclose(gridfield.interpolate(axes, f, p), [2.2, 6.0, 0.0])
    x = np.random.default_rng(5).standard_normal((300, 2))
    nodes = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 2)
    assert np.allclose(gridfield.density(x, axes, 0.35).ravel(), np.exp(Density(x, 0.35).log_density(nodes)))


def test_grid_curvature_of_the_sphere():
    axes = [np.linspace(-0.4, 0.4, 41)] * 3
    nodes = np.stack(np.meshgrid(*axes, indexing="ij"), -1)
    g = cv.sphere(1.0)(nodes.reshape(-1, 3)).reshape(*nodes.shape, 3)
    steps = [axes[0][1] - axes[0][0]] * 3
    inverse = np.linalg.inv(g)
    gamma = gridfield._christoffel(inverse, gridfield.derivative(g, steps, 3))
    assert np.allclose(gamma[20, 20, 30], cv.curvature(cv.sphere(1.0), nodes[20, 20, 30][None]).gamma[0], atol=1e-3)


def test_garch_and_flow_recover_their_parameters():
    r, _ = volatility.garch_paths(6000, 1, **volatility.GARCH)
    p = volatility.fit_garch(r)
    assert abs(p["alpha"] - 0.08) < 0.05 and abs(p["beta"] - 0.9) < 0.06 and 3 < p["nu"] < 6
    b = simulators.flow_bars(8000, 3)
    f = volatility.fit_flow(b["close"], b["volume"], b["taker_buy"], 800)
    assert np.allclose(f.a, simulators.FLOW_A, atol=0.06) and np.allclose(f.b[1:], simulators.FLOW_B[1:], atol=0.06)
    assert abs(f.s1 / 0.5 - 1) < 0.05 and abs(f.s2 / 0.4 - 1) < 0.05 and abs(f.corr - 0.2) < 0.05


def test_t_scale_and_speed():
    r = np.random.default_rng(6).standard_t(4, (1, 200_000)) * 0.003
    assert abs(windows.t_scales(r, np.ones(r.shape, dtype=bool), 4.0)[0] / 0.003 - 1) < 0.01
    rng = np.random.default_rng(7)
    xa, xb = np.column_stack([np.ones(500), rng.standard_normal((500, 2))]), np.column_stack([np.ones(500), rng.standard_normal((500, 3))])
    ends, every = np.array([0, 500]), np.ones(500, dtype=bool)

    def fit(a1):
        pairs = (xa, xa @ [0, a1, 0.1] + 0.5 * np.sin(np.arange(500))), (xb, xb @ [0.3, 0.8, 0.3, 0.0] + 0.4 * np.cos(np.arange(500)))
        return [windows.regressions(windows.Cells(windows.products(x, y, every), ends).over(ends[:1], ends[1:]), x.shape[1]) for x, y in pairs], windows.t_scales(r[:, :500], every[None], 4.0)

    speed = lambda p, q: windows.speeds(p[0], q[0], p[1], q[1], 4.0)
    base = fit(0.3)
    assert speed(base, base)["v_total"][0] == 0
    assert speed(base, fit(0.4))["v_flow"][0] < speed(base, fit(0.8))["v_flow"][0]


def test_windows_equal_plain_regressions():
    """Coefficients, deviations, information and scales of overlapping windows against least squares and a grid of likelihoods."""
    rng = np.random.default_rng(8)
    n = 600
    x = np.column_stack([np.ones(n), rng.standard_normal((n, 2)), rng.random(n)])
    y, use = x @ [1.0, -0.5, 2.0, 0.3] + 0.2 * rng.standard_normal(n), rng.random(n) > 0.2
    low, high = np.arange(0, 300, 30), np.arange(0, 300, 30) + 240
    cells = windows.Cells(windows.products(x, y, use), np.unique(np.concatenate([low, high, np.arange(0, 541, 30)])))
    got = windows.regressions(cells.over(low, high), 4)
    r = 0.01 * rng.standard_t(4, n)
    scales = windows.t_scales(np.stack([r[a:b] for a, b in zip(low, high, strict=True)]), np.stack([use[a:b] for a, b in zip(low, high, strict=True)]), 4.0)
    for k, (a, b) in enumerate(zip(low, high, strict=True)):
        i = np.arange(a, b)[use[a:b]]
        beta = np.linalg.lstsq(x[i], y[i], rcond=None)[0]
        off = y[i] - x[i] @ beta
        assert np.allclose(got["beta"][k], beta, rtol=1e-9) and got["n"][k] == len(i)
        assert np.isclose(got["s"][k], np.sqrt(off @ off / (len(i) - 4)), rtol=1e-9) and np.allclose(got["xx"][k], x[i].T @ x[i])
        cost = lambda s, i=i: (np.log(s) + 2.5 * np.log1p((r[i] / s) ** 2 / 4)).sum()
        assert cost(scales[k]) <= min(cost(scales[k] * f) for f in (0.99, 0.999, 1.001, 1.01))
    one = windows.regressions(cells.over(low[3:4], high[3:4]), 4)
    assert all((one[k][0] == got[k][3]).all() for k in one)  # to the bit, whatever is computed beside it


def test_surrogates_keep_what_they_promise():
    r, _ = volatility.garch_paths(1024, 2, **volatility.GARCH)
    for s in (volatility.surrogate_shuffle(r, 1), volatility.surrogate_spectrum(r, 1)):
        assert np.allclose(np.sort(s), np.sort(r))
    a, b = np.abs(np.fft.rfft(r)), np.abs(np.fft.rfft(volatility.surrogate_spectrum(r, 1)))
    assert np.corrcoef(a, b)[0, 1] > 0.95
    assert (volatility.surrogate_spectrum(r, 1) == volatility.surrogate_spectrum(r, 1)).all()
