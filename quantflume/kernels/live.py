"""One live call: the layers' values over a short tail of one symbol's bars, as arrays.

The layers are defined by ``operators.layers``; for a few hundred bars planning
their expressions costs more than the bars do. A test holds both to each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from quantflume.kernels import gridfield

#: What a call gives besides the bar.
STATES = ["terrain_state", "edge_score", "edge_direction", "edge_signal", "edge_bucket", "expected_value_score", "transition_score"]
GEOMETRIC = ["information_density", "field_stress_geodesic", "rupture_prob_geodesic", "field_curvature_scalar", "field_gravity", "singularity_score", "criticality_score", "singularity_type", "stage"]


def average(x: pd.Series, alpha: float = 0.05) -> pd.Series:
    """The exponential average that starts at the first value."""
    total = weight = 0.0
    out = []
    for k, v in enumerate(x):
        there = v == v
        w = (1.0 if weight == 0 else alpha) if there else 0.0
        total, weight = (1 - alpha) * total + (w * v if there else 0.0), (1 - alpha) * weight + w
        out.append(total / weight if weight > 0 else np.nan)
    return pd.Series(out, index=x.index, dtype=float)


def change(x: pd.Series) -> pd.Series:
    before = x.shift(1)
    return x / before.where(before != 0) - 1


def rigidity(r: pd.Series) -> pd.Series:
    return 1.0 / (r.rolling(30, min_periods=10).std() + 1e-6)


def robust(x: pd.Series) -> pd.Series:
    middle = x.median()
    spread = 1.4826 * (x - middle).abs().median()
    spread = spread if spread > 0 else x.std(ddof=0)
    return (x - middle) / (spread if spread >= 1e-9 else 1.0)


def held(x: pd.Series) -> pd.Series:
    return x.clip(x.quantile(0.005), x.quantile(0.995)) if x.notna().any() else x


def plain_score(x: pd.Series) -> pd.Series:
    middle = x.median()
    spread = (x - middle).abs().median()
    return 0.6745 * (x - middle) / spread if spread >= 1e-12 else pd.Series(0.0, index=x.index)


def attractor(x: np.ndarray, y: np.ndarray, window: int, decay: float, eps: float, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Displacement from the decayed local mean, and how far the mean moved; NaN before a whole window."""
    n = len(x)
    shift, mean = np.full(n, np.nan), np.full((n, 2), np.nan)
    w = decay ** np.arange(window - 1, -1, -1.0)
    for i in range(window - 1, n):
        z = np.stack([x[i - window + 1 : i + 1], y[i - window + 1 : i + 1]])
        mean[i] = (z * w).sum(axis=1) / w.sum()
        cov = (z * w) @ z.T / w.sum() - np.outer(mean[i], mean[i]) + eps * np.eye(2)
        off = z[:, -1] - mean[i]
        shift[i] = np.log1p(max(off @ np.linalg.solve(cov, off), 0.0))
    moved = np.full(n, np.nan)
    moved[lag:] = np.hypot(*(mean[lag:] - mean[:-lag]).T) if n > lag else moved[lag:]
    return shift, moved


def surroundings(x: np.ndarray, y: np.ndarray, sample: np.ndarray, h: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Log density of (x, y) among the sampled rows, and the norm of its numerical gradient."""
    if not sample.any():
        return np.full(len(x), np.nan), np.full(len(x), np.nan)

    def at(dx: float, dy: float) -> np.ndarray:
        q = -((x[:, None] + dx - x[None, sample]) ** 2 + (y[:, None] + dy - y[None, sample]) ** 2) / (2 * h * h)
        top = q.max(axis=1)
        return top + np.log(np.exp(q - top[:, None]).mean(axis=1)) - np.log(2 * np.pi * h * h)

    gx, gy = ((at(a, b) - at(-a, -b)) / (2 * step) for a, b in ((step, 0.0), (0.0, step)))
    return at(0.0, 0.0), np.hypot(gx, gy)


def lines(low: float, high: float, size: int) -> np.ndarray:
    out = low + np.arange(size) * ((high - low) / (size - 1))
    out[-1] = high
    return out


def alignment(x: pd.Series, y: pd.Series, size: int = 40) -> np.ndarray:
    """Cosine of each bar's move and the mean move of the nearest occupied cell; NaN for empty cells and next to no movement."""
    fx, fy = x.diff(), y.diff()
    gx, gy = lines(x.min(), x.max(), size), lines(y.min(), y.max(), size)
    cell = lambda g, v: np.zeros(len(v), dtype=int) if g[0] == g[-1] else np.minimum(np.searchsorted(g, v, side="left"), size - 1)
    cells = pd.DataFrame({"ix": cell(gx, x.to_numpy()), "iy": cell(gy, y.to_numpy()), "fx": fx.to_numpy(), "fy": fy.to_numpy(), "fm": np.hypot(fx, fy).to_numpy()}).groupby(["ix", "iy"]).mean().fillna(0.0)
    force = {k: tuple(v) for k, v in zip(cells.index, cells.to_numpy(), strict=True)}
    nearest = lambda g, used, v: used[np.abs(v.to_numpy()[:, None] - g[used][None]).argmin(axis=1)]
    near = zip(nearest(gx, np.unique(cells.index.get_level_values(0)), x).tolist(), nearest(gy, np.unique(cells.index.get_level_values(1)), y).tolist(), strict=True)
    local = np.array([force.get(k, (np.nan,) * 3) for k in near])
    dx, dy = fx.fillna(0.0).to_numpy(), fy.fillna(0.0).to_numpy()
    whole = local[:, 2] * np.hypot(dx, dy)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(whole > 1e-12, np.clip((local[:, 0] * dx + local[:, 1] * dy) / whole, -1, 1), np.nan)


def trader(close: pd.Series, fixed: dict) -> pd.DataFrame:
    """Terrain, expected value, alignment and edge of finite closes."""
    ret, memory = change(close), average(close)
    gap = robust((close - memory) / (memory.abs() + 1e-9)).fillna(0.0)
    jerk = ret.diff().diff().fillna(0.0)
    x, y = gap.to_numpy(), jerk.to_numpy()
    shift, moved = attractor(x, y, fixed["window"], fixed["decay"], fixed["eps"], fixed["lag"])
    logp, slope = surroundings(x, y, np.isfinite(shift), fixed["h"], fixed["step"])
    parts = [plain_score(held(pd.Series(v, index=close.index).bfill().ffill())) for v in (shift, slope, logp - fixed["depth"] * slope, moved)]
    score = held(parts[0] + parts[1] - parts[2] + parts[3])
    cuts = score.quantile([0.5, 0.8, 0.93]).to_numpy()
    state = [fixed["states"][int((v >= cuts).sum())] if v == v else "UNDEFINED" for v in score]
    ahead, ev = close.shift(-1) / (close + 1e-9) - 1, 0.0
    for on, sign in ((score >= score.quantile(0.95), 1.0), (score <= score.quantile(0.05), -1.0)):
        past = on.astype(float).shift(1).rolling(200, min_periods=1)
        mean = (sign * ahead.where(on)).shift(1).rolling(200, min_periods=1).mean()
        mean = mean.where(past.sum() >= 10).fillna(0.0)
        share = past.mean().where(np.arange(len(close)) >= 10).fillna(0.0)
        ev = ev + share * mean
    edge = (ev * alignment(gap, jerk)).fillna(0.0)
    side = np.where(edge > 0, "LONG", np.where(edge < 0, "SHORT", "NEUTRAL"))
    few = len(close) < 10
    signal = np.zeros(len(close), dtype=int) if few else np.sign(edge.to_numpy()).astype(int)
    return pd.DataFrame({"terrain_state": state, "edge_score": edge, "edge_direction": side, "edge_signal": signal, "edge_bucket": np.where(signal != 0, "ACTIVE", "NEUTRAL"), "expected_value_score": ev, "transition_score": score}, index=close.index)


def geometric(close: pd.Series, fixed: dict, size: int, shape: tuple[int, int, int]) -> pd.DataFrame:
    """Information, geodesic and singularity values of the bars that have all coordinates."""
    df = pd.DataFrame({"v": change(close)})
    df["a"], df["jerk"] = df.v.diff(), df.v.diff().diff()
    df["E"] = df.v**2 + df.a**2
    df["m_flux"], df["lam"] = average(df.E).diff(), rigidity(df.v)
    x, y, h = df.E.to_numpy(), df.jerk.to_numpy(), fixed["h"]
    info = np.zeros(len(df))
    for i in range(40, len(df)):
        past = np.isfinite(x[max(0, i - 200) : i]) & np.isfinite(y[max(0, i - 200) : i])
        if past.sum() >= 10 and np.isfinite(x[i]) and np.isfinite(y[i]):
            px, py = x[max(0, i - 200) : i][past], y[max(0, i - 200) : i][past]
            info[i] = np.exp(-((x[i] - px) ** 2 + (y[i] - py) ** 2) / (2 * h * h)).mean() / (2 * np.pi * h * h)
    df["information_density"] = info
    df = df[df[["E", "jerk", "m_flux", "lam"]].notna().all(axis=1)].copy()
    if not len(df):
        return pd.DataFrame(columns=GEOMETRIC)
    points = df[["E", "jerk", "m_flux"]].to_numpy()
    for dims, make in ((2, lambda: gridfield.field_2d(points[:, 0], points[:, 1], size)), (3, lambda: gridfield.field_3d(points, df.lam.to_numpy(), shape))):
        axes, fields = make()
        names = [n for n, f in fields.items() if f.ndim == dims]
        got = gridfield.interpolate(axes, np.stack([fields[n] for n in names], axis=-1), points[:, :dims])
        for k, n in enumerate(names):
            df[n] = np.where(np.isfinite(got[:, k]), got[:, k], np.nan)
    me, mj = average(df.E), average(df.jerk)
    dx, dy = df.E - me, df.jerk - mj
    df["geom_incoherence_abs"] = (df.g_ee * dx * dx + 2 * df.g_ej * dx * dy + df.g_jj * dy * dy).abs()
    ve, vj = df.E.diff(), df.jerk.diff()
    acc = [(-(df[f"gamma_{u}_ee"] * ve * ve + 2 * df[f"gamma_{u}_ej"] * ve * vj + df[f"gamma_{u}_jj"] * vj * vj)).clip(-1e6, 1e6) for u in "ej"]
    seen = [df[c].diff().diff().fillna(0.0) for c in ("E", "jerk")]
    df["acc_geo_norm"] = np.sqrt(acc[0] ** 2 + acc[1] ** 2)
    df["geo_resid_norm"] = np.sqrt((seen[0] - acc[0]) ** 2 + (seen[1] - acc[1]) ** 2)
    df["jerk_over_lambda"] = df.jerk.abs() / (df.lam.abs() + 1e-9)
    weigh = lambda ws, of: sum(w * of[c] for c, w in ws.items())
    df["field_stress_geodesic"] = weigh(fixed["stress"], df.abs())
    df["rupture_prob_geodesic"] = 1 / (1 + np.exp(-(fixed["rupture_base"] + weigh(fixed["rupture"], df.abs())).clip(-60, 60)))
    r, t = df.field_curvature_scalar.fillna(0.0), df.field_stress_tensor_norm.fillna(0.0)
    pull = np.sign(r) * np.log1p(r.abs()) * np.log1p(t.abs())
    zero = lambda c: df[c].fillna(0.0)
    raw = {"rigidity_log": 1 / (df.lam.abs() + 1e-9), "det_log": 1 / (df.g_det.abs() + 1e-9), "ginv_log": np.sqrt(df.g_inv_ee**2 + 2 * df.g_inv_ej**2 + df.g_inv_jj**2)}
    raw |= {"gamma_log": sum(zero(f"gamma_{u}_{k}").abs() for u in "ej" for k in ("ee", "ej", "jj")), "curvature_log": df.field_curvature.abs(), "curvature_scalar_log": df.field_curvature_scalar.abs(), "einstein_log": df.field_einstein_norm.abs(), "gravity_log": df.field_gravity.abs(), "grav_stress_log": pull.abs()}
    raw |= {"stress_log": zero("field_stress_geodesic") + zero("geom_incoherence_abs") + zero("geo_resid_norm") + zero("field_stress_tensor_norm") + pull.abs()}
    raw |= {"incoherence_log": zero("geom_incoherence_abs"), "geo_resid_log": zero("geo_resid_norm"), "memory_flux_log": me.diff().fillna(0.0).abs(), "jerk_lambda_log": zero("jerk_over_lambda"), "grad_phi_log": zero("grad_phi_norm"), "stress_geodesic_log": zero("field_stress_geodesic"), "stress_tensor_log": zero("field_stress_tensor_norm"), "rupture_log": zero("rupture_prob_geodesic")}
    logs = pd.DataFrame({k: np.log1p(v.clip(lower=0)).clip(upper=50) for k, v in raw.items()})
    scores = pd.DataFrame({k: weigh(ws, logs) for k, ws in fixed["scores"].items()})
    single = weigh(fixed["composite"], pd.concat([scores, logs], axis=1)).clip(-1e6, 1e6)
    critical = weigh(fixed["critical"], logs).clip(-1e6, 1e6)
    df["singularity_score"], df["criticality_score"] = single, critical
    with np.errstate(invalid="ignore"):
        df["stage"] = np.where(single >= single.quantile(0.99), "singularity_extreme", np.where(single >= single.quantile(0.95), "singularity", np.where(critical >= critical.quantile(0.95), "criticality", "normal")))
    value = scores.fillna(-np.inf).to_numpy()
    order = np.sort(value, axis=1)
    mixed = (order[:, -2] > 0) & (order[:, -1] / np.maximum(order[:, -2], 1e-9) < fixed["dominance"])
    df["singularity_type"] = np.where(mixed, "compound", np.array(fixed["types"])[value.argmax(axis=1)])
    return df[GEOMETRIC]


def call(times: np.ndarray, close: np.ndarray, fixed: dict, size: int, shape: tuple[int, int, int]) -> pd.DataFrame:
    """A row for each bar with a finite close: its trader values and the geometric ones of the nearest bar that has them, within the usual tolerance."""
    whole = pd.Series(close, dtype=float)
    fine = np.isfinite(whole.to_numpy())
    out = trader(whole[fine], fixed)
    at = times[fine]
    geo = geometric(whole.where(fine), fixed, size, shape)
    steps = np.diff(at)
    limit = min(max(2 * float(np.median(steps)) if len(steps) else 0.0, 30_000.0), 300_000.0)
    for c in GEOMETRIC:
        out[c] = None if c in ("singularity_type", "stage") else np.nan
    if len(geo):
        gap = np.abs(at[:, None] - times[geo.index.to_numpy()][None])
        near = gap.argmin(axis=1)
        ok = gap[np.arange(len(at)), near] <= limit
        for c in GEOMETRIC:
            out[c] = pd.Series(np.where(ok, geo[c].to_numpy(dtype=object)[near], None), index=out.index, dtype=object)
    out["criticality_score"] = out["criticality_score"].astype(float)
    return out.assign(bar_ms=at, close=whole[fine].to_numpy(), is_high_critical=(out.criticality_score >= 0.70).astype(int), is_extreme_critical=(out.criticality_score >= 0.90).astype(int))
