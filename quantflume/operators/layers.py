"""The layered state pipeline: input, information field, terrain, expected value, force, edge and singularity layers.

Each layer is one DataFrame function over (symbol, bar_ms). Layers marked
"looks ahead" use statistics of the whole series, as labels need; the energy of
price against its memory is ``E_gap``, that of motion (v^2 + a^2) is ``E``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflume.functions import robust, series
from quantflume.functions.scalar import clip, direction, finite, flag, label_by_cuts, log_component, logistic, require, valid_flag
from quantflume.functions.series import KEY, TIME, by_time, rows

#: Fixed values of the terrain: window, decay, regularisation, kernel, step, depth weight and hysteresis lag.
WINDOW, DECAY, COV_EPS, BANDWIDTH, DELTA, DEPTH, HYST = 80, 0.97, 1e-4, 0.35, 0.03, 0.60, 10
STATES = ["COHERENT", "TENSIONED", "TRANSITION_EDGE", "RUPTURE_CORRIDOR"]


def input_layer(bars: DataFrame) -> DataFrame:
    """Returns, forward returns, memory, kinematics, gap energy, rigidity and validity of cleaned bars. Looks ahead (labels, robust z)."""
    require(bars, KEY, TIME, "open", "high", "low", "close", "volume")
    df = bars.withColumn("close", finite("close")).where(F.col("close").isNotNull())
    df = df.withColumn("ret", series.pct_change("close"))
    df = series.ema(df, "close", "memory_close")
    df = df.select(
        "*",
        *[series.forward_return("close", k).alias(f"ret_fwd_{k}") for k in (1, 3, 5)],
        series.difference("memory_close").alias("memory_flux"),
        F.col("ret").alias("velocity"),
        series.difference("ret").alias("acceleration"),
        series.difference("ret", 2).alias("jerk"),
        ((F.col("close") - F.col("memory_close")) / (F.abs("memory_close") + 1e-9)).alias("E_raw"),
        series.rigidity("ret").alias("lambda_dynamic"),
    )
    df = robust.robust_z(df, {"E_gap": "E_raw"})
    named = ["ret", "ret_fwd_1", "ret_fwd_3", "ret_fwd_5", "memory_close", "memory_flux", "velocity", "acceleration", "jerk", "E_raw", "E_gap", "lambda_dynamic"]
    return df.withColumn("input_valid", valid_flag("open", "high", "low", "close", "volume", *named)).fillna(0.0, named)


def motion(bars: DataFrame) -> DataFrame:
    """v, a, jerk, E = v^2 + a^2, its memory and the memory's flux, rigidity: the geometric coordinates (all causal)."""
    df = bars.withColumn("v", series.pct_change("close"))
    df = df.select("*", series.difference("v").alias("a"), series.difference("v", 2).alias("jerk"))
    df = df.withColumn("E", F.col("v") ** 2 + F.col("a") ** 2)
    df = series.ema(df, "E", "mem_e")
    return df.select("*", series.difference("mem_e").alias("m_flux"), series.rigidity("v").alias("lam"))


def information_layer(df: DataFrame, x: str = "E", y: str = "jerk", size: int = 200, h: float = BANDWIDTH) -> DataFrame:
    """``df`` with the kernel density of (x, y) among the bars before, and its first two differences.

    0 until ``size / 5`` bars have passed and ten of them are complete. The
    frame travels as one array per bar and is folded inside the JVM.
    """
    w = rows(-size, -1)
    df = df.withColumn("_p", F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    df = df.withColumn("_past", F.collect_list("_p").over(w)).withColumn("_bars", F.count(F.lit(1)).over(w))
    q = lambda p: F.exp(-((F.col(x) - p["x"]) ** 2 + (F.col(y) - p["y"]) ** 2) / (2 * h * h))
    total = F.aggregate("_past", F.lit(0.0), lambda s, p: s + q(p))
    ok = (F.col("_bars") >= max(10, size // 5)) & (F.size("_past") >= 10) & F.col("_p").isNotNull()
    df = df.withColumn("information_density", F.when(ok, total / F.size("_past") / (2 * np.pi * h * h)).otherwise(0.0)).drop("_p", "_past", "_bars")
    return df.select("*", F.coalesce(series.difference("information_density"), F.lit(0.0)).alias("information_gradient"), F.coalesce(series.difference("information_density", 2), F.lit(0.0)).alias("information_acceleration"))


def attractor_layer(df: DataFrame, x: str = "E_gap", y: str = "jerk") -> DataFrame:
    """``df`` with the decayed local mean and covariance of (x, y), its inverse, the displacement from the mean, and how far the mean moved.

    A finite window of decayed weights is the whole decayed sum less the sum
    ``WINDOW`` bars ago, decayed; so running sums do, whatever the window.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.row_number().over(by_time())
    df = df.withColumn("_n", n)
    sums = {"_s0": F.lit(1.0), "_sx": F.col(x), "_sy": F.col(y), "_sxx": F.col(x) * F.col(x), "_sxy": F.col(x) * F.col(y), "_syy": F.col(y) * F.col(y)}
    df = series.decayed_sums(df, 1 - DECAY, **sums)
    cut = DECAY**WINDOW
    local = {k: F.col(k) - cut * F.coalesce(F.lag(k, WINDOW).over(by_time()), F.lit(0.0)) for k in sums}
    df = df.select("*", *[c.alias(f"{k}w") for k, c in local.items()])
    full = F.col("_n") >= WINDOW
    mean = lambda k: F.when(full, F.col(f"{k}w") / F.col("_s0w"))
    mx, my = mean("_sx"), mean("_sy")
    df = df.withColumn("attractor_E", mx).withColumn("attractor_jerk", my)
    ax, ay = F.col("attractor_E"), F.col("attractor_jerk")
    df = df.withColumn("cov_11", mean("_sxx") - ax * ax + COV_EPS).withColumn("cov_12", mean("_sxy") - ax * ay).withColumn("cov_22", mean("_syy") - ay * ay + COV_EPS)
    det = F.col("cov_11") * F.col("cov_22") - F.col("cov_12") ** 2
    df = df.withColumn("fisher_11", F.col("cov_22") / det).withColumn("fisher_12", -F.col("cov_12") / det).withColumn("fisher_22", F.col("cov_11") / det)
    dx, dy = F.col(x) - ax, F.col(y) - ay
    raw = F.when(ax.isNotNull(), F.greatest(dx * dx * F.col("fisher_11") + 2 * dx * dy * F.col("fisher_12") + dy * dy * F.col("fisher_22"), F.lit(0.0)))
    df = df.withColumn("displacement_raw", raw).withColumn("displacement", F.log1p("displacement_raw"))
    moved = F.sqrt((ax - F.lag(ax, HYST).over(by_time())) ** 2 + (ay - F.lag(ay, HYST).over(by_time())) ** 2)
    return df.withColumn("hysteresis", moved).drop("_n", *sums, *[f"{k}w" for k in sums])


#: Stencil of the numerical derivatives, in steps.
_STENCIL = np.array([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)], dtype=float)


def density_layer(df: DataFrame, x: str = "E_gap", y: str = "jerk", fitted: str | None = "displacement", h: float = BANDWIDTH, step: float = DELTA, tile: int = 2048, together: int = 32) -> DataFrame:
    """``df`` with the log density of (x, y) over the symbol's whole series, numerical gradient and Hessian, and basin depth. Looks ahead.

    Samples are the bars whose ``fitted`` isn't null. Every bar meets every
    sample by the definition. Bars and samples come in tiles; a task has one
    tile of bars and up to ``together`` tiles of samples, whose sums it adds
    up, so that a symbol's pairs spread over (tiles * tiles / together) tasks
    and a bar leaves each with one partial sum for each point of the stencil.

    Bars with a null x or y have nulls; bars that repeat a time are rows of
    their own; without a sample a symbol's densities are null.
    """
    n = F.row_number().over(Window.partitionBy(KEY).orderBy(TIME, x, y)) - 1
    numbered = df.withColumn("_n", n.cast("long"))
    at = numbered.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(KEY, "_n", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.floor(F.col("_n") / tile).alias("_t"), F.col(fitted).isNotNull().alias("s") if fitted else F.lit(True).alias("s"))
    tiles = at.groupBy(KEY, "_t").agg(F.collect_list("_n").alias("n"), F.collect_list("x").alias("x"), F.collect_list("y").alias("y"), F.collect_list("s").alias("s"))
    tiles = tiles.withColumn("_last", F.max("_t").over(Window.partitionBy(KEY)))
    group = F.floor(F.col("_t") / together)
    points = tiles.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / together)))).select(KEY, F.col("_t").alias("_a"), "_g", F.lit(True).alias("of"), "n", "x", "y", "s")
    samples = tiles.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).select(KEY, "_a", group.alias("_g"), F.lit(False).alias("of"), "n", "x", "y", "s")

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        own, others = pdf[pdf["of"]], pdf[~pdf["of"]]
        names = [KEY, "_n", "m", "top", "sum"]
        if not len(own):
            return pd.DataFrame(columns=names)
        px, py = (np.asarray(own[c].iloc[0], dtype=float) for c in "xy")
        sx, sy = (np.concatenate([np.asarray(v, dtype=float)[np.asarray(s, dtype=bool)] for v, s in zip(others[c], others["s"], strict=True)] or [np.zeros(0)]) for c in "xy")
        if not len(sx):
            return pd.DataFrame(columns=names)
        top, total = np.full((len(px), 9), -np.inf), np.zeros((len(px), 9))
        for a in range(0, len(px), 64):
            part = slice(a, a + 64)
            for b in range(0, len(sx), 4096):
                # squares along each axis once for each of its three offsets
                qx, qy = ({d: -((p[part, None] + step * d - v[None, b : b + 4096]) ** 2) / (2 * h * h) for d in (-1, 0, 1)} for p, v in ((px, sx), (py, sy)))
                for c, (i, j) in enumerate(_STENCIL.astype(int).tolist()):
                    q = qx[i] + qy[j]
                    new = np.maximum(top[part, c], q.max(axis=1))
                    total[part, c] = total[part, c] * np.exp(top[part, c] - new) + np.exp(q - new[:, None]).sum(axis=1)
                    top[part, c] = new
        return pd.DataFrame({KEY: own[KEY].iloc[0], "_n": own["n"].iloc[0], "m": len(sx), "top": list(top), "sum": list(total)})

    kind = dict(df.dtypes)[KEY]
    sums = points.unionByName(samples).groupBy(KEY, "_a", "_g").applyInPandas(partial, f"{KEY} {kind}, _n long, m long, top array<double>, sum array<double>")
    # log of a sum of exponentials of partial logs, around their maximum
    tops = [F.max(F.col("top")[c]).alias(f"_t{c}") for c in range(9)]
    parts = F.collect_list(F.struct("top", "sum")).alias("_parts")  # one for each group of sample tiles
    total = sums.groupBy(KEY, "_n").agg(F.sum("m").alias("_m"), *tops, parts)

    def log_density(c: int) -> Column:
        raised = F.aggregate("_parts", F.lit(0.0), lambda s, v: s + v["sum"][c] * F.exp(v["top"][c] - F.col(f"_t{c}")))
        return F.col(f"_t{c}") + F.log(raised) - F.log(F.col("_m") * (2 * np.pi * h * h))

    out = total.select(F.col(KEY).alias("_key"), F.col("_n").alias("_k"), *[c.alias(f"_p{k}") for k, c in enumerate(map(log_density, range(9)))])
    p = [F.col(f"_p{k}") for k in range(9)]
    out = out.select("_key", "_k", p[0].alias("log_density"), ((p[1] - p[2]) / (2 * step)).alias("grad_logp_E"), ((p[3] - p[4]) / (2 * step)).alias("grad_logp_jerk"), ((p[1] - 2 * p[0] + p[2]) / step**2).alias("_h11"), ((p[3] - 2 * p[0] + p[4]) / step**2).alias("_h22"), ((p[5] - p[6] - p[7] + p[8]) / (4 * step**2)).alias("_h12"))
    mid, half = (F.col("_h11") + F.col("_h22")) / 2, F.sqrt(((F.col("_h11") - F.col("_h22")) / 2) ** 2 + F.col("_h12") ** 2)
    norm = F.sqrt(F.col("grad_logp_E") ** 2 + F.col("grad_logp_jerk") ** 2)
    out = out.select("*", norm.alias("curvature"), (2 * mid).alias("hessian_trace"), F.greatest(F.abs(mid + half), F.abs(mid - half)).alias("hessian_maxeig_abs"))
    out = out.withColumn("basin_depth", F.col("log_density") - DEPTH * F.col("curvature")).drop("_h11", "_h22", "_h12")
    return numbered.join(out, F.col(KEY).eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("_k")), "left").drop("_n", "_k", "_key")


def terrain_score(df: DataFrame) -> DataFrame:
    """``df`` with transition score and state from displacement, curvature, basin depth and hysteresis. Looks ahead (fills, quantiles)."""
    parts = {"disp": "displacement", "curv": "curvature", "basin": "basin_depth", "hyst": "hysteresis"}
    df = df.select("*", *[series.filled(c).alias(f"_f_{k}") for k, c in parts.items()])
    df = robust.winsorized(df, {f"{k}_w": f"_f_{k}" for k in parts})
    df = robust.robust_z_plain(df, {f"z_{k}": f"{k}_w" for k in parts})
    df = df.withColumn("transition_score_raw", F.col("z_disp") + F.col("z_curv") - F.col("z_basin") + F.col("z_hyst"))
    df = robust.winsorized(df, {"transition_score": "transition_score_raw"})
    return terrain_state(df).drop(*[f"_f_{k}" for k in parts])


def terrain_state(df: DataFrame, score: str = "transition_score") -> DataFrame:
    """``df`` with the state by the score's 50, 80 and 93 % quantiles. Looks ahead."""
    df = robust.quantiles(df, {"_q1": (score, 0.50), "_q2": (score, 0.80), "_q3": (score, 0.93)})
    return df.withColumn("terrain_state", label_by_cuts(F.col(score), [F.col("_q1"), F.col("_q2"), F.col("_q3")], STATES, "UNDEFINED")).drop("_q1", "_q2", "_q3")


def expected_value(df: DataFrame, score: str = "transition_score", size: int = 200) -> DataFrame:
    """``df`` with the score's extreme signals, the mean outcome and share of such bars among those before, and their sum of products. Looks ahead."""
    df = robust.quantiles(df, {"_hi": (score, 0.95), "_lo": (score, 0.05)})
    df = df.select("*", *[series.forward_return("close", k).alias(f"_f{k}") for k in (1, 3, 5)], flag(F.col(score) >= F.col("_hi")).alias("signal_long"), flag(F.col(score) <= F.col("_lo")).alias("signal_short"))
    w, out = rows(-size, -1), []
    for side, sign in (("long", 1.0), ("short", -1.0)):
        on = F.col(f"signal_{side}") > 0
        enough = F.sum(F.col(f"signal_{side}")).over(w) >= 10
        for k in (1, 3, 5):
            out.append(F.coalesce(F.when(enough, F.avg(F.when(on, sign * F.col(f"_f{k}"))).over(w)), F.lit(0.0)).alias(f"ev_{side}_{k}"))
        out.append(F.coalesce(F.when(F.count(F.lit(1)).over(w) >= 10, F.avg(F.col(f"signal_{side}").cast("double")).over(w)), F.lit(0.0)).alias(f"prob_{side}"))
    df = df.select("*", *out).drop("_hi", "_lo", "_f1", "_f3", "_f5")
    return df.withColumn("expected_value_score", F.col("prob_long") * F.col("ev_long_1") + F.col("prob_short") * F.col("ev_short_1"))


def edge_signal(df: DataFrame, ev: str = "expected_value_score", cos: str = "force_alignment_cos") -> DataFrame:
    """``df`` with the edge score, its gates, direction, signal (1, -1, 0) and bucket."""
    e, c = F.col(ev), F.col(cos)
    df = df.withColumn("edge_score", F.coalesce(e * c, F.lit(0.0)))
    gates = {"edge_valid_long": (e > 0) & (c > 0.25), "edge_valid_short": (e > 0) & (c < -0.25), "edge_strong_long": (e > 0) & (c > 0.50), "edge_strong_short": (e > 0) & (c < -0.50)}
    df = df.select("*", *[flag(g).alias(n) for n, g in gates.items()], direction(F.col("edge_score")).alias("edge_direction"))
    signal = F.when(F.upper("edge_direction") == "LONG", 1).when(F.upper("edge_direction") == "SHORT", -1).otherwise(0)
    return df.withColumn("edge_signal", signal).withColumn("edge_bucket", F.when(F.col("edge_signal") != 0, "ACTIVE").otherwise("NEUTRAL"))


def neutral_if_short(df: DataFrame, least: int = 10) -> DataFrame:
    """Edge columns made neutral for symbols with fewer than ``least`` bars."""
    few = F.count(F.lit(1)).over(Window.partitionBy(KEY)) < least
    return df.withColumn("_few", few).withColumn("edge_signal", F.when(F.col("_few"), 0).otherwise(F.col("edge_signal"))).withColumn("edge_bucket", F.when(F.col("_few"), "NEUTRAL").otherwise(F.col("edge_bucket"))).drop("_few")


#: The geodesic stress's and the rupture score's weights.
STRESS = {"geom_incoherence_abs": 1.00, "grad_phi_norm": 0.50, "geo_resid_norm": 1.00, "acc_geo_norm": 0.25, "field_curvature": 0.25, "jerk_over_lambda": 0.50}
RUPTURE = {"geo_resid_norm": 1.00, "acc_geo_norm": 0.50, "grad_phi_norm": 0.40, "geom_incoherence_abs": 0.50, "field_curvature": 0.30, "jerk_over_lambda": 0.40}
RUPTURE_BASE = -2.0


def geodesic_outputs(df: DataFrame, x: str = "E", y: str = "jerk", lam: str = "lam") -> DataFrame:
    """``df`` (with metric, connection and gradient at each bar) with incoherence, geodesic acceleration, residual, stress and rupture probability."""
    df = series.ema(series.ema(df, x, "mem_e"), y, "mem_j")
    dx, dy = F.col(x) - F.col("mem_e"), F.col(y) - F.col("mem_j")
    df = df.withColumn("geom_incoherence", F.col("g_ee") * dx * dx + 2 * F.col("g_ej") * dx * dy + F.col("g_jj") * dy * dy).withColumn("geom_incoherence_abs", F.abs("geom_incoherence"))
    df = df.select("*", series.difference(x).alias("vel_e"), series.difference(y).alias("vel_j"), F.coalesce(series.difference(x, 2), F.lit(0.0)).alias("acc_obs_e"), F.coalesce(series.difference(y, 2), F.lit(0.0)).alias("acc_obs_j"))
    ve, vj = F.col("vel_e"), F.col("vel_j")
    acc = lambda u: clip(-(F.col(f"gamma_{u}_ee") * ve * ve + 2 * F.col(f"gamma_{u}_ej") * ve * vj + F.col(f"gamma_{u}_jj") * vj * vj), -1e6, 1e6)
    df = df.withColumn("acc_geo_e", acc("e")).withColumn("acc_geo_j", acc("j"))
    norm = lambda a, b: F.sqrt(F.col(a) ** 2 + F.col(b) ** 2)
    df = df.withColumn("acc_geo_norm", norm("acc_geo_e", "acc_geo_j")).withColumn("geo_resid_e", F.col("acc_obs_e") - F.col("acc_geo_e")).withColumn("geo_resid_j", F.col("acc_obs_j") - F.col("acc_geo_j"))
    df = df.withColumn("geo_resid_norm", norm("geo_resid_e", "geo_resid_j")).withColumn("jerk_over_lambda", F.coalesce(F.abs(y), F.lit(0.0)) / (F.coalesce(F.abs(lam), F.lit(0.0)) + 1e-9))
    weigh = lambda ws: sum((w * F.abs(c) for c, w in ws.items()), F.lit(0.0))
    df = df.withColumn("field_stress_geodesic", weigh(STRESS)).withColumn("rupture_prob_geodesic", logistic(RUPTURE_BASE + weigh(RUPTURE)))
    return df.withColumn("memory_flux", F.coalesce(series.difference("mem_e"), F.lit(0.0))).withColumn("geodesic_valid", valid_flag("vel_e", "vel_j", "acc_geo_e", "acc_geo_j", "geo_resid_e", "geo_resid_j", "field_stress_geodesic"))


def gravity(scalar: Column, stress: Column, einstein: Column, kappa: float = 1.0) -> Column:
    """kappa * sign(R) log(1 + |R|) log(1 + |T|) log(1 + |G|), within a million."""
    return clip(kappa * F.signum(scalar) * F.log1p(F.abs(scalar)) * F.log1p(F.abs(stress)) * F.log1p(F.abs(einstein)), -1e6, 1e6)


def gravitational_stress(scalar: Column, stress: Column) -> Column:
    r, t = F.coalesce(scalar, F.lit(0.0)), F.coalesce(stress, F.lit(0.0))
    return F.signum(r) * F.log1p(F.abs(r)) * F.log1p(F.abs(t))


#: Weights of the singularity layer's scores.
SCORES = {
    "sing_rigidity": {"rigidity_log": 0.60, "jerk_lambda_log": 0.25, "memory_flux_log": 0.15},
    "sing_curvature": {"det_log": 0.15, "ginv_log": 0.10, "gamma_log": 0.15, "curvature_log": 0.20, "curvature_scalar_log": 0.20, "einstein_log": 0.20},
    "sing_stress": {"stress_log": 0.30, "incoherence_log": 0.20, "geo_resid_log": 0.15, "grad_phi_log": 0.10, "stress_geodesic_log": 0.10, "stress_tensor_log": 0.15},
    "sing_gravity": {"gravity_log": 0.35, "einstein_log": 0.25, "grav_stress_log": 0.20, "curvature_scalar_log": 0.20},
}
COMPOSITE = {"sing_rigidity": 0.90, "sing_curvature": 1.00, "sing_stress": 1.00, "sing_gravity": 1.10, "rupture_log": 0.20}
CRITICAL = {"rigidity_log": 0.20, "incoherence_log": 0.20, "curvature_log": 0.15, "curvature_scalar_log": 0.15, "grad_phi_log": 0.10, "geo_resid_log": 0.10, "memory_flux_log": 0.10}
TYPES = ["rigidity", "curvature", "stress", "gravity"]
DOMINANCE = 1.12
GAMMAS = [f"gamma_{u}_{k}" for u in "ej" for k in ("ee", "ej", "jj")]


def singularity_scores(df: DataFrame, lam: str = "lam") -> DataFrame:
    """``df`` with log components, type scores, the composite and the criticality score. Missing inputs weigh as the layers before left them."""
    c = lambda name: F.col(name)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    gammas = sum((F.abs(zero(c(g))) for g in GAMMAS), F.lit(0.0))
    ginv = F.sqrt(c("g_inv_ee") ** 2 + 2 * c("g_inv_ej") ** 2 + c("g_inv_jj") ** 2)
    energy = zero(c("field_stress_geodesic")) + zero(c("geom_incoherence_abs")) + zero(c("geo_resid_norm")) + zero(c("field_stress_tensor_norm")) + zero(F.abs("gravitational_stress_score"))
    logs = {
        "rigidity_log": 1 / (F.abs(lam) + 1e-9),
        "det_log": 1 / (F.abs("g_det") + 1e-9),
        "ginv_log": ginv,
        "gamma_log": gammas,
        "curvature_log": F.abs("field_curvature"),
        "curvature_scalar_log": F.abs("field_curvature_scalar"),
        "einstein_log": F.abs("field_einstein_norm"),
        "gravity_log": F.abs("field_gravity"),
        "grav_stress_log": F.abs("gravitational_stress_score"),
        "stress_log": energy,
        "incoherence_log": zero(c("geom_incoherence_abs")),
        "geo_resid_log": zero(c("geo_resid_norm")),
        "memory_flux_log": zero(F.abs("memory_flux")),
        "jerk_lambda_log": zero(c("jerk_over_lambda")),
        "grad_phi_log": zero(c("grad_phi_norm")),
        "stress_geodesic_log": zero(c("field_stress_geodesic")),
        "stress_tensor_log": zero(c("field_stress_tensor_norm")),
        "rupture_log": zero(c("rupture_prob_geodesic")),
    }
    df = df.select("*", *[log_component(x).alias(n) for n, x in logs.items()])
    weigh = lambda ws: sum((w * F.col(n) for n, w in ws.items()), F.lit(0.0))
    df = df.select("*", *[weigh(ws).alias(n) for n, ws in SCORES.items()])
    return df.withColumn("singularity_score", clip(weigh(COMPOSITE), -1e6, 1e6)).withColumn("criticality_score", clip(weigh(CRITICAL), -1e6, 1e6))


def dominant_type(names: list[str] = TYPES, scores: list[str] | None = None, close: float = DOMINANCE) -> Column:
    """Name of the largest score (the first of equals), or "compound" if the second is positive and near it."""
    values = F.array(*[F.coalesce(F.col(s), F.lit(float("-inf"))) for s in scores or list(SCORES)])
    order = F.array_sort(values)
    top, second = F.element_at(order, -1), F.element_at(order, -2)
    name = F.element_at(F.array(*map(F.lit, names)), F.array_position(values, top).cast("int"))
    return F.when((second > 0) & (top / F.greatest(second, F.lit(1e-9)) < close), "compound").otherwise(name)


def singularity_alerts(df: DataFrame) -> DataFrame:
    """``df`` with scaled scores, alerts by quantiles, dominant type and stage. Looks ahead."""
    for s in ("singularity", "criticality"):
        df = df.withColumn(f"_{s}", F.coalesce(f"{s}_score", F.lit(0.0)))
    df = robust.robust_z(df, {"singularity_z": "_singularity", "criticality_z": "_criticality"})
    df = robust.minmax(df, {"singularity_01": "_singularity", "criticality_01": "_criticality"})
    df = df.withColumn("singularity_prob", logistic(F.col("singularity_z"))).withColumn("criticality_prob", logistic(F.col("criticality_z")))
    cuts = {f"singularity_alert_q{q}": ("singularity_score", q / 100) for q in (90, 95, 99)} | {"criticality_alert_q95": ("criticality_score", 0.95)} | {f"{s}_alert": (s, 0.95) for s in SCORES}
    df = df.withColumn("_ricci", F.abs("field_curvature_scalar")).withColumn("_gravity", F.abs("field_gravity")).withColumn("_einstein", F.abs("field_einstein_norm"))
    cuts |= {"ricci_alert": ("_ricci", 0.95), "gravity_alert": ("_gravity", 0.95), "einstein_alert": ("_einstein", 0.95)}
    df = robust.quantiles(df, {f"_q_{n}": c for n, c in cuts.items()})
    df = df.select("*", *[flag(F.col(c) >= F.col(f"_q_{n}")).alias(n) for n, (c, _) in cuts.items()])
    stage = F.when(F.col("singularity_alert_q99") == 1, "singularity_extreme").when(F.col("singularity_alert_q95") == 1, "singularity").when(F.col("criticality_alert_q95") == 1, "criticality").otherwise("normal")
    df = df.withColumn("singularity_type", dominant_type()).withColumn("stage", stage)
    return df.drop("_singularity", "_criticality", "_ricci", "_gravity", "_einstein", *[f"_q_{n}" for n in cuts])


def criticality_flags(score: Column) -> dict[str, Column]:
    """The live flags: high at 0.70, extreme at 0.90 of a score that isn't bounded."""
    return {"is_high_critical": flag(score >= 0.70), "is_extreme_critical": flag(score >= 0.90)}


