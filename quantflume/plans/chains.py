"""Whole pipelines: the offline chain of layers, the live tail, the three-sleeve backtest and numerical checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflume.functions import series
from quantflume.functions.scalar import finite
from quantflume.functions.series import KEY, TIME
from quantflume.kernels import live as live_kernel
from quantflume.operators import asof, backtest, geometry, grid, layers
from quantflume.sources import bars as bar_sources

#: Bars that a live call looks back on.
LIVE_TAIL = 220


def geometric_branch(bars: DataFrame, size: int = 200, shape: tuple[int, int, int] = (48, 48, 32)) -> DataFrame:
    """Information, geodesic and singularity layers."""
    df = layers.information_layer(layers.motion(bars))
    fields = geometry.grid_fields(df.where("m_flux is not null and lam is not null"), size=size, shape=shape)
    df = layers.geodesic_outputs(fields.drop("mem_e"))
    df = df.withColumn("gravitational_stress_score", layers.gravitational_stress(F.col("field_curvature_scalar"), F.col("field_stress_tensor_norm")))
    return layers.singularity_alerts(layers.singularity_scores(df))


def trader_branch(bars: DataFrame) -> DataFrame:
    """Terrain, expected value, force, alignment and edge layers."""
    df = layers.input_layer(bars)
    terrain = layers.terrain_score(layers.density_layer(layers.attractor_layer(df)))
    ev = layers.expected_value(terrain)
    cells = grid.force_map(df.select(KEY, TIME, "E_gap", "jerk"), "E_gap", "jerk")
    return layers.neutral_if_short(layers.edge_signal(grid.alignment(ev, cells, "E_gap", "jerk")))


GEOMETRIC = ["information_density", "field_stress_geodesic", "rupture_prob_geodesic", "field_curvature_scalar", "field_gravity", "singularity_score", "criticality_score", "singularity_type", "stage"]


def offline_chain(bars: DataFrame, size: int = 200, shape: tuple[int, int, int] = (48, 48, 32)) -> DataFrame:
    """Both branches over whole series; they carry the same bars, so an equi-join puts them together."""
    geo = geometric_branch(bars, size, shape).select(KEY, TIME, *GEOMETRIC)
    out = trader_branch(bars).join(geo, [KEY, TIME], "left")
    return out.select("*", *[c.alias(n) for n, c in layers.criticality_flags(F.col("criticality_score")).items()])


def live(bars: DataFrame, size: int = 200, shape: tuple[int, int, int] = (48, 48, 32)) -> DataFrame:
    """The chain over each symbol's last bars, branches merged by nearest time within the usual tolerance."""
    recent = series.tail(bars, LIVE_TAIL)
    geo = geometric_branch(recent, size, shape).select(KEY, TIME, *GEOMETRIC)
    out = asof.nearest(trader_branch(recent), geo, GEOMETRIC, "auto", "right").drop("matched_ms")
    return out.select("*", *[c.alias(n) for n, c in layers.criticality_flags(F.col("criticality_score")).items()])


def live_call(bars: DataFrame, size: int = 200, shape: tuple[int, int, int] = (48, 48, 32)) -> DataFrame:
    """The states and geometric values of ``live``, a task of arrays for each symbol's last bars instead of a plan of dozens of windows.

    Bars without a finite close give no row; a symbol's tail is ``LIVE_TAIL``
    bars, so that a task's work is bounded; an empty table stays empty.
    """
    fixed = {"window": layers.WINDOW, "decay": layers.DECAY, "eps": layers.COV_EPS, "h": layers.BANDWIDTH, "step": layers.DELTA, "depth": layers.DEPTH, "lag": layers.HYST, "states": layers.STATES, "stress": layers.STRESS, "rupture": layers.RUPTURE, "rupture_base": layers.RUPTURE_BASE, "scores": layers.SCORES, "composite": layers.COMPOSITE, "critical": layers.CRITICAL, "types": layers.TYPES, "dominance": layers.DOMINANCE}
    kinds = dict(bars.dtypes)
    text = ("terrain_state", "edge_direction", "edge_bucket", "singularity_type", "stage")
    whole = ("edge_signal", "is_high_critical", "is_extreme_critical")
    names = ["close", *live_kernel.STATES, *GEOMETRIC, "is_high_critical", "is_extreme_critical"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([TIME, "close"], kind="stable")
        got = live_kernel.call(pdf[TIME].to_numpy(), pdf["close"].to_numpy(dtype=float), fixed, size, shape)
        return got.assign(**{KEY: pdf[KEY].iloc[0]})[[KEY, TIME, *names]]

    schema = f"{KEY} {kinds[KEY]}, {TIME} {kinds[TIME]}, " + ", ".join(f"{n} {'string' if n in text else 'int' if n in whole else 'double'}" for n in names)
    out = series.tail(bars, LIVE_TAIL).select(KEY, TIME, F.col("close").cast("double").alias("close")).groupBy(KEY).applyInPandas(run, schema)
    return out.select(KEY, TIME, *[n if n in text or n in whole else finite(n).alias(n) for n in names])


def three_sleeves(base: DataFrame, funding: DataFrame | None = None, cfg: backtest.Config = backtest.DEFAULT, weights: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """The backtest of all sleeves from fine bars: trades, sleeve returns, the portfolio with its breaker, gates and metrics."""
    weights = weights or {"trend": 0.50, "collapse": 0.30, "carry": 0.20}
    hourly, slow = bar_sources.resample(base, bar_sources.HOUR), bar_sources.resample(base, 4 * bar_sources.HOUR)
    done = backtest.trades(hourly, cfg)
    burst = backtest.trade_returns(hourly, done)
    trend = backtest.trend_returns(slow, cfg).select(KEY, TIME, F.col("net").alias("ret"))
    sleeves = {"trend": trend, "collapse": burst}
    if funding is not None:
        sleeves["carry"] = backtest.carry_returns(funding, cfg).select(KEY, TIME, F.col("net").alias("ret"))
    per_year = series.BARS_PER_YEAR
    portfolio = backtest.circuit_breaker(backtest.combine(sleeves, weights), cfg.breaker)
    out = {"integrity": bar_sources.integrity_report(base, 15 * bar_sources.MINUTE), "trades": done, "portfolio": portfolio, "metrics": backtest.metrics(portfolio.withColumn("ret", F.col("ret_cb")), per_year["1h"])}
    out["gate_collapse"] = backtest.gate_report(burst, per_year["1h"], done, cfg)
    out["gate_trend"] = backtest.gate_report(trend, per_year["4h"], None, cfg)
    if funding is not None:
        out["gate_carry"] = backtest.gate_report(sleeves["carry"], 365 * 24 / cfg.carry.period_hours, None, cfg)
    return out


def grid_against_exact(df: DataFrame, columns: list[str], lam: str, shapes: list[tuple[int, int, int]], window: int = 500) -> DataFrame:
    """Scalar curvature from grids of several resolutions beside the exact one of a causal scan, bar by bar."""
    exact = geometry.causal_scan(df, columns, lam, window=window, fisher=False).select(KEY, TIME, F.col("H_R").alias("exact"))
    named = df.withColumnRenamed(columns[0], "_e").withColumnRenamed(columns[1], "_j").withColumnRenamed(columns[2], "_m")
    parts = []
    for shape in shapes:
        g = geometry.grid_fields(named, "_e", "_j", "_m", lam, size=40, shape=shape)
        parts.append(g.select(KEY, TIME, F.lit("x".join(map(str, shape))).alias("grid"), F.col("field_curvature_scalar").alias("on_grid")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.join(exact, [KEY, TIME])
