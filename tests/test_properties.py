"""Causality on prefixes, and window expressions against plain loops."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantflume.functions import series
from quantflume.operators import asof, backtest, geometry, grid, layers, models, stats
from tests import simulators


def frame(spark, values, symbol="s", step=3_600_000):
    return spark.createDataFrame([(symbol, k * step, None if v is None else float(v)) for k, v in enumerate(values)], "symbol string, bar_ms long, close double")


def column(df, name):
    return np.array([np.nan if r[name] is None else r[name] for r in df.orderBy("bar_ms").collect()], dtype=float)


def test_causal_features_do_not_change_when_bars_come_in(spark):
    rng = np.random.default_rng(0)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 900)))
    whole = simulators.synthetic(spark, "flow", 900, [5]).select("symbol", "bar_ms", "open", "high", "low", "close", "volume", "taker_buy")

    def features(df):
        df = layers.motion(df)
        df = series.robust_z_causal(df, ["E"], 120, 40)
        df = series.rank_causal(df, ["jerk"], 120, 40)
        df = layers.information_layer(df, size=60)
        df = models.design_rows(df)
        return df.select("symbol", "bar_ms", "lam", "m_flux", "E_z", "jerk_rank", "information_density", "z", "ell")

    cut = 3_600_000 * 0 + sorted(r.bar_ms for r in whole.select("bar_ms").collect())[599]
    a = {r.bar_ms: r for r in features(whole.where(F.col("bar_ms") <= cut)).collect()}
    b = {r.bar_ms: r for r in features(whole).collect()}
    assert len(a) == 600 and len(x) == 900
    for k, r in a.items():
        for u, v in zip(r[2:], b[k][2:], strict=True):
            assert (u is None) == (v is None) and (u is None or abs(u - v) <= 1e-9 * (1 + abs(u)))


def test_exponential_features_equal_their_recursions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 1500).cumsum() + 50
    got = column(series.ema(frame(spark, [None, None, *x]), "close", "m", 0.05), "m")
    want, m = [], None
    for v in x:
        m = v if m is None else 0.95 * m + 0.05 * v
        want.append(m)
    assert np.isnan(got[:2]).all() and np.allclose(got[2:], want, rtol=1e-12)
    for span in (5, 96):
        got = column(series.ewm_std(frame(spark, x), "close", "s", span), "s")
        want = pd.Series(x).ewm(span=span, min_periods=span).std().to_numpy()
        assert np.allclose(got, want, rtol=1e-8, equal_nan=True)


def test_rolling_kernels_over_blocks_equal_pandas(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 1, 700), 1)
    df = frame(spark, [v if k % 17 else None for k, v in enumerate(x)])
    s = pd.Series(np.where(np.arange(700) % 17 == 0, np.nan, x))
    past = s.shift(1)
    med = past.rolling(50, min_periods=20).median()
    mad = (past - med).abs().rolling(50, min_periods=20).median()
    want = (s - med) / (1.4826 * mad + 1e-300)
    for block in (64, 4096):
        kernel = lambda v: [series._medians(v, 50, 20)]
        got = column(series.by_halo(df, ["close"], 50, kernel, ["m"], block), "m")
        assert np.allclose(got, med, equal_nan=True)
    assert np.allclose(column(series.robust_z_causal(df, ["close"], 50, 20), "close_z"), want, equal_nan=True)


def breaker_loop(rets, limit):
    eq, peak, raw, high, on, out = 1.0, 1.0, 1.0, 1.0, True, []
    for r in rets:
        raw *= 1 + r
        high = max(high, raw)
        out.append(r if on else 0.0)
        if on:
            eq *= 1 + r
            peak = max(peak, eq)
            on = 1 - eq / peak < limit
        elif raw >= high:
            on, peak = True, eq
    return out


@pytest.mark.parametrize("seed", range(3))
def test_breaker_and_carry_equal_their_loops(spark, seed):
    rng = np.random.default_rng(seed)
    paths = {f"p{k}": rng.normal(0.001, 0.03, 200).round(4) for k in range(12)}
    df = spark.createDataFrame([(s, t, float(v)) for s, p in paths.items() for t, v in enumerate(p)], "symbol string, bar_ms long, ret double")
    got = backtest.circuit_breaker(df, 0.10).orderBy("symbol", "bar_ms").collect()
    want = [x for s in sorted(paths) for x in breaker_loop(paths[s], 0.10)]
    assert np.allclose([r.ret_cb for r in got], want)
    fund = spark.createDataFrame([(s, t, float(v) / 1000) for s, p in paths.items() for t, v in enumerate(p)], "symbol string, bar_ms long, funding double")
    rows = backtest.carry_returns(fund).orderBy("symbol", "bar_ms").collect()
    k = 0
    for s in sorted(paths):
        held = False
        for v in paths[s] / 1000:
            a, cost, entered = v * 1095, 0.0, False
            if not held and a > 0.05:
                held, cost, entered = True, backtest.DEFAULT.costs.round_trip, True
            elif held and a <= 0:
                held, cost = False, backtest.DEFAULT.costs.round_trip
            assert rows[k].in_pos == held and abs(rows[k].net - ((v if held and not entered else 0) - cost)) < 1e-12
            k += 1


def test_short_flat_and_empty_series(spark):
    schema = "symbol string, bar_ms long, open double, high double, low double, close double, volume double, taker_buy double"
    flat = spark.createDataFrame([("f", k * 60_000, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0) for k in range(40)] + [("one", 0, 2.0, 2.0, 2.0, 2.0, 1.0, 1.0)], schema)
    out = layers.edge_signal(layers.expected_value(layers.terrain_score(layers.density_layer(layers.attractor_layer(layers.input_layer(flat))))).withColumn("force_alignment_cos", F.lit(None).cast("double")))
    rows = layers.neutral_if_short(out).collect()
    assert len(rows) == 41 and {r.edge_signal for r in rows} == {0}
    empty = flat.limit(0)
    assert layers.input_layer(empty).collect() == [] == geometry.causal_scan(layers.motion(empty), ["E", "jerk", "m_flux"], "lam", window=20).collect()
    assert geometry.causal_scan(layers.motion(flat), ["E", "jerk", "m_flux"], "lam", window=500).collect() == []
    assert grid.force_map(layers.motion(empty)).collect() == [] == backtest.trades(empty).collect()
    with pytest.raises(ValueError):
        layers.input_layer(flat.drop("close"))


def test_asof_ties_tolerance_and_preference(spark):
    left = spark.createDataFrame([("a", t, float(t), 1.0) for t in (0, 10, 20, 100)], "symbol string, bar_ms long, x double, y double")
    right = spark.createDataFrame([("a", 5, 50.0, None), ("a", 15, 150.0, 7.0), ("b", 10, 1.0, 1.0)], "symbol string, bar_ms long, y double, z double")
    got = {r.bar_ms: (r.y, r.z, r.matched_ms) for r in asof.nearest(left, right, ["y", "z"], 40, "right").collect()}
    assert got == {0: (50.0, None, 5), 10: (50.0, None, 5), 20: (150.0, 7.0, 15), 100: (1.0, None, None)}
    assert {r.bar_ms: r.y for r in asof.nearest(left, right, ["y", "z"]).collect()} == {0: 1.0, 10: 1.0, 20: 1.0, 100: 1.0}


def test_whole_densities_and_existence_cover_every_symbol(spark, sf_dir):
    from quantflume.kernels.density import Density
    from quantflume.plans import layer_queries

    df = layer_queries._attractor(spark, sf_dir).select("symbol", "bar_ms", "E_gap", "jerk", "displacement").toPandas().sort_values(["symbol", "bar_ms"])
    got = layer_queries.global_density(spark, sf_dir).toPandas().sort_values(["symbol", "bar_ms"])
    assert len(got) == len(df) and set(got.symbol) == {"A", "N", "R"}
    for symbol, part in df.groupby("symbol"):
        xy = part[["E_gap", "jerk"]].to_numpy(dtype=float)
        want = Density(xy[part.displacement.notna()], 0.35).log_density(xy)
        have = got[got.symbol == symbol].log_density.to_numpy(dtype=float)
        assert np.allclose(have, want, atol=2e-5)
    states = layer_queries.terrain_state(spark, sf_dir).groupBy("symbol").count().collect()
    assert {r["symbol"]: r["count"] for r in states} == df.groupby("symbol").size().to_dict()
    assert {(r.symbol, r.kind) for r in layer_queries.existence(spark, sf_dir).collect()} == {(s, k) for s in "ANR" for k in ("shuffle", "spectrum", "garch")}


def test_curvature_scan_has_every_complete_bar(spark, sf_dir):
    from quantflume.plans import layer_queries

    names = ["E_gauss", "jerk_gauss", "m_flux_gauss"]
    df = layer_queries._coordinates(spark, sf_dir, 500).toPandas().sort_values(["symbol", "bar_ms"])
    want = set()
    for symbol, part in df.groupby("symbol"):
        ok = np.isfinite(part[names].to_numpy(dtype=float)).all(axis=1)
        for n in range(500, len(part)):
            start = 500 + (n - 500) // 60 * 60
            if ok[n] and ok[start - 500 : start].sum() >= 250:
                want.add((symbol, int(part.bar_ms.iloc[n])))
    got = layer_queries.curvature_scan(spark, sf_dir).select("symbol", "bar_ms").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_samples_tails_and_duplicates_keep_a_callers_columns(spark):
    rows = [(s, k * 60_000, float(k), 7) for s, n in (("a", 30), ("b", 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, bar_ms long, close double, _N long")
    drawn = stats.sample_by_hash(df, 5, 3)
    assert drawn.columns == df.columns
    got = sorted((r.symbol, r.bar_ms) for r in drawn.collect())
    md5 = lambda k: hashlib.md5(f"3:{k * 60_000}".encode()).hexdigest()
    assert got == sorted([("a", k * 60_000) for k in sorted(range(30), key=md5)[:5]] + [("b", k * 60_000) for k in range(3)])
    assert sorted((r.symbol, r.bar_ms) for r in stats.sample_by_hash(df.repartition(7), 5, 3).collect()) == got
    last = series.tail(df, 4)
    assert last.columns == df.columns
    assert sorted(r.bar_ms for r in last.where("symbol = 'a'").collect()) == [k * 60_000 for k in range(26, 30)]
    one = series.last_of_duplicates(df.union(df.withColumn("close", F.col("close") + 1)), "close")
    assert one.columns == df.columns and one.count() == 33
    assert {r._N for r in one.collect()} == {7}
    empty = df.where("false")
    assert stats.sample_by_hash(empty, 5).count() == series.tail(empty, 5).count() == 0


def test_stress_of_rows_with_gaps_and_of_none(spark):
    rows = [(1, 1.0, 2.0, 3.0, 0.5, 0.0, -0.5, 2.0), (2, None, 2.0, 3.0, 0.5, 0.0, -0.5, 2.0), (3, 1.0, 2.0, 3.0, 0.5, 0.0, -0.5, float("nan"))]
    names = ["p1", "p2", "p3", "q1", "q2", "q3", "lam"]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names))
    got = {r.k: r for r in geometry.stress_at(df, names[:3], names[3:6], "lam", "k").collect()}
    p, q = np.array(rows[0][1:4]), np.array(rows[0][4:7])
    want = np.outer(p, p) + 0.75 * np.outer(q, q) + (0.25 * 2.0 - 0.5 * (p @ p + 0.75 * q @ q)) * np.eye(3)
    assert all(abs(got[1][f"t_{a + 1}{b + 1}"] - want[a, b]) < 1e-12 for a in range(3) for b in range(a, 3))
    assert abs(got[1]["norm"] - np.sqrt((want * want).sum())) < 1e-12
    assert all(v is None for k in (2, 3) for v in got[k][1:])
    assert geometry.stress_at(df.where("false"), names[:3], names[3:6], "lam", "k").count() == 0
