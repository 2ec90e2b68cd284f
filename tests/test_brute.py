"""Operators without SQL against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantflume.functions import series
from quantflume.kernels import boosting, gridfield, volatility
from quantflume.operators import geometry, layers, models, stats
from tests import simulators


@pytest.fixture(scope="module")
def walk(spark):
    """Two series of three coordinates, one with gaps in them."""
    rng = np.random.default_rng(5)
    rows = [(s, 60_000 * k, *map(float, rng.standard_normal(3)), float(rng.random())) for s in ("a", "b") for k in range(260)]
    rows = [(s, t, None if s == "b" and t % 11 == 0 else x, y, z, lam) for s, t, x, y, z, lam in rows]
    return spark.createDataFrame(rows, "symbol string, bar_ms long, x double, y double, z double, lam double")


def test_scan_against_one_bar_at_a_time(spark, walk):
    window, refit, h = 100, 20, 0.6
    got = {(r.symbol, r.bar_ms): r for r in geometry.causal_scan(walk, ["x", "y", "z"], "lam", window, refit, h=h, refits=3).collect()}
    seen = set()
    for symbol, part in walk.toPandas().groupby("symbol"):
        part = part.sort_values("bar_ms")
        points, times = part[["x", "y", "z"]].to_numpy(dtype=float), part.bar_ms.to_numpy()
        for n in range(window, len(points)):
            start = window + (n - window) // refit * refit
            past = points[start - window : start]
            past = past[np.isfinite(past).all(axis=1)]
            if not np.isfinite(points[n]).all() or len(past) < window // 2:
                continue
            seen.add((symbol, times[n]))
            u = (points[n] - past) / h
            w = np.exp(-0.5 * (u * u).sum(axis=1))
            r = got[symbol, times[n]]
            assert np.isclose(r.phi, -np.log(w.mean() / (2 * np.pi * h * h) ** 1.5))
            mean = (w[:, None] * u).sum(axis=0) / w.sum()
            assert np.isclose(r.grad_phi_norm, np.linalg.norm(mean / h))
            hess = (np.eye(3) - ((w[:, None, None] * u[:, :, None] * u[:, None, :]).sum(axis=0) / w.sum() - np.outer(mean, mean))) / h**2
            assert np.isclose(r.H_det, np.linalg.det(hess), rtol=1e-6) and r.H_neg == (np.linalg.eigvalsh(hess) < 0).sum()
            off = points[n] - past.mean(axis=0)
            assert np.isclose(r.mahalanobis, np.sqrt(off @ np.linalg.inv(np.cov(past, rowvar=False)) @ off))
    assert got.keys() == seen and len(seen) > 200


def test_halves_against_plain_densities(spark, walk):
    window = 100
    got = geometry.reliability(walk.where("symbol = 'a'"), ["x", "y", "z"], window=window, bars=12, scales=(1.0,)).collect()
    part = walk.where("symbol = 'a'").toPandas().sort_values("bar_ms")
    points, times = part[["x", "y", "z"]].to_numpy(), part.bar_ms.to_numpy()
    assert len(got) == 24 and len({r.bar_ms for r in got}) == 12
    for r in got:
        n = int(np.flatnonzero(times == r.bar_ms)[0])
        past = np.array([points[k] for k in range(n - window, n) if k % 2 == r.half])
        h = window ** (-1 / 7)
        u = (points[n] - past) / h
        assert np.isclose(r.phi, -np.log(np.exp(-0.5 * (u * u).sum(axis=1)).mean() / (2 * np.pi * h * h) ** 1.5))


def test_shift_test_against_every_shift(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, 90))
    y = y + 0.3 * x
    df = spark.createDataFrame([("s", k, float(x[k]), float(y[k])) for k in range(90)] + [("flat", k, 1.0, float(k)) for k in range(9)] + [("s", 200, None, 1.0)], "symbol string, bar_ms long, x double, y double")
    shifts = list(range(1, 120))
    got = {r.symbol: r for r in stats.circular_shift_test(df, "x", "y", shifts).collect()}
    rho = [np.corrcoef(np.roll(x, s), y)[0, 1] for s in [0, *shifts]]
    hits = sum(v >= rho[0] - 1e-12 for v in rho[1:])
    r = got["s"]
    assert np.isclose(r.rho, rho[0]) and np.isclose(r.null_p95, np.quantile(rho[1:], 0.95)) and r.n_perm == 119
    assert abs(r.p - (1 + hits) / 120) < 1.5 / 120  # a shift by the whole length may round either way
    assert got["flat"].rho is None
    assert stats.circular_shift_test(df.limit(0), "x", "y", shifts).collect() == []


@pytest.mark.parametrize("before", [False, True])
def test_rolling_quantile_against_pandas(spark, before):
    rng = np.random.default_rng(2)
    x = pd.Series(rng.standard_normal(700)).where(rng.random(700) > 0.1)
    df = spark.createDataFrame([("s", k, None if np.isnan(v) else float(v)) for k, v in enumerate(x)], "symbol string, bar_ms long, x double")
    got = series.rolling_quantile(df, "x", "q", 50, 20, 0.9, before).orderBy("bar_ms").toPandas()["q"].to_numpy(dtype=float)
    want = (x.shift(1) if before else x).rolling(50, min_periods=20).quantile(0.9).to_numpy()
    assert np.allclose(got, want, equal_nan=True)


def test_repeated_bars_give_a_row_each(spark):
    df = spark.createDataFrame([("s", k // 2, float(k % 7)) for k in range(40)] + [("t", 0, 1.0), ("t", 0, 1.0), ("t", 1, None)], "symbol string, bar_ms long, x double")
    for out in (series.rank_causal(df, ["x"], 10, 3), series.robust_z_causal(df, ["x"], 10, 3), series.rolling_quantile(df, "x", "q", 10, 3)):
        assert out.count() == 43 and out.where("symbol = 't'").count() == 3
    two = df.selectExpr("symbol", "bar_ms", "x E_gap", "x * 2 jerk", "1 displacement")
    out = layers.density_layer(two, tile=8, together=2)
    assert out.count() == 43 and out.where("E_gap is not null and log_density is null").count() == 0
    assert layers.density_layer(two.limit(0)).collect() == []


def test_evaluations_do_not_depend_on_their_tasks(spark):
    df = simulators.synthetic(spark, "planted", 900, [3], step=20)
    rows = lambda n: sorted(models.evaluations(df, 200, 20, 4.0, per_task=n).collect())
    one = rows(1)
    assert one == rows(7) == rows(1000) and len(one) > 10
    part = df.toPandas().sort_values("bar_ms")
    r = np.diff(np.log(part.close.to_numpy()), prepend=np.nan)
    for e in one:
        now, nxt = np.sqrt(np.nansum(r[e.t - 20 : e.t] ** 2)), np.sqrt(np.nansum(r[e.t : e.t + 20] ** 2))
        assert np.isclose(e.y, abs(np.log(nxt / now))) and np.isclose(e.log_rv_S, np.log(now)) and e.bar_ms == part.bar_ms.iloc[e.t - 1]


def test_trees_find_the_best_split_and_a_function():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((60, 2)), rng.standard_normal(60)
    # one round, two leaves, full step: the best of all splits
    got = boosting.predictions(x, y, x, rounds=1, rate=1.0, leaves=2, least=5)
    errors = []
    for f in range(2):
        for cut in np.sort(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if 5 <= left.sum() <= 55:
                errors.append(((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum())
    assert np.isclose(((y - got) ** 2).sum(), min(errors))
    x = rng.uniform(-2, 2, (3000, 3))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) + 0.1 * rng.standard_normal(3000)
    off = y[2000:] - boosting.predictions(x[:2000], y[:2000], x[2000:])
    assert 1 - (off**2).mean() / y[2000:].var() > 0.95
    assert np.allclose(boosting.predictions(x[:100], np.ones(100), x[:5]), 1.0)


def test_out_of_fold_r2(spark):
    rng = np.random.default_rng(4)
    rows = [(s, k, float(v), float(np.sin(3 * v) if s == "a" else 1.0), None if k % 50 == 0 else float(w)) for s in ("a", "b") for k, (v, w) in enumerate(rng.uniform(-2, 2, (600, 2)))]
    df = spark.createDataFrame(rows, "symbol string, bar_ms long, x double, y double, noise double")
    got = {(r.symbol, r.target): (r.n, r.r2) for r in stats.fold_r2(df, ["x"], ["y", "noise"]).collect()}
    assert got["a", "y"][0] == 600 and got["a", "y"][1] > 0.9 and got["b", "y"][1] is None
    assert got["a", "noise"][0] == 588 and got["a", "noise"][1] < 0.2
    assert stats.fold_r2(df.limit(0), ["x"], "y").collect() == []


def test_grid_fields_are_the_kernels_fields(spark, walk):
    df = walk.where("symbol = 'a'").selectExpr("symbol", "bar_ms", "x E", "y jerk", "z m_flux", "lam")
    got = geometry.grid_fields(df, size=30, shape=(10, 9, 8)).orderBy("bar_ms").toPandas()
    p = df.toPandas().sort_values("bar_ms")
    axes, fields = gridfield.field_2d(p.E.to_numpy(), p.jerk.to_numpy(), 30)
    rho = np.exp(-0.5 * (((axes[0][:, None] - p.E.to_numpy()) / 0.35) ** 2)[:, None, :] - 0.5 * (((axes[1][:, None] - p.jerk.to_numpy()) / 0.35) ** 2)[None]).mean(axis=2) / (2 * np.pi * 0.35**2)
    assert np.allclose(fields["rho_field"], rho, rtol=1e-6)
    assert np.allclose(got["rho_field"], gridfield.interpolate(axes, rho, p[["E", "jerk"]].to_numpy()), rtol=1e-6, atol=1e-12)
    assert len(got) == 260 and got["field_curvature_scalar"].notna().all()


def test_bars_of_returns_are_bars():
    r, _ = volatility.garch_paths(4000, 1, **volatility.GARCH)
    b = simulators.flow_bars(4000, 1)
    assert (b["low"] > 0).all() and (b["low"] <= np.minimum(b["open"], b["close"])).all() and (b["high"] >= np.maximum(b["open"], b["close"])).all()
    assert np.allclose(np.diff(np.log(b["close"])), r[1:]) and (b["open"][1:] == b["close"][:-1]).all()
    assert np.corrcoef(np.abs(r), b["volume"])[0, 1] > 0.3


def test_scan_summary(spark):
    scan = spark.createDataFrame([("s", k, float(k % 2), float(k), 2.0 * k, 1.0, float(k)) for k in range(20)] + [("t", 0, None, None, None, None, None)], "symbol string, bar_ms long, H_neg double, H_R double, F_R double, Fref_R double, mahalanobis double")
    got = {r.symbol: r for r in geometry.summary(scan).collect()}
    assert got["s"].bars == 20 and got["s"].indefinite == 0.5 and got["s"].turns == 1.0 and np.isclose(got["s"].rho_distance, 1.0)
    assert got["t"].bars == 1 and got["t"].mean_dF is None and got["t"].rho_distance is None
    value = np.log1p(2.0 * np.arange(20)) - np.log(2)
    assert np.isclose(got["s"].mean_dF, value.mean()) and np.isclose(got["s"].median_dF, np.median(value))


def test_checks_of_files_and_figures(spark):
    from quantflume.sources import bars, klines

    assert [r.month for r in bars.months(spark, "2024-11-05", "2025-01-31", "2025-02").collect()] == ["2024-11", "2024-12", "2025-01"]
    with pytest.raises(ValueError):
        bars.months(spark, "2024-11-05", "2025-02-01", "2025-02")

    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", None), ("c", bytearray(b""))], "path string, content binary")
    published = spark.createDataFrame([("a", "2D711642B726B04401627CA9FBAC32F5C8530FB1903CC4DB02258717921A4881"), ("b", "00"), ("d", "11")], "path string, sha256 string")
    assert {r.path: r.ok for r in klines.checksums(files, published).collect()} == {"a": True, "b": False, "c": False, "d": False}
    df = spark.createDataFrame([("s", 1.0, None)], "symbol string, x double, y double")
    assert [(r.metric, r.ok) for r in stats.reproduction(df, {"x": 1.05, "y": 0.0}, {"x": 0.1, "y": 0.1}, "symbol").orderBy("metric").collect()] == [("x", True), ("y", False)]
    assert stats.pivoted(df.withColumn("k", F.lit(1)), "symbol", "k", [1, 2], "x").collect()[0].asDict() == {"symbol": "s", "k_1": 1.0, "k_2": None}


def test_live_call_is_the_chain(spark, sf_dir):
    """The arrays of one task against the plan of all layers, on two symbols, one of them short and with a gap in its closes."""
    from quantflume.plans import chains

    # moves of some size: of tiny ones the grids' derivatives are rounding errors
    rng = np.random.default_rng(11)
    close = np.exp(np.cumsum(0.4 * rng.standard_normal(300)))
    rows = [("long", 60_000 * k, float(c)) for k, c in enumerate(close)] + [("short", 60_000 * k, None if k % 7 == 3 else float(c)) for k, c in enumerate(close[:130])] + [("few", 60_000 * k, float(c)) for k, c in enumerate(close[:7])]
    both = spark.createDataFrame(rows, "symbol string, bar_ms long, close double").select("*", *[F.col("close").alias(c) for c in ("open", "high", "low", "volume")])
    keys = ["symbol", "bar_ms"]
    a = chains.live(both, 40, (12, 12, 10)).toPandas().sort_values(keys).reset_index(drop=True)
    b = chains.live_call(both, 40, (12, 12, 10)).toPandas().sort_values(keys).reset_index(drop=True)
    assert (a[keys] == b[keys]).all().all() and len(a) > 300
    for c in ("terrain_state", "edge_direction", "edge_bucket", "singularity_type", "stage", "edge_signal", "is_high_critical", "is_extreme_critical"):
        assert (a[c].fillna("") == b[c].fillna("")).all(), c
    for c in ("edge_score", "expected_value_score", "transition_score", *chains.GEOMETRIC[:-2]):
        assert np.allclose(a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float), rtol=1e-6, atol=1e-9, equal_nan=True), c
    assert chains.live_call(both.limit(0)).collect() == []


def test_density_at_over_tiles_equals_whole_groups(spark, monkeypatch):
    from quantflume.kernels.density import Density, scott
    from quantflume.operators import geometry

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3))
    x[7] = x[3]
    label = [None] * 40 + [1] * 49 + [2]
    df = spark.createDataFrame([(k, g, *map(float, v)) for k, (g, v) in enumerate(zip(label, x, strict=True))], "id long, g long, a double, b double, c double")
    got = {r.id: r for r in geometry.density_at(df, ["a", "b", "c"], "g", "id", tile=16, together=2).collect()}
    i, j = np.triu_indices(3)
    for own in (np.arange(40), np.arange(40, 89)):
        kde = Density(x[own], scott(len(own), 3))
        w, scores = kde.weights(x[own])[0], kde.scores()
        want = {"log_density": kde.log_density(x[own]), "gradient": kde.gradient(x[own], w), "hessian": kde.hessian(x[own], w)[:, i, j], "score": scores, "fisher": kde.fisher(scores, w)[:, i, j]}
        for name, values in want.items():
            assert np.allclose([got[k][name] for k in own.tolist()], values, rtol=1e-9, atol=1e-9), name
    assert got[89].score == [None] * 3 and got[89].gradient == [0.0] * 3 and len(got) == 90
    # no task holds the whole of a group
    largest, kernel = [], geometry._kernel_sums
    monkeypatch.setattr(geometry, "_kernel_sums", lambda rows, *a: largest.append(rows.groupBy("g", "qf_tile").count().agg({"count": "max"}).first()[0]) or kernel(rows, *a))
    geometry.density_at(df, ["a", "b", "c"], "g", "id", tile=16, together=2).count()
    assert len(largest) == 2 and max(largest) < 40
