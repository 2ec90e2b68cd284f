"""Prefix scans over many blocks, exact selection and chains of trades against plain loops."""

import numpy as np
import pandas as pd

from quantflume.functions import robust, scans, series
from quantflume.operators import backtest, stats
from quantflume.sources import klines

DAY = 86_400_000


def bars(spark, seed=0, n=400):
    """Two symbols whose bars lie in some ten blocks, with gaps of several empty ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        at = np.cumsum(rng.choice([DAY // 24, DAY // 2, 60 * DAY], n, p=[0.6, 0.39, 0.01])) - 100 * DAY
        ret = rng.normal(0, 0.02, n)
        rows += [(s, int(t), float(r) if rng.random() > 0.1 else None, int(rng.integers(0, 3))) for t, r in zip(at, ret, strict=True)]
    df = spark.createDataFrame(rows, "symbol string, bar_ms long, ret double, state int").repartition(3)
    return df, {s: g.sort_values("bar_ms") for s, g in df.toPandas().groupby("symbol")}


def ordered(df):
    return {s: g.sort_values("bar_ms") for s, g in df.toPandas().groupby("symbol")}


def test_numbers_equity_and_averages(spark):
    df, plain = bars(spark)
    assert df.select((df.bar_ms / scans.BLOCK_MS).cast("long")).distinct().count() > 5
    got = {
        "n": ordered(scans.numbered(df, "n")),
        "equity": ordered(backtest.equity(df)),
        "ema": ordered(series.ema(df, "ret", "ema", 0.1)),
        "std": ordered(series.ewm_std(df, "ret", "std", 20)),
        "sum": ordered(series.decayed_sums(df, 0.9, total=df.ret)),
    }
    for s, g in plain.items():
        assert got["n"][s].n.tolist() == list(range(len(g)))
        raw = (1 + g.ret.fillna(0)).cumprod()
        assert np.allclose(got["equity"][s].equity, raw) and np.allclose(got["equity"][s].drawdown, 1 - raw / raw.cummax())
        total, want = 0.0, []
        for r in g.ret.fillna(0):
            total = 0.1 * total + r
            want.append(total)
        assert np.allclose(got["sum"][s].total, want, rtol=1e-10, atol=1e-15)
        weights = g.ret.notna().to_numpy()
        first, top, bottom, ema, keep = True, 0.0, 0.0, [], 0.9
        for r, ok in zip(g.ret, weights, strict=True):
            top, bottom = keep * top, keep * bottom
            if ok:
                w = 1.0 if first else 0.1
                top, bottom, first = top + w * r, bottom + w, False
            ema.append(top / bottom if bottom else np.nan)
        assert np.allclose(got["ema"][s].ema.astype(float), ema, equal_nan=True)
        std = g.ret.ewm(span=20, min_periods=20, ignore_na=False).std()
        assert np.allclose(got["std"][s]["std"].astype(float), std, rtol=1e-8, equal_nan=True)


def test_breaker_and_runs_over_blocks(spark):
    df, plain = bars(spark, 1)
    got = ordered(backtest.circuit_breaker(df, 0.10))
    runs = {r.symbol: r for r in stats.run_lengths(df, "state").collect()}
    for s, g in plain.items():
        raw = top = 1.0
        on, tripped, active = True, False, []
        for r in g.ret.fillna(0):
            active.append(not tripped)
            raw *= 1 + r
            top = max(top, raw)
            tripped = 1 - raw / top >= 0.10 if tripped is False or raw >= top else True
        assert got[s].active.tolist() == active and not all(active) and on
        assert np.allclose(got[s].ret_cb, np.where(active, g.ret.fillna(0), 0))
        moves = int((np.diff(g.state) != 0).sum())
        assert runs[s].changes == moves and np.isclose(runs[s].mean_run, len(g) / (moves + 1))


def test_selection_of_awkward_columns(spark):
    rng = np.random.default_rng(2)
    columns = {
        "narrow": 60_000 + rng.normal(0, 1e-3, 3000),
        "heavy": rng.standard_cauchy(3000) ** 3,
        "tied": rng.integers(0, 4, 3000).astype(float),
        "same": np.full(3000, -7.5),
        "signs": np.where(rng.random(3000) < 0.5, -1, 1) * np.exp(rng.normal(0, 20, 3000)),
    }
    frame = pd.DataFrame({"symbol": np.where(np.arange(3000) < 7, "few", "many")} | columns)
    df = spark.createDataFrame(frame)
    df = df.withColumn("narrow", df.narrow).union(spark.createDataFrame([("many", None, None, None, None, None), ("none", None, None, None, None, None)], df.schema))
    asked = {f"{c}_{q}": (c, q) for c in columns for q in (0.0, 0.005, 0.5, 0.93, 1.0)}
    got = {r.symbol: r for r in robust.selected(df, asked).collect()}
    for s in ("few", "many"):
        own = frame[frame.symbol == s]
        for name, (c, q) in asked.items():
            assert np.isclose(got[s][name], np.quantile(own[c], q), rtol=1e-12), (s, name)
    whole = robust.quantiles(df, {"m": ("heavy", 0.5)}, long=True)
    assert whole.count() == 3002 and whole.where("symbol = 'none' and m is null").count() == 1


def test_trades_one_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for s in "abc":
        at = np.sort(rng.choice(2000, 300, replace=False))
        out = at + rng.integers(1, 30, 300)
        rows += [(s, int(a), int(b)) for a, b in zip(at, out, strict=True)]
        busy = -1
        for a, b in zip(at.tolist(), out.tolist(), strict=True):
            if a > busy:
                want.add((s, a))
                busy = b
    df = spark.createDataFrame([*rows, ("one", 5, 9)], "symbol string, _in long, _out long").repartition(4)
    assert {(r.symbol, r._in) for r in backtest.taken(df).collect()} == want | {("one", 5)}
    assert backtest.taken(df.limit(0)).collect() == []


def test_what_is_kept_follows_its_contents(spark, tmp_path):
    made = []

    def make(df):
        made.append(1)
        return df

    one, two = (spark.createDataFrame([(k, float(k))], "a long, b double") for k in (1, 2))
    for df in (one, one, two, one):
        assert klines.cached(spark, str(tmp_path), lambda df=df: make(df), df).collect() == df.collect()
    assert len(made) == 2


def test_few_frequencies_equal_the_transform(spark):
    x = np.random.default_rng(4).standard_normal(501)
    df = spark.createDataFrame([("s", k * DAY, float(v)) for k, v in enumerate(x)] + [("t", 0, 2.0), ("t", 1, None)], "symbol string, bar_ms long, x double")
    got = {(r.symbol, r.k): r.power for r in stats.periodogram(df, "x", 8).collect()}
    want = np.abs(np.fft.rfft(x)[:8]) ** 2 / 501
    assert np.allclose([got["s", k] for k in range(8)], want) and got["t", 0] == 4.0 and len(got) == 9
