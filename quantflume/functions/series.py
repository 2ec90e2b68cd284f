"""Causal features of ordered series: one row per (symbol, bar), windows per symbol.

Frames end at the bar itself or, where a docstring says "before", one bar
earlier; nothing looks ahead except ``forward_return``, which makes labels.
Missing values are null, and every rolling feature is null until it has seen
``least`` values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflume.functions import scans
from quantflume.functions.scalar import clip, finite, normal_quantile, ratio
from quantflume.functions.scans import KEY, TIME


def by_time(key: str = KEY, time: str = TIME):
    """A symbol's rows in order of time; a bar without a time comes last, as in SQL."""
    return Window.partitionBy(key).orderBy(F.asc_nulls_last(time))


def rows(first: int, last: int, key: str = KEY, time: str = TIME):
    return by_time(key, time).rowsBetween(first, last)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct_change(x, periods: int = 1) -> Column:
    x = _col(x)
    return ratio(x, F.lag(x, periods).over(by_time())) - 1


def difference(x, order: int = 1) -> Column:
    """Finite difference from closed coefficients, so that one window serves any order."""
    x, out, c = _col(x), F.lit(0.0), 1
    for k in range(order + 1):
        out = out + float(c) * (x if k == 0 else F.lag(x, k).over(by_time()))
        c = -c * (order - k) // (k + 1)
    return out


def forward_return(x, periods: int, eps: float = 1e-9) -> Column:
    """x after so many bars over x + eps, minus 1. Looks ahead: for labels only."""
    x = _col(x)
    return F.lead(x, periods).over(by_time()) / (x + eps) - 1


def rolling(name: str, x, size: int, least: int | None = None, before: bool = False) -> Column:
    """mean, sum, std (n - 1), max or count over the last ``size`` rows, the bar's own included unless ``before``."""
    x = _col(x)
    w = rows(-size, -1) if before else rows(1 - size, 0)
    value = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "max": F.max, "count": F.count}[name](x)
    return F.when(F.count(x).over(w) >= (size if least is None else least), value.over(w))


def log_return(close) -> Column:
    close = _col(close)
    return F.log(close) - F.log(F.lag(close, 1).over(by_time()))


def rigidity(returns, size: int = 30, least: int = 10, floor: float = 1e-6) -> Column:
    """1 / (rolling standard deviation + floor)."""
    return 1.0 / (F.abs(rolling("std", returns, size, least)) + floor)


def log_volatility(returns, size: int) -> Column:
    """Log of the rolling standard deviation of log returns, from half a window on."""
    return F.log(rolling("std", returns, size, size // 2) + 1e-12)


def flow_imbalance(volume, taker_buy) -> Column:
    """2 * buy / volume - 1 within [-1, 1]; 0 without volume."""
    volume, taker_buy = _col(volume), _col(taker_buy)
    return F.when(volume > 0, clip(2.0 * ratio(taker_buy, volume) - 1.0, -1.0, 1.0)).when(volume.isNotNull(), 0.0)


def sigma_score(returns, size: int = 60, least: int = 30) -> Column:
    """A return over the standard deviation of the returns before it."""
    return ratio(_col(returns), rolling("std", returns, size, least, before=True))


def relative_activity(df: DataFrame, volume: str, out: str, size: int = 1500, least: int = 300) -> DataFrame:
    """``df`` with the log volume less the median log volume before it."""
    df = rolling_quantile(df.withColumn("_ell", F.log(F.greatest(volume, F.lit(1e-12)))), "_ell", "_median", size, least, before=True)
    return df.withColumn(out, F.col("_ell") - F.col("_median")).drop("_ell", "_median")


def decayed_sums(df: DataFrame, alpha: float, **inputs: Column) -> DataFrame:
    """``df`` with, for each input x, the sum over all bars so far of (1 - alpha) ** age * x (nulls weigh nothing).

    A prefix scan (``scans.decayed``), no recursion over the series. Rows of
    one time are taken one after another, in no set order.
    """
    df = scans.cut(df.select("*", *[x.cast("double").alias(name) for name, x in inputs.items()]))
    return scans.decayed(df, 1.0 - alpha, list(inputs)).drop(scans.BLOCK)


def ema(df: DataFrame, x, out: str, alpha: float = 0.05) -> DataFrame:
    """``df`` with the exponential average m = (1 - alpha) m + alpha x that starts at the first value that isn't null.

    Null before that; nulls after it count as 0 age nothing: the average decays
    with them left out of both sums. Rows of one time are taken in no set order.
    """
    df = scans.cut(df.withColumn("qf_x", _col(x)))
    df = scans.first_values(df, "qf_x")
    # the first value has the whole weight, later ones alpha of it
    weight = F.when(F.col("qf_x").isNotNull(), F.when(F.col(TIME) == F.col("qf_since"), 1.0).otherwise(alpha))
    df = df.withColumn("qf_sw", weight).withColumn("qf_sx", F.col("qf_sw") * F.col("qf_x"))
    df = scans.decayed(df, 1.0 - alpha, ["qf_sx", "qf_sw"])
    value = ratio(F.col("qf_sx"), F.when(F.col("qf_sw") > 0, F.col("qf_sw")))
    return df.drop("qf_x", "qf_first", "qf_since", scans.BLOCK).withColumn(out, value).drop("qf_sx", "qf_sw")


def ewm_std(df: DataFrame, x, out: str, span: int, least: int | None = None) -> DataFrame:
    """``df`` with the bias-corrected exponentially weighted standard deviation (weights (1 - alpha) ** age, alpha = 2 / (span + 1))."""
    keep = 1.0 - 2.0 / (span + 1.0)
    # centred on the series' mean so far would look ahead; the first value serves as well against cancellation
    df = scans.first_values(scans.cut(df.withColumn("qf_x", _col(x))), "qf_x")
    one, c = F.when(F.col("qf_x").isNotNull(), 1.0), F.col("qf_x") - F.col("qf_first")
    df = df.select("*", one.alias("qf_s0"), c.alias("qf_s1"), (c * c).alias("qf_s2"), one.alias("qf_sq"), one.alias("qf_n")).drop("qf_x", "qf_first", "qf_since")
    df = scans.decayed(df, keep, ["qf_s0", "qf_s1", "qf_s2"], ["qf_n"])
    df = scans.decayed(df, keep * keep, ["qf_sq"])
    s0, mean = F.col("qf_s0"), ratio(F.col("qf_s1"), F.col("qf_s0"))
    variance = (ratio(F.col("qf_s2"), s0) - mean * mean) * ratio(s0 * s0, s0 * s0 - F.col("qf_sq"))
    value = F.when((F.col("qf_n") >= (span if least is None else least)) & (F.col("qf_n") > 1), F.sqrt(F.greatest(variance, F.lit(0.0))))
    return df.withColumn(out, value).drop("qf_s0", "qf_s1", "qf_s2", "qf_sq", "qf_n", scans.BLOCK)


def _past(values: np.ndarray, size: int) -> np.ndarray:
    """For each row the ``size`` values before it, missing ones as NaN (a view)."""
    padded = np.concatenate([np.full(size, np.nan), values])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[: len(values)]


def _medians(values: np.ndarray, size: int, least: int) -> np.ndarray:
    """Median of the ``size`` values before each row, NaN with fewer than ``least``; numpy puts NaN last in order."""
    out = np.full(len(values), np.nan)
    for a in range(0, len(values), 256):
        part = np.sort(_past(values[max(0, a - size) : a + 256], size)[min(a, size) :], axis=1)
        n = np.isfinite(part).sum(axis=1)
        r = np.arange(len(part))
        mid = (part[r, np.maximum(n - 1, 0) // 2] + part[r, np.minimum(n // 2, size - 1)]) / 2
        out[a : a + 256] = np.where(n >= least, mid, np.nan)
    return out


def _ranks(values: np.ndarray, size: int, least: int) -> np.ndarray:
    """Share of the ``size`` values before each row that lie below it (ties half), between 0 and 1."""
    out = np.full(len(values), np.nan)
    for a in range(0, len(values), 256):
        part = _past(values[max(0, a - size) : a + 256], size)[min(a, size) :]
        own = values[a : a + 256, None]
        n = np.isfinite(part).sum(axis=1)
        rank = ((part < own).sum(axis=1) + 0.5 * (part == own).sum(axis=1) + 0.5) / (n + 1.0)
        out[a : a + 256] = np.where((n >= least) & np.isfinite(own[:, 0]), rank, np.nan)
    return out


def by_halo(df: DataFrame, columns: list[str], reach: int, kernel, outputs: list[str], block: int = 4096) -> DataFrame:
    """``df`` with columns from a numpy kernel that needs ``reach`` rows of history.

    A series is cut into blocks of ``block`` rows; each block's task also gets
    the ``reach`` rows before it, so that one long series spreads over as many
    tasks as it has blocks and no task holds more than ``block + reach`` rows.
    ``kernel``: arrays of ``columns`` to arrays of ``outputs``.

    Rows that repeat a bar are ordered by ``columns`` and keep a row each; nulls
    reach the kernel as NaN and its NaN come back as null; an empty table stays empty.
    """
    numbered = scans.numbered(df, "_n", *columns)
    ahead = F.floor((F.col("_n") + reach) / block)
    spread = numbered.select(KEY, "_n", *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_block", F.explode(F.sequence(F.floor(F.col("_n") / block), ahead)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        got = kernel(*[pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in columns])
        made = pd.DataFrame({KEY: pdf[KEY].to_numpy(), "_n": pdf["_n"].to_numpy()} | {o: np.where(np.isfinite(g), g, np.nan) for o, g in zip(outputs, got, strict=True)})
        return made[(pdf["_n"] // block == pdf["_block"]).to_numpy()]

    schema = f"{KEY} {dict(df.dtypes)[KEY]}, _n long, " + ", ".join(f"{o} double" for o in outputs)
    made = spread.groupBy(KEY, "_block").applyInPandas(run, schema)
    made = made.select(F.col(KEY).alias("_key"), F.col("_n").alias("_m"), *[finite(o).alias(o) for o in outputs])
    return numbered.join(made, F.col(KEY).eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("_m")), "left").drop("_n", "_m", "_key")


def rolling_quantile(df: DataFrame, x: str, out: str, size: int, least: int, q: float = 0.5, before: bool = False) -> DataFrame:
    """``df`` with the linear-interpolated quantile of the last ``size`` values of a column, the bar's own included unless ``before``.

    Null with fewer than ``least`` values. Windows are sorted in blocks of rows
    (``by_halo``), so a window's cost is a sort and not an aggregate for each bar.
    """

    def kernel(values: np.ndarray) -> list[np.ndarray]:
        got = np.full(len(values), np.nan)
        # the window after the bar's own value joined the past is that of the next row
        past = _past(values, size) if before else _past(np.append(values, np.nan), size)[1:]
        for a in range(0, len(values), 256):
            part = np.sort(past[a : a + 256], axis=1)
            n = np.isfinite(part).sum(axis=1)
            r, at = np.arange(len(part)), q * np.maximum(n - 1, 0)
            low = np.floor(at).astype(int)
            high = np.minimum(low + 1, np.maximum(n - 1, 0))
            value = part[r, low] + (at - low) * (part[r, high] - part[r, low])
            got[a : a + 256] = np.where((n >= max(least, 1)), value, np.nan)
        return [got]

    return by_halo(df, [x], size, kernel, [out])


def robust_z_causal(df: DataFrame, columns: list[str], size: int = 1500, least: int = 300) -> DataFrame:
    """``df`` with ``<c>_z``: (x - median) / (1.4826 MAD), both of the ``size`` bars before.

    The deviations are each past bar's from its own median, so two passes of
    medians are needed and the reach is twice the window.
    """

    def kernel(*values):
        out = []
        for x in values:
            m = _medians(x, size, least)
            past = np.concatenate([[np.nan], x[:-1]])
            off = np.abs(past - m)
            mad = _medians(np.concatenate([off[1:], [np.nan]]), size, least) if len(off) else off
            out.append((x - m) / (1.4826 * mad + 1e-300))
        return out

    return by_halo(df, columns, 2 * size + 1, kernel, [f"{c}_z" for c in columns])


def rank_causal(df: DataFrame, columns: list[str], size: int = 1500, least: int = 300) -> DataFrame:
    """``df`` with ``<c>_rank``, the rank of each value among the ``size`` before it, and ``<c>_gauss``, its normal quantile."""
    out = by_halo(df, columns, size, lambda *values: [_ranks(x, size, least) for x in values], [f"{c}_rank" for c in columns])
    return out.select("*", *[normal_quantile(F.col(f"{c}_rank")).alias(f"{c}_gauss") for c in columns])


def burst_events(df: DataFrame, short: int = 12, long: int = 96, quantile: float = 0.9, size: int = 500, cluster: int = 3) -> DataFrame:
    """``df`` with vol_ratio, thr, event, event_start, t2 and t2_start.

    A burst is a bar whose short volatility over its long one exceeds the
    ratio's rolling quantile; t2 is a burst with another in the ``cluster``
    bars before.
    """
    df = df.withColumn("_r", pct_change("close"))
    df = ewm_std(ewm_std(df, "_r", "_vs", short), "_r", "_vl", long)
    df = df.withColumn("vol_ratio", ratio(F.col("_vs"), F.col("_vl")))
    df = rolling_quantile(df, "vol_ratio", "thr", size, size // 2, quantile)
    df = df.withColumn("event", F.coalesce(F.col("vol_ratio") > F.col("thr"), F.lit(False)))
    before = F.coalesce(F.lag("event", 1).over(by_time()), F.lit(False))
    recent = F.coalesce(F.max("event").over(rows(-cluster, -1)), F.lit(False))
    df = df.withColumn("event_start", F.col("event") & ~before).withColumn("t2", F.col("event") & recent)
    return df.withColumn("t2_start", F.col("t2") & ~F.coalesce(F.lag("t2", 1).over(by_time()), F.lit(False))).drop("_r", "_vs", "_vl")


def momentum_sign(close, periods: int = 8) -> Column:
    return F.coalesce(F.signum(pct_change(close, periods)), F.lit(0.0))


def volatility_regime(df: DataFrame, span: int = 96, size: int = 2000) -> DataFrame:
    """``df`` with ``vol_regime``: whether the weighted volatility exceeds its rolling median."""
    df = ewm_std(df.withColumn("_r", pct_change("close")), "_r", "_v", span)
    df = rolling_quantile(df, "_v", "_median", size, size // 4)
    return df.withColumn("vol_regime", F.coalesce(F.col("_v") > F.col("_median"), F.lit(False))).drop("_r", "_v", "_median")


#: Bars in a year by bar length.
BARS_PER_YEAR = {"15min": 35040.0, "1h": 8760.0, "4h": 2190.0, "1d": 365.0}


def annual_volatility(df: DataFrame, out: str, span: int, bars_per_year: float) -> DataFrame:
    df = ewm_std(df.withColumn("_r", pct_change("close")), "_r", "_v", span)
    return df.withColumn(out, F.col("_v") * float(np.sqrt(bars_per_year))).drop("_r", "_v")


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of every symbol; of bars that repeat a time at the cut any may stay. Fewer bars stay all, an empty table empty."""
    place = spare(df, "_n")
    newest = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))
    return df.withColumn(place, newest).where(F.col(place) <= n).drop(place)


def last_of_duplicates(df: DataFrame, *order: str, keep: str = "last") -> DataFrame:
    """One row per (symbol, bar): the last (or first) in the given order; what is missing stays behind either way, as in SQL's NULLS LAST."""
    sort = [F.desc_nulls_last(c) if keep == "last" else F.asc_nulls_last(c) for c in order]
    place = spare(df, "_n")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(KEY, TIME).orderBy(*sort))).where(F.col(place) == 1).drop(place)


def filled(x) -> Column:
    """Nulls take the next value, or else the one before (looks ahead)."""
    x = _col(x)
    w = by_time()
    after = F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(x, after, F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
