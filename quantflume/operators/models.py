"""Fitted models, surrogates and model-space speed as grouped tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflume.functions import series
from quantflume.functions.robust import over_all
from quantflume.functions.scalar import atanh_clipped, finite
from quantflume.functions.series import KEY, TIME, by_time
from quantflume.kernels import volatility as vol
from quantflume.kernels import windows
from quantflume.operators import stats


_GARCH = ("omega", "alpha", "beta", "nu")


def garch_fit(df: DataFrame, returns: str, rounds: int = 4000) -> DataFrame:
    """Per symbol the GARCH(1,1)-t parameters of a return column by maximum likelihood. The likelihood is sequential: a symbol is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(TIME)[returns].to_numpy(dtype=float)
        r = r[np.isfinite(r)]
        if len(r) < 10 or r.std() == 0:
            return pd.DataFrame(columns=[KEY, "n", "omega", "alpha", "beta", "nu", "converged"])
        return pd.DataFrame([{KEY: pdf[KEY].iloc[0], "n": len(r)} | vol.fit_garch(r, rounds)])

    return df.select(KEY, TIME, returns).groupBy(KEY).applyInPandas(run, f"{KEY} string, n long, omega double, alpha double, beta double, nu double, converged boolean")


def garch_filter(df: DataFrame, returns: str, omega: float, alpha: float, beta: float) -> DataFrame:
    """``df`` with the conditional deviation ``sigma``; its recursion is a decayed sum that starts at the whole variance."""
    df = df.where(F.col(returns).isNotNull()).withColumn("_v0", over_all(F.var_pop(returns)))
    past = F.lag(returns).over(by_time())
    df = df.withColumn("_drive", F.when(past.isNull(), F.col("_v0")).otherwise(omega + alpha * past * past))
    df = series.decayed_sums(df, 1 - beta, _s2=F.col("_drive"))
    return df.withColumn("sigma", F.sqrt("_s2")).drop("_v0", "_drive", "_s2")


def flow_fit(df: DataFrame, rounds: int = 4000) -> DataFrame:
    """Per symbol the order-flow model: GARCH parameters, the two regressions, deviations and correlation of their residuals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        pdf = pdf[(pdf["close"] > 0) & pdf["volume"].notna()]
        if len(pdf) < 30:
            return pd.DataFrame(columns=[KEY, "n", "garch", "a", "b", "s1", "s2", "corr"])
        m = vol.fit_flow(*(pdf[c].to_numpy(dtype=float) for c in ("close", "volume", "taker_buy")), rounds)
        return pd.DataFrame([{KEY: pdf[KEY].iloc[0], "n": len(pdf), "garch": [m.garch[k] for k in _GARCH], "a": m.a, "b": m.b, "s1": m.s1, "s2": m.s2, "corr": m.corr}])

    return df.select(KEY, TIME, "close", "volume", "taker_buy").groupBy(KEY).applyInPandas(run, f"{KEY} string, n long, garch array<double>, a array<double>, b array<double>, s1 double, s2 double, corr double")


def design_rows(df: DataFrame) -> DataFrame:
    """Flow coordinates and the regressors of the local models, with ``ok`` where a row can be used."""
    df = df.withColumn("r", series.log_return(F.when(F.col("close") > 0, F.col("close"))))
    df = df.withColumn("z", series.sigma_score("r")).withColumn("star", atanh_clipped(series.flow_imbalance("volume", "taker_buy"))).withColumn("ell", F.log(F.greatest("volume", F.lit(1e-12))))
    df = df.withColumn("star_before", F.lag("star").over(by_time())).withColumn("ell_before", F.lag("ell").over(by_time()))
    whole = F.lit(True)
    for c in ("r", "z", "star", "star_before", "ell", "ell_before"):
        whole = whole & F.col(c).isNotNull()
    return df.withColumn("ok", whole)


def evaluations(df: DataFrame, window: int, step: int, nu: float, split: str | None = None, target: bool = True, halves: float = 0.5, since_ms: int | None = None, per_task: int = 128) -> DataFrame:
    """Fisher-Rao speed between the two parts of a sliding window, every ``step`` bars, with controls and the target.

    ``split``: "even" or "odd" rows only (for reliability); ``halves``: where
    the window is cut. A task has ``per_task`` evaluations that follow each
    other, whose windows' normal equations come from the same sums, and
    ``window + (per_task + 1) * step`` rows at most; a row goes to the few
    tasks whose windows or targets hold it.
    """
    first = window + 2 * step + 61
    rows = design_rows(df).withColumn("_n", (F.row_number().over(by_time()) - 1).cast("long"))
    rows = rows.withColumn("_size", over_all(F.max("_n")) + 1)
    ahead, reach = step if target else 0, max(window, 2 * step)
    low = F.greatest(F.ceil((F.col("_n") - ahead + 1 - first) / step), F.lit(0)).cast("long")
    high = F.floor((F.col("_n") + reach - first) / step).cast("long")
    used = rows.where(high >= low).withColumn("_task", F.explode(F.sequence(F.floor(low / per_task), F.floor(high / per_task))))
    cut = window - int(window * halves)
    cols = ["r", "z", "star", "star_before", "ell", "ell_before"]
    numbers = ["v_flow", "v_total", "dlog_sigma", "da1", "log_rv_S", "log_rv_W", "abs_dlog_rv", "y"]
    names = [KEY, TIME, "t", *numbers]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        start, task, n, ok = int(pdf["_n"].iloc[0]), int(pdf["_task"].iloc[0]), pdf["_n"].to_numpy(), pdf["ok"].to_numpy(dtype=bool)
        r, z, star, star0, ell, ell0 = (pdf[c].to_numpy(dtype=float) for c in cols)
        times, size = pdf[TIME].to_numpy(), int(pdf["_size"].iloc[0])
        t = np.arange(task * per_task * step + first, (task + 1) * per_task * step + first, step)
        t = t[(t <= size - ahead) & (t <= n[-1] + 1)]
        if since_ms is not None:
            t = t[times[t - 1 - start] >= since_ms]
        if not len(t):
            return pd.DataFrame(columns=names)
        at = t - start  # rows follow each other
        # every window begins and ends at one of these, wherever its task begins
        bounds = np.arange(max(0, at[0] - reach), at[-1] + ahead + 1)
        bounds = bounds[np.isin((bounds - at[0]) % step, np.array([0, -cut, -window]) % step)]
        parity = np.ones(len(n), dtype=bool) if split is None else n % 2 == (0 if split == "even" else 1)
        use, one = ok & parity, np.ones(len(n))
        known = np.isfinite(r)
        designs = [(np.column_stack([one, z, star0]), star), (np.column_stack([one, ell0, np.abs(z), z]), ell)]
        with np.errstate(invalid="ignore"):
            sums = [windows.Cells(windows.products(x, y, use), bounds) for x, y in designs]
        size_of = windows.Cells(np.column_stack([parity, use]).astype(float), bounds)
        moved = windows.Cells(np.column_stack([np.where(known, r * r, 0.0), known]), bounds)
        parts, enough = [], np.ones(len(at), dtype=bool)
        for a, b in ((at - window, at - cut), (at - cut, at)):
            count = size_of.over(a, b)
            enough &= (count[:, 1] >= 0.8 * count[:, 0]) & (count[:, 0] > 0)
            inside = a[:, None] + np.arange(b[0] - a[0])
            parts.append(([windows.regressions(c.over(a, b), x.shape[1]) for c, (x, _) in zip(sums, designs, strict=True)], windows.t_scales(np.where(use, r, 0.0)[inside], use[inside], nu)))
        out = windows.speeds(parts[0][0], parts[1][0], parts[0][1], parts[1][1], nu)

        def rv(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = moved.over(a, b)
            return np.where(total[:, 1] > 0, np.sqrt(total[:, 0]), np.nan)

        with np.errstate(divide="ignore", invalid="ignore"):
            now = rv(at - step, at)
            out |= {"log_rv_S": np.log(now), "log_rv_W": np.log(rv(at - window, at)), "abs_dlog_rv": np.abs(np.log(now / rv(at - 2 * step, at - step))), "y": np.abs(np.log(rv(at, at + step) / now)) if target else np.full(len(at), np.nan)}
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], TIME: times[at - 1], "t": t} | out)[names][enough]

    kinds = dict(df.dtypes)
    out = used.select(KEY, TIME, "_n", "_size", "_task", "ok", *cols).groupBy(KEY, "_task").applyInPandas(run, f"{KEY} {kinds[KEY]}, {TIME} {kinds[TIME]}, t long, " + ", ".join(f"{c} double" for c in numbers))
    return out.select(KEY, TIME, "t", *[finite(c).alias(c) for c in numbers])


def speed_test(ev: DataFrame, season: str, shifts: list[int]) -> DataFrame:
    """Rank correlation of speed and target, freed of the controls and the season ("hour" or "weekday"), with its circular-shift p."""
    at = F.timestamp_millis(TIME)
    df = ev.withColumn("abs_dls", F.abs("dlog_sigma")).withColumn("_season", F.hour(at) if season == "hour" else F.weekday(at))
    controls = ["log_rv_S", "log_rv_W", "abs_dlog_rv", "abs_dls"]
    df = df.where(" and ".join(f"{c} is not null" for c in ["v_flow", "y", *controls]))
    df = df.select(KEY, TIME, "_season", *[stats.average_rank(c).alias(f"r_{c}") for c in ["v_flow", "y", *controls]])
    df = stats.residuals(df, ["r_v_flow", "r_y"], [f"r_{c}" for c in controls], "_season")
    return stats.circular_shift_test(df, "r_v_flow_res", "r_y_res", shifts)


def garch_bars(df: DataFrame, returns: str, seed: int = 0, rounds: int = 4000) -> DataFrame:
    """Bars of a new path of each symbol's fitted return process, at its bars' times and with their volumes.

    A path opens where its symbol does and has a bar for each that has a
    return; symbols whose returns can't be fitted have none.
    """
    fitted = garch_fit(df, returns, rounds).select(KEY, F.array(*_GARCH).alias("_g"))
    base = df.where(F.col(returns).isNotNull()).select(KEY, TIME, F.col("open").cast("double").alias("open"), "volume").join(fitted, KEY)
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        r, _ = vol.garch_paths(len(pdf), seed, *pdf["_g"].iloc[0])
        close = pdf["open"].iloc[0] * np.exp(np.cumsum(r))
        before = np.concatenate([pdf["open"].to_numpy()[:1], close[:-1]])
        return pd.DataFrame({KEY: pdf[KEY], TIME: pdf[TIME], "open": before, "high": np.maximum(before, close), "low": np.minimum(before, close), "close": close, "volume": pdf["volume"]})

    return base.groupBy(KEY).applyInPandas(run, f"{KEY} {kinds[KEY]}, {TIME} {kinds[TIME]}, open double, high double, low double, close double, volume {kinds['volume']}")


def flow_replicas(df: DataFrame, replicas: int, rounds: int = 4000, regime: tuple[float, float, float, int] | None = None) -> DataFrame:
    """Paths of each symbol's fitted order-flow model at its bars: (symbol, replica, bar_ms, close, volume, taker_buy). A replica is a task; ``regime``: see ``volatility.flow_path``."""
    fitted = flow_fit(df, rounds).select(KEY, F.struct("garch", "a", "b", "s1", "s2", "corr").alias("_m"))
    times = df.where((F.col("close") > 0) & F.col("volume").isNotNull()).select(KEY, TIME, "close").join(fitted, KEY)
    jobs = times.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        m, seed = pdf["_m"].iloc[0], int(pdf["replica"].iloc[0])
        model = vol.Flow(dict(zip(_GARCH, m["garch"], strict=True)), np.array(m["a"]), np.array(m["b"]), m["s1"], m["s2"], m["corr"])
        path = vol.flow_path(model, len(pdf), seed, float(pdf["close"].iloc[0]), regime)
        return pd.DataFrame({KEY: pdf[KEY], "replica": seed, TIME: pdf[TIME], "close": path["close"], "volume": path["volume"], "taker_buy": path["taker_buy"]})

    return jobs.groupBy(KEY, "replica").applyInPandas(run, f"{KEY} {kinds[KEY]}, replica int, {TIME} {kinds[TIME]}, close double, volume double, taker_buy double")


def surrogates(df: DataFrame, returns: str, kinds: tuple[str, ...] = ("shuffle", "spectrum", "garch"), replicas: int = 19, rounds: int = 100) -> DataFrame:
    """Replicas of every symbol's return series: (symbol, kind, replica, bar_ms, ret). A replica is a task; the model is fitted once a symbol."""
    fitted = garch_fit(df, returns).select(KEY, F.array(*_GARCH).alias("_g")) if "garch" in kinds else None
    base = df.where(F.col(returns).isNotNull()).select(KEY, TIME, F.col(returns).alias("r"))
    if fitted is not None:
        base = base.join(fitted, KEY, "left")
    jobs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("replica")) for k in kinds for i in range(replicas)]))
    base = base.select("*", jobs.alias("_j")).select(KEY, TIME, "r", *(["_g"] if fitted is not None else []), "_j.kind", "_j.replica")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIME)
        r, kind, seed = pdf["r"].to_numpy(dtype=float), pdf["kind"].iloc[0], int(pdf["replica"].iloc[0])
        if kind == "shuffle":
            x = vol.surrogate_shuffle(r, seed)
        elif kind == "spectrum":
            x = vol.surrogate_spectrum(r, seed, rounds)
        else:
            x = vol.garch_paths(len(r), seed, *pdf["_g"].iloc[0])[0]
        return pd.DataFrame({KEY: pdf[KEY], "kind": kind, "replica": seed, TIME: pdf[TIME], "ret": x})

    return base.groupBy(KEY, "kind", "replica").applyInPandas(run, f"{KEY} string, kind string, replica int, {TIME} long, ret double")
