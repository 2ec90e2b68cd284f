"""Statistics as aggregates: ranks, correlations, permutation tests, runs and profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflume.functions import scans
from quantflume.functions.scalar import finite
from quantflume.functions.series import KEY, TIME, by_time, spare
from quantflume.kernels import boosting


def run_lengths(df: DataFrame, state: str) -> DataFrame:
    """Per symbol: how often ``state`` changes from bar to bar, and the mean length of its runs."""
    at = scans.changes(df, state)
    return at.select(KEY, "changes", (F.col("rows") / (F.col("changes") + 1)).alias("mean_run"))


def average_rank(column: str, *by: str) -> Column:
    """Rank from 1 with ties at their mean; the rows of a group are ordered once."""
    by = by or (KEY,)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (ties - 1) / 2


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Per group the rank correlation of the rows that have both values."""
    by = by or (KEY,)
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    df = df.select(*by, average_rank(x, *by).alias("_rx"), average_rank(y, *by).alias("_ry"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def autocorrelation(df: DataFrame, x: str, lag: int = 1) -> DataFrame:
    df = df.withColumn("_l", F.lag(x, lag).over(by_time()))
    return df.where(F.col(x).isNotNull() & F.col("_l").isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.corr(x, "_l").alias("rho"))


def residuals(df: DataFrame, columns: list[str], controls: list[str], season: str, key: str = KEY) -> DataFrame:
    """``df`` with ``<c>_res``: what the controls and a dummy for each season value leave of a column.

    Demeaning within a season stands for the dummies, so a symbol's regression
    needs its (k x k) sums of products only: one aggregate, solved per symbol.
    """
    within = Window.partitionBy(key, season)
    for c in [*columns, *controls]:
        df = df.withColumn(f"_d_{c}", F.col(c) - F.avg(c).over(within))
    pairs = [(a, b) for k, a in enumerate(controls) for b in controls[k:]]
    moments = df.groupBy(key).agg(*[F.sum(F.col(f"_d_{a}") * F.col(f"_d_{b}")).alias(f"_m_{a}_{b}") for a, b in pairs], *[F.sum(F.col(f"_d_{a}") * F.col(f"_d_{c}")).alias(f"_v_{a}_{c}") for a in controls for c in columns])

    def solve(pdfs):
        for pdf in pdfs:
            out = {key: pdf[key].to_numpy()}
            coefs = {f"_b_{a}_{c}": [] for a in controls for c in columns}
            for _, row in pdf.iterrows():
                m = np.zeros((len(controls), len(controls)))
                for a, b in pairs:
                    i, j = controls.index(a), controls.index(b)
                    m[i, j] = m[j, i] = row[f"_m_{a}_{b}"]
                for c in columns:
                    beta = np.linalg.pinv(m, hermitian=True) @ np.array([row[f"_v_{a}_{c}"] for a in controls])
                    for a, x in zip(controls, beta, strict=True):
                        coefs[f"_b_{a}_{c}"].append(float(x))
            yield pd.DataFrame(out | coefs)

    kind = dict(df.dtypes)[key]
    solved = moments.mapInPandas(solve, f"{key} {kind}, " + ", ".join(f"_b_{a}_{c} double" for a in controls for c in columns))
    df = df.join(solved, key)
    for c in columns:
        fit = F.lit(0.0)
        for a in controls:
            fit = fit + F.col(f"_b_{a}_{c}") * F.col(f"_d_{a}")
        df = df.withColumn(f"{c}_res", F.col(f"_d_{c}") - fit)
    drop = [c for c in df.columns if c.startswith(("_d_", "_b_"))]
    return df.drop(*drop)


def circular_shift_test(df: DataFrame, x: str, y: str, shifts: list[int]) -> DataFrame:
    """Per symbol: the correlation of x and y, and the share of shifted copies of x that correlate as much (one-sided p).

    A symbol is one task of two columns: all circular correlations come from
    one Fourier transform, whatever the number of shifts. Rows with a null are
    left out; rows that repeat a bar are ordered by their values; without a row
    a symbol gives none, and a constant column a null.
    """
    kind = dict(df.dtypes)[KEY]
    names = [KEY, "rho", "p", "n_perm", "null_p95"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([TIME, "_x", "_y"])
        a, b = (pdf[c].to_numpy() - pdf[c].mean() for c in ("_x", "_y"))
        scale = np.sqrt((a * a).sum() * (b * b).sum())
        if not scale > 0:
            return pd.DataFrame([[pdf[KEY].iloc[0], np.nan, np.nan, len(shifts), np.nan]], columns=names)
        rho = np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), len(a)) / scale
        null = rho[np.array(shifts) % len(a)]
        p = (1 + (null >= rho[0]).sum()) / (1 + len(null))
        return pd.DataFrame([[pdf[KEY].iloc[0], rho[0], p, len(null), np.quantile(null, 0.95)]], columns=names)

    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(KEY, TIME, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    out = pairs.groupBy(KEY).applyInPandas(run, f"{KEY} {kind}, rho double, p double, n_perm long, null_p95 double")
    return out.select(KEY, finite("rho").alias("rho"), finite("p").alias("p"), "n_perm", finite("null_p95").alias("null_p95"))


def replica_test(observed: DataFrame, replicas: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: z of the observed value against the replicas, and the two-sided Monte-Carlo p of its distance from their median."""
    null = replicas.groupBy(by).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"), F.median(value).alias("_med"), F.count(value).alias("n_null"))
    at = observed.select(by, F.col(value).alias("_obs")).join(null, by)
    far = replicas.select(by, F.col(value).alias("_v")).join(at, by).groupBy(by).agg(F.sum((F.abs(F.col("_v") - F.col("_med")) >= F.abs(F.col("_obs") - F.col("_med"))).cast("long")).alias("_hits"))
    out = at.join(far, by)
    return out.select(by, "n_null", ((F.col("_obs") - F.col("_mu")) / (F.col("_sd") + 1e-12)).alias("z"), ((1 + F.col("_hits")) / (1 + F.col("n_null"))).alias("p"))


def position_matched(df: DataFrame, null: DataFrame, position: str, value: str, bins: int = 10, key: str = KEY) -> DataFrame:
    """Per symbol: the mean of the values less the null's median at the same position (bins by the null's quantiles)."""
    cuts = null.groupBy(key).agg(F.percentile(position, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("_cuts"))
    bin_ = F.size(F.filter("_cuts", lambda c: c <= F.col(position)))
    ref = null.join(cuts, key).withColumn("_bin", bin_).groupBy(key, "_bin").agg(F.median(value).alias("_ref"))
    return df.join(cuts, key).withColumn("_bin", bin_).join(ref, [key, "_bin"]).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value) - F.col("_ref")).alias("excess"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: count, mean, deviation, variation, shares of distinct, saturated and modal values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_e")).select("_e.column", "_e.x").where("x is not null")
    counts = long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("_k"))  # distinct and modal shares from one pre-aggregation
    k, x = F.col("_k"), F.col("x")
    n = F.sum("_k")
    sums = counts.groupBy("column").agg(n.alias("n"), (F.sum(k * x) / n).alias("mean"), (F.sum(k * F.abs(x)) / n).alias("_abs"), (F.count(F.lit(1)) / n).alias("distinct_share"), (F.sum(F.when(F.abs(x) >= 0.999e6, k).otherwise(0)) / n).alias("saturated_share"), (F.max("_k") / n).alias("mode_share"))
    sd = long.groupBy("column").agg(F.stddev_samp("x").alias("sd"))
    return sums.join(sd, "column").select("column", "n", "mean", "sd", (F.col("sd") / (F.col("_abs") + 1e-300)).alias("cv"), "distinct_share", "saturated_share", "mode_share")


def value_counts(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Count and share of every value within its group."""
    by = by or (KEY,)
    out = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def duplicate_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns (the first one of a set, a later one) that are equal on every row and not constant; one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    aggs = [F.max(F.when(F.col(a).eqNullSafe(F.col(b)), 0).otherwise(1)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    flat = [F.coalesce(F.max(c) > F.min(c), F.lit(False)).alias(f"_v{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs, *flat)
    found = F.array(*[F.when((F.col(f"_{i}") == 0) & F.col(f"_v{columns.index(a)}"), F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array_compact(found)).alias("_p")).select("_p.first", "_p.second")


def changed_share(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: the share of common bars on which two runs differ (beyond 1e-9 relative, or in one being null)."""
    both = a.select(KEY, TIME, *[F.col(c).alias(f"_a_{c}") for c in columns]).join(b.select(KEY, TIME, *[F.col(c).alias(f"_b_{c}") for c in columns]), [KEY, TIME])
    off = lambda c: F.when(F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull(), 1.0).when(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) > 1e-9 * (1 + F.abs(f"_a_{c}")), 1.0).otherwise(0.0)
    one = both.agg(*[F.avg(off(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in columns])).alias("_e")).select("_e.column", "_e.changed")


def periodogram(df: DataFrame, x: str, count: int) -> DataFrame:
    """Per symbol the power |sum x exp(-2 pi i k n / N)|^2 / N at the first ``count`` frequencies k, nulls left out.

    Sums of products with the waves, pre-aggregated in every task: a few
    frequencies need no transform. Rows that repeat a bar are ordered by value;
    frequencies above N / 2 give no row.
    """
    rows = df.where(F.col(x).isNotNull()).select(KEY, TIME, F.col(x).cast("double").alias("qf_x"))
    rows = scans.numbered(rows, "qf_n", "qf_x")
    sizes = rows.groupBy(F.col(KEY).alias("qf_key")).agg(F.count(F.lit(1)).alias("qf_size"))
    rows = rows.join(sizes, F.col(KEY).eqNullSafe(F.col("qf_key")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(count - 1).cast("long"), F.floor(F.col("qf_size") / 2)))))
    # whole turns are left out before the angle is made
    angle = 2 * np.pi * ((F.col("k") * F.col("qf_n")) % F.col("qf_size")) / F.col("qf_size")
    waves = rows.groupBy(KEY, "k").agg(F.sum(F.col("qf_x") * F.cos(angle)).alias("re"), F.sum(F.col("qf_x") * F.sin(angle)).alias("im"), F.max("qf_size").alias("n"))
    return waves.select(KEY, "k", ((F.col("re") ** 2 + F.col("im") ** 2) / F.col("n")).alias("power"))


def pivoted(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Means of ``value`` as a table: a row for each value of ``row``, a column for each of ``values``; null where there is none. One aggregate."""
    return df.groupBy(row).agg(*[F.avg(F.when(F.col(column) == v, F.col(value))).alias(f"{column}_{v}") for v in values])


def reproduction(df: DataFrame, published: dict[str, float], tolerance: dict[str, float], *by: str) -> DataFrame:
    """Each row's metrics beside their published values: (by, metric, value, published, ok); a null value isn't ok."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("published"), F.lit(float(tolerance[m])).alias("_tol")) for m, v in published.items()])).alias("_e")
    out = df.select(*by, each).select(*by, "_e.*")
    return out.select(*by, "metric", "value", "published", F.coalesce(F.abs(F.col("value") - F.col("published")) <= F.col("_tol"), F.lit(False)).alias("ok"))


def field_equation(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Per symbol the single factor kappa in left = kappa * right over all bars and components, and its R squared."""
    gt = sum((F.sum(F.col(a) * F.col(b)) for a, b in zip(left, right, strict=True)), F.lit(0.0))
    tt = sum((F.sum(F.col(b) * F.col(b)) for b in right), F.lit(0.0))
    gg = sum((F.sum(F.col(a) * F.col(a)) for a in left), F.lit(0.0))
    out = df.groupBy(KEY).agg(gt.alias("_gt"), tt.alias("_tt"), gg.alias("_gg"))
    kappa = F.col("_gt") / (F.col("_tt") + 1e-300)
    rest = F.col("_gg") - 2 * kappa * F.col("_gt") + kappa * kappa * F.col("_tt")
    return out.select(KEY, kappa.alias("kappa"), (1 - rest / (F.col("_gg") + 1e-300)).alias("r2"))


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per symbol the line y = a + b x by least squares, and R squared."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(KEY).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def fold_r2(df: DataFrame, features: list[str], targets: str | list[str], folds: int = 5, rounds: int = 200, rate: float = 0.05, leaves: int = 15, least: int = 20) -> DataFrame:
    """Per symbol (and target, if several are listed) the R squared of boosted trees out of fold; folds are equal runs of time.

    A (symbol, target, fold) is a task that fits on the symbol's other folds, so
    fits run beside each other and a task holds one symbol's complete rows.
    Rows with a null among features or target are left out; rows that repeat a
    bar are ordered by target; a symbol with fewer than ``2 * least`` rows to fit on, or a constant target, has a null.
    """
    many = not isinstance(targets, str)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("_y")) for t in (targets if many else [targets])])).alias("_e")
    ok = df.where(" and ".join(f"{c} is not null" for c in features)).select(KEY, TIME, *[F.col(c).cast("double").alias(c) for c in features], each).select(KEY, TIME, *features, "_e.*").where("_y is not null")
    ok = ok.withColumn("_fold", F.ntile(folds).over(Window.partitionBy(KEY, "target").orderBy(TIME, "_y")) - 1)
    spread = ok.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = (pdf["_fold"] == pdf["_out"]).to_numpy()
        x, y = pdf[features].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float)
        fine = out.any() and (~out).sum() >= 2 * least
        got = boosting.predictions(x[~out], y[~out], x[out], rounds, rate, leaves, least) if fine else np.full(out.sum(), np.nan)
        return pd.DataFrame({KEY: pdf[KEY].to_numpy()[out], "target": pdf["target"].to_numpy()[out], "_y": y[out], "_p": got})

    found = spread.groupBy(KEY, "target", "_out").applyInPandas(run, f"{KEY} {dict(df.dtypes)[KEY]}, target string, _y double, _p double")
    whole = F.var_pop("_y") * F.count(F.lit(1))
    out = found.groupBy(KEY, "target").agg(F.count(F.lit(1)).alias("n"), finite(1 - F.try_divide(F.sum((F.col("_y") - F.col("_p")) ** 2), whole)).alias("r2"))
    return out if many else out.drop("target")


def sample_by_hash(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` bars of every symbol, the same for a seed whatever the partitioning.

    They are those of the least MD5 of seed and time, so that any engine draws
    the same; of bars that repeat a time any may stay. A symbol with fewer bars
    gives all.
    """
    place = spare(df, "_n")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(TIME).cast("string")))
    at = F.row_number().over(Window.partitionBy(KEY).orderBy(order, TIME))
    return df.withColumn(place, at).where(F.col(place) <= n).drop(place)
