"""Registered queries with known answers: files written and read back, exact densities, curvatures and grids, checks of files and figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflume.operators import geometry, grid, stats
from quantflume.plans import backtest_queries, series_queries
from quantflume.plans.join_queries import b1h, b4h
from quantflume.plans.oracle import DAILY, FUNDING, W, r
from quantflume.plans.series_queries import B1H, B4H, KEYS, rd
from quantflume.session import scratch_dir
from quantflume.sources import bars, klines


def _folder(spark: SparkSession, name: str) -> str:
    """A query's own folder among the application's shared ones."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}"


def _as_klines(df: DataFrame, scale: int = 1) -> DataFrame:
    """Bars in the columns of kline files; times in milliseconds times ``scale``."""
    zero = F.lit(0)
    return df.select((F.col("bar_ms") * scale).alias("open_time"), *klines.PRICES, (F.col("bar_ms") * scale + 1).alias("close_time"), zero.alias("quote_volume"), F.col("trades"), F.col("taker_buy").alias("taker_base"), zero.alias("taker_quote"), zero.alias("ignore"))


def kline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars through kline files of two folders, one in microseconds and with a header, that share an hour in four."""
    base, df = _folder(spark, "klines"), b1h(spark, sf_dir)
    hour = F.floor(F.col("bar_ms") / bars.HOUR) % 4
    _as_klines(df.where(hour >= 1)).write.mode("overwrite").csv(f"{base}/a")
    _as_klines(df.where(hour <= 1), 1000).write.mode("overwrite").option("header", True).csv(f"{base}/b")
    out = klines.read_klines(spark, [f"{base}/a", f"{base}/b"], flow=True)
    return out.select(*KEYS, *[rd(c, c) for c in (*klines.PRICES, "taker_buy")], F.col("trades").cast("long").alias("trades"))


def ohlcv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-hour bars through a folder that mixes files with headers and ISO times and files without a header."""
    base, df = _folder(spark, "ohlcv"), b4h(spark, sf_dir)
    early = F.floor(F.col("bar_ms") / bars.DAY) % 2 == 0
    iso = F.date_format(F.timestamp_millis("bar_ms"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    df.where(early).select("volume", iso.alias(" Datetime"), F.col("close").alias("Close"), "open", "high", "low").write.mode("overwrite").option("header", True).csv(f"{base}/a")
    _as_klines(df.where(~early)).write.mode("overwrite").csv(f"{base}/b")
    return klines.read_ohlcv(spark, f"{base}/*", pattern="*.csv").select(*KEYS, *[rd(c, c) for c in klines.PRICES])


def funding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding rates through two folders of files, columns found by their names."""
    base, df = _folder(spark, "funding"), bars.funding(spark, sf_dir)
    odd = F.floor(F.col("bar_ms") / bars.DAY) % 2 == 1
    for name, part in (("a", df.where(odd)), ("b", df.where(~odd))):
        part.select(F.col("bar_ms").alias("calc_time"), F.lit(8).alias("funding_interval_hours"), F.col("funding").alias("last_funding_rate")).write.mode("overwrite").option("header", True).csv(f"{base}/{name}")
    return klines.read_funding(spark, [f"{base}/a", f"{base}/b"]).select(*KEYS, rd("funding", "funding", 9))


def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes written as a CSV layer under a tag and kept; a second call reads what was kept, and makes nothing."""
    base = _folder(spark, "layers")
    made = klines.write_layer(bars.daily_bars(spark, sf_dir).select(*KEYS, "close", "volume"), base, "daily", "run", "csv")
    read = lambda: spark.read.option("header", True).schema("symbol string, bar_ms long, close double, volume double").csv(made)
    layer = read()
    klines.cached(spark, f"{base}/kept", read, layer)

    def again() -> DataFrame:
        raise RuntimeError("what was kept should have been read")

    return klines.cached(spark, f"{base}/kept", again, layer).select(*KEYS, rd("close", "close"), rd("volume", "volume"))


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrity report as JSON lines, parsed again."""
    report = series_queries.QUERIES["integrity_report"](spark, sf_dir)
    path = klines.write_report(report, _folder(spark, "reports"), "integrity")
    return spark.read.text(path).select(F.from_json("value", report.schema).alias("v")).select("v.*")


def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of files (an order is one), some published wrongly, some not at all."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("text"))
    files = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    wrong = F.when(F.col("o_orderkey") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    published = orders.where(F.col("o_orderkey") % 11 != 0).select(F.col("o_orderkey").cast("string").alias("path"), F.upper(F.sha2(wrong, 256)).alias("sha256"))
    return klines.checksums(files, published)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null and embedding is not null")
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), *[F.col("embedding")[k].cast("double").alias(f"x{k + 1}") for k in range(7)])


_X3 = ["x1", "x2", "x3"]
_PAIRS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def density_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log density, gradient, Hessian, leave-one-out scores and Fisher metric of the vectors of each label."""
    out = geometry.density_at(_vectors(spark, sf_dir), _X3, "label", "vec_id")
    named = lambda col, digits: [rd(F.col(col)[k], f"{col}_{k}", digits) for k in range(3 if col in ("gradient", "score") else 6)]
    return out.select("label", "vec_id", rd("h", "h"), rd("log_density", "log_density"), *named("gradient", 5), *named("hessian", 5), *named("score", 5), *named("fisher", 5))


_SPHERES = [(2, 1.0), (2, 2.0), (3, 1.0), (3, 0.5)]


def sphere_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curvature of four spheres at every vector: scalar d (d - 1) / r^2, Einstein tensor (2 - d) (d - 1) / (2 r^2) times the metric, and a Christoffel symbol's distance from -2 x / (r^2 + |x|^2); the scalar's relative error is 0 in 4 digits."""
    parts, points = [], _vectors(spark, sf_dir)
    for dim, radius in _SPHERES:
        got = geometry.sphere_curvature(points, _X3[:dim], "vec_id", radius).join(points, "vec_id")
        far = radius**2 + sum((F.col(c) ** 2 for c in _X3[:dim]), F.lit(0.0))
        parts.append(got.select("vec_id", F.lit(dim).alias("dim"), F.lit(radius).alias("radius"), rd("R", "R", 3), rd(F.col("R") * radius**2 / (dim * (dim - 1)) - 1, "R_error", 4), rd(F.col("einstein_11") / F.col("g_11"), "einstein_share", 3), rd(F.col("gamma_1_11") + 2 * F.col("x1") / far, "gamma_error", 4), rd("g_11", "g_11")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def stress_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's stress tensor under the flat metric with vectors' components as gradients."""
    out = geometry.stress_at(_vectors(spark, sf_dir), _X3, ["x4", "x5", "x6"], "x7", "vec_id")
    return out.select("vec_id", *[rd(f"t_{a + 1}{b + 1}", f"t_{a + 1}{b + 1}") for a, b in _PAIRS], rd("norm", "norm"))


def trilinear_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trilinear function from a coarse grid, which interpolation gives back exactly inside and at the edge."""
    axes = [np.linspace(-0.2, 0.2, 5), np.linspace(-0.1, 0.3, 4), np.linspace(-0.3, 0.1, 6)]
    x, y, z = np.meshgrid(*axes, indexing="ij")
    out = grid.multilinear(_vectors(spark, sf_dir).select("vec_id", *_X3), _X3, axes, 1 + 2 * x - 3 * y + 4 * z + 5 * x * y - 6 * y * z + 7 * x * y * z, "value")
    return out.select("vec_id", rd("value", "value"))


def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of the daily series' returns at the lowest frequencies."""
    df = bars.daily_bars(spark, sf_dir).withColumn("r", F.tanh(F.log("close") - F.log("open")))
    return stats.periodogram(df, "r", 8).select("symbol", "k", rd("power", "power", 8))


def reproduction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly metrics of the trend returns beside published ones."""
    # fixed values: the published annual return, Sharpe ratio and drawdown, and how far a run may be off
    published, tolerance = {"ret_annual": 0.222, "sharpe": 1.53, "max_dd": 0.175}, {"ret_annual": 0.010, "sharpe": 0.10, "max_dd": 0.010}
    df = backtest_queries.QUERIES["yearly_gate"](spark, sf_dir)
    return stats.reproduction(df, published, tolerance, "symbol", "year")


def pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hourly volume by hour and weekday, as a figure takes it."""
    at = F.timestamp_millis("bar_ms")
    df = b1h(spark, sf_dir).select(F.hour(at).cast("long").alias("hour"), F.weekday(at).alias("weekday"), "volume")
    out = stats.pivoted(df, "hour", "weekday", list(range(7)), "volume")
    return out.select("hour", *[rd(f"weekday_{k}", f"weekday_{k}") for k in range(7)])


QUERIES = {f.__name__: f for f in (kline_files, ohlcv_folder, funding_files, layer_files, json_report, file_checksums, density_exact, sphere_curvature, stress_tensor, trilinear_lookup, periodogram, reproduction_check, pivot_table)}

_VEC = "v AS (SELECT vec_id, label::BIGINT AS label, " + ", ".join(f"embedding[{k}]::DOUBLE AS x{k}" for k in range(1, 8)) + " FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"
_AXES = (1, 2, 3)
_UPPER = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
_PAIR = f"""{_VEC}, n AS (SELECT label, count(*) AS n, pow(count(*), -1.0 / 7) AS h FROM v GROUP BY 1),
p AS (SELECT a.label, a.vec_id, b.vec_id AS other, h, n, {", ".join(f"(a.x{k} - b.x{k}) / h AS u{k}" for k in _AXES)}, exp(-({" + ".join(f"pow((a.x{k} - b.x{k}) / h, 2)" for k in _AXES)}) / 2) AS w FROM v a JOIN v b USING (label) JOIN n USING (label)),
d AS (SELECT label, vec_id, any_value(h) AS h, ln(sum(w) / any_value(n)) - 1.5 * ln(2 * pi() * any_value(h) * any_value(h)) AS lp, {", ".join(f"sum(w * u{k}) / sum(w) AS m{k}" for k in _AXES)}, {", ".join(f"sum(w * u{i} * u{j}) / sum(w) AS s{i}{j}" for i, j in _UPPER)},
  {", ".join(f"sum(w * u{k}) FILTER (other <> vec_id) / sum(w) FILTER (other <> vec_id) / any_value(h) AS c{k}" for k in _AXES)} FROM p GROUP BY 1, 2),
f AS (SELECT p.label, p.vec_id, {", ".join(f"sum(w * c{i} * c{j}) / sum(w) AS f{i}{j}" for i, j in _UPPER)} FROM p JOIN d o ON o.label = p.label AND o.vec_id = p.other GROUP BY 1, 2)"""

ORACLES = {
    "kline_files": f"WITH {B1H} SELECT symbol, bar_ms, " + ", ".join(f"{r(c)} AS {c}" for c in (*klines.PRICES, "taker_buy")) + ", trades FROM b",
    "ohlcv_folder": f"WITH {B4H} SELECT symbol, bar_ms, " + ", ".join(f"{r(c)} AS {c}" for c in klines.PRICES) + " FROM b",
    "funding_files": f"WITH {FUNDING} SELECT symbol, bar_ms, {r('funding', 9)} AS funding FROM funding",
    "layer_files": f"WITH {DAILY} SELECT symbol, bar_ms, {r('close')} AS close, {r('volume')} AS volume FROM daily",
    "json_report": series_queries.ORACLES["integrity_report"],
    "file_checksums": "WITH f AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS path, o_orderkey || '|' || o_orderpriority AS x FROM orders) SELECT path, sha256(x) AS actual, CASE WHEN k % 11 <> 0 THEN sha256(CASE WHEN k % 7 = 0 THEN x || '!' ELSE x END) END AS expected, k % 11 <> 0 AND k % 7 <> 0 AS ok FROM f",
    "density_exact": f"WITH {_PAIR} SELECT d.label, d.vec_id, {r('h')} AS h, {r('lp')} AS log_density, "
    + ", ".join(f"{r(f'm{k} / h', 5)} AS gradient_{k - 1}" for k in _AXES)
    + ", "
    + ", ".join(f"{r(f'({int(i == j)} - (s{i}{j} - m{i} * m{j})) / (h * h)', 5)} AS hessian_{n}" for n, (i, j) in enumerate(_UPPER))
    + ", "
    + ", ".join(f"{r(f'c{k}', 5)} AS score_{k - 1}" for k in _AXES)
    + ", "
    + ", ".join(f"{r(f'f{i}{j}', 5)} AS fisher_{n}" for n, (i, j) in enumerate(_UPPER))
    + " FROM d JOIN f USING (label, vec_id)",
    "sphere_curvature": f"WITH {_VEC}, s AS (SELECT v.*, dim, radius, radius * radius + x1 * x1 + x2 * x2 + CASE dim WHEN 3 THEN x3 * x3 ELSE 0 END AS q FROM v, (VALUES "
    + ", ".join(f"({d}, {x}::DOUBLE)" for d, x in _SPHERES)
    + f") t(dim, radius)) SELECT vec_id, dim, radius, {r('dim * (dim - 1) / (radius * radius)', 3)} AS R, 0.0::DOUBLE AS R_error, {r('(2 - dim) * (dim - 1) / (2 * radius * radius)', 3)} AS einstein_share, 0.0::DOUBLE AS gamma_error, {r('4 * pow(radius, 4) / (q * q)')} AS g_11 FROM s",
    "stress_tensor": f"WITH {_VEC}, t AS (SELECT *, x1 * x1 + x2 * x2 + x3 * x3 + 0.75 * (x4 * x4 + x5 * x5 + x6 * x6) AS tr FROM v), u AS (SELECT vec_id, "
    + ", ".join(f"x{i} * x{j} + 0.75 * x{i + 3} * x{j + 3}" + (" + 0.25 * x7 - 0.5 * tr" if i == j else "") + f" AS t_{i}{j}" for i, j in _UPPER)
    + " FROM t) SELECT vec_id, "
    + ", ".join(f"{r(f't_{i}{j}')} AS t_{i}{j}" for i, j in _UPPER)
    + ", "
    + r("sqrt(" + " + ".join(f"{1 if i == j else 2} * t_{i}{j} * t_{i}{j}" for i, j in _UPPER) + ")")
    + " AS norm FROM u",
    "trilinear_lookup": f"WITH {_VEC}, p AS (SELECT vec_id, greatest(-0.2, least(0.2, x1)) AS x, greatest(-0.1, least(0.3, x2)) AS y, greatest(-0.3, least(0.1, x3)) AS z FROM v) SELECT vec_id, {r('1 + 2 * x - 3 * y + 4 * z + 5 * x * y - 6 * y * z + 7 * x * y * z')} AS value FROM p",
    "periodogram": f"WITH {DAILY}, x AS (SELECT symbol, tanh(ln(close) - ln(open)) AS r, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM daily) SELECT symbol, k, {r('(pow(sum(r * cos(2 * pi() * k * i / n)), 2) + pow(sum(r * sin(2 * pi() * k * i / n)), 2)) / any_value(n)', 8)} AS power FROM x, range(8) t(k) GROUP BY symbol, k",
    "reproduction_check": f"WITH y AS ({backtest_queries.ORACLES['yearly_gate']}) " + " UNION ALL ".join(f"SELECT symbol, year, '{m}' AS metric, {m} AS value, {v}::DOUBLE AS published, coalesce(abs({m} - {v}) <= {t}, false) AS ok FROM y" for m, v, t in (("ret_annual", 0.222, 0.010), ("sharpe", 1.53, 0.10), ("max_dd", 0.175, 0.010))),
    "pivot_table": f"WITH {B1H}, h AS (SELECT hour(epoch_ms(bar_ms))::BIGINT AS hour, isodow(epoch_ms(bar_ms)) - 1 AS d, volume FROM b) SELECT hour, " + ", ".join(f"{r(f'avg(volume) FILTER (d = {k})')} AS weekday_{k}" for k in range(7)) + " FROM h GROUP BY 1",
}
