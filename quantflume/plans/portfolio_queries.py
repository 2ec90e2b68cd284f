"""The backtest of all three sleeves from fine bars, and its SQL from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflume.plans import chains
from quantflume.plans.backtest_queries import _BREAKER, _CARRY, _RET, _TRADES, _TREND_BODY
from quantflume.plans.oracle import DAILY, W, event_bars, r
from quantflume.plans.series_queries import _REGIME, _V, KEYS, rd, regime_sql
from quantflume.sources import bars


def _sleeves(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    fine = bars.event_bars(spark, sf_dir, 15 * bars.MINUTE).where("close > 0")
    return chains.three_sleeves(fine, bars.funding(spark, sf_dir))


def portfolio_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio of trend, burst and carry bar by bar, before and after its breaker."""
    return _sleeves(spark, sf_dir)["portfolio"].select(*KEYS, rd("ret", "ret", 8), "active", rd("ret_cb", "ret_cb", 8))


def portfolio_phase1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the portfolio comes to."""
    out = _sleeves(spark, sf_dir)["metrics"]
    return out.select("symbol", F.col("n_bars").cast("long").alias("n_bars"), *[rd(c, c) for c in ("ret_total", "ret_annual", "sharpe", "max_dd")])


QUERIES = {f.__name__: f for f in (portfolio_bars, portfolio_phase1)}


def _coarser(name: str, step: int) -> str:
    return f"{event_bars('e0', 900000)}, {name} AS (SELECT symbol, (bar_ms // {step}) * {step} AS bar_ms, first(open ORDER BY bar_ms) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ms) AS close, sum(volume) AS volume FROM e0 WHERE close > 0 GROUP BY ALL)"


PER_YEAR = 8760.0
# the pieces of the daily queries over hourly bars with the longer regime, and over bars of four hours
_HOURLY_TRADES = _TRADES.replace(DAILY, _coarser("daily", 3600000)).replace(_REGIME, regime_sql(2000))
_SLOW_TREND = f"{_coarser('slow', 4 * 3600000)}, d AS (SELECT *, {_V} AS v FROM slow), " + _TREND_BODY.replace("sqrt(365.0)", "sqrt(2190.0)")
_PORTFOLIO = f"""burst_ret AS (WITH RECURSIVE {_HOURLY_TRADES}, s AS (SELECT symbol, exit_ms, sum(net) AS net FROM trades GROUP BY ALL) SELECT d.symbol, d.bar_ms, coalesce(s.net, 0) AS net FROM daily d LEFT JOIN s ON s.symbol = d.symbol AND s.exit_ms = d.bar_ms),
trend_ret AS (WITH {_SLOW_TREND} SELECT symbol, bar_ms, net FROM pnl),
carry_ret AS (WITH RECURSIVE {_CARRY} SELECT symbol, bar_ms, net FROM carry),
ret AS (SELECT symbol, bar_ms, sum(w) AS ret FROM (SELECT symbol, bar_ms, 0.5 * net AS w FROM trend_ret UNION ALL SELECT symbol, bar_ms, 0.3 * net FROM burst_ret UNION ALL SELECT symbol, bar_ms, 0.2 * net FROM carry_ret) GROUP BY 1, 2)"""
_HELD = _BREAKER.replace(_RET, _PORTFOLIO)

ORACLES = {
    "portfolio_bars": f"WITH RECURSIVE {_HELD} SELECT br.symbol, br.bar_ms, {r('ret', 8)} AS ret, was AS active, {r('out', 8)} AS ret_cb FROM br JOIN ret USING (symbol, bar_ms)",
    "portfolio_phase1": f"WITH RECURSIVE {_HELD}, eq0 AS (SELECT *, product(1 + out) OVER {W} AS e FROM br), eq1 AS (SELECT *, 1 - e / max(e) OVER {W} AS dd FROM eq0) SELECT symbol, count(*) AS n_bars, {r('last(e ORDER BY bar_ms) - 1')} AS ret_total, {r(f'pow(last(e ORDER BY bar_ms), 1 / (count(*) / {PER_YEAR})) - 1')} AS ret_annual, {r(f'avg(out) / stddev_samp(out) * sqrt({PER_YEAR})')} AS sharpe, {r('max(dd)')} AS max_dd FROM eq1 GROUP BY symbol",
}
