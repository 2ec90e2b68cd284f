"""Registered queries of the sleeves, portfolio rules and gates, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflume.operators import backtest as bt
from quantflume.plans.oracle import DAILY, FUNDING, W, ewm_sql, frame, r
from quantflume.plans.series_queries import _BURST, _REGIME, _V, KEYS, rd
from quantflume.sources import bars

#: The daily series are shorter than two thousand bars of regime.
CFG = bt.Config(burst=bt.Burst(regime_window=1000), trend=bt.Trend(bars_per_year=365.0))
PER_YEAR = 365.0
COST = CFG.costs.round_trip


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.daily_bars(spark, sf_dir)


def daily_ret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A return series: a fiftieth of each day's open-to-close log move, held by tanh, small enough to compound."""
    return daily(spark, sf_dir).select(*KEYS, (F.tanh(F.log("close") - F.log("open")) / 50).alias("ret"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.entries(daily(spark, sf_dir), CFG).where("candidate").select(*KEYS, rd("dir", "dir"))


def trades_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.trades(daily(spark, sf_dir), CFG)
    return out.select("symbol", "signal_ms", "entry_ms", "exit_ms", rd("dir", "dir"), "reason", rd("gross", "gross"), rd("net", "net"))


def trade_return_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily(spark, sf_dir)
    return bt.trade_returns(b, bt.trades(b, CFG)).select(*KEYS, rd("ret", "ret"))


def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.trade_metrics(bt.trades(daily(spark, sf_dir), CFG), COST)
    return out.select("symbol", "n", rd("win_rate", "win_rate"), rd("mean_net", "mean_net"), rd("edge_cost_ratio", "edge_cost_ratio", 4))


def trend_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.trend_signal(daily(spark, sf_dir), CFG).select(*KEYS, rd("pos", "pos"))


def trend_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.trend_returns(daily(spark, sf_dir), CFG)
    return out.select(*KEYS, *[rd(c, c, 8) for c in ("pos", "gross", "cost", "net")])


def carry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.carry_returns(bars.funding(spark, sf_dir), CFG).select(*KEYS, rd("annualized", "annualized"), "in_pos", "event")


def carry_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.carry_returns(bars.funding(spark, sf_dir), CFG).select(*KEYS, rd("net", "net", 9))


def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.equity(daily_ret(spark, sf_dir)).select(*KEYS, rd("equity", "equity"), rd("drawdown", "drawdown"))


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.circuit_breaker(daily_ret(spark, sf_dir), CFG.breaker).select(*KEYS, "active", rd("ret_cb", "ret_cb", 8))


def portfolio_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily(spark, sf_dir)
    out = bt.combine({"trend": bt.trend_returns(b, CFG).select(*KEYS, F.col("net").alias("ret")), "burst": bt.trade_returns(b, bt.trades(b, CFG))}, {"trend": 0.5, "burst": 0.3})
    return out.select(*KEYS, rd("ret", "ret", 8))


def yearly_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.yearly(daily_ret(spark, sf_dir), PER_YEAR, CFG)
    return out.select("symbol", "year", "n_bars", *[rd(c, c) for c in ("ret_total", "ret_annual", "sharpe", "max_dd")])


def quarter_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.quarter_share(daily_ret(spark, sf_dir)).select("symbol", rd("total", "total"), rd("max_share", "max_share"))


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily(spark, sf_dir)
    out = bt.gate_report(daily_ret(spark, sf_dir), PER_YEAR, bt.trades(b, CFG), CFG)
    return out.select("symbol", "n_bars", rd("sharpe", "sharpe"), rd("max_dd", "max_dd"), "years_passed", "ok_years", "ok_drawdown", "ok_quarter", "ok_edge", "passed")


def rolling_84d_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the 84-day compounded return over the days of each symbol, gaps filled with 0."""
    out = bt.rolling_compound(bt.daily_grid(daily_ret(spark, sf_dir)), 84).where("band is not null")
    q = lambda p: F.percentile("band", F.lit(p))
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("windows"), rd(q(0.05), "p05"), rd(q(0.5), "p50"), rd(q(0.95), "p95"))


def compound_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.compound_by(daily_ret(spark, sf_dir), bt.year().alias("year")).select("symbol", "year", rd("ret", "ret"))


QUERIES = {f.__name__: f for f in (entries, trades_nonoverlap, trade_return_series, trade_metrics, trend_signal, trend_pnl, carry_state, carry_pnl, equity_drawdown, circuit_breaker, portfolio_combine, yearly_gate, quarter_share, gate_report, rolling_84d_band, compound_by_year)}

_ENTRIES = f"""{_BURST}, {_REGIME},
en AS (SELECT b.*, coalesce(sign(b.close / nullif(lag(b.close, 8) OVER {W.replace('symbol', 'b.symbol').replace('bar_ms', 'b.bar_ms')}, 0) - 1), 0) AS dir, rg2.vol_regime
  FROM burst b JOIN regime rg2 USING (symbol, bar_ms)),
num AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM en),
cand AS (SELECT c.symbol, c.bar_ms, c.dir, c.i + 1 AS i_in, c.n FROM num c WHERE c.vol_regime AND c.dir <> 0 AND c.t2_start AND c.i + 6 < c.n)"""

_TRADES = f"""{_ENTRIES},
stops AS (SELECT c.symbol, c.i_in, min(k.i) + 1 AS i_out FROM cand c JOIN num e ON e.symbol = c.symbol AND e.i = c.i_in
  JOIN num k ON k.symbol = c.symbol AND k.i BETWEEN c.i_in AND c.i_in + 3 WHERE c.dir * (k.close / e.open - 1) <= -0.012 GROUP BY 1, 2),
poss AS (SELECT c.*, coalesce(s.i_out, c.i_in + 4) AS i_out, CASE WHEN s.i_out IS NULL THEN 'TIME' ELSE 'STOP' END AS reason
  FROM cand c LEFT JOIN stops s USING (symbol, i_in)),
pick AS (
  SELECT symbol, min(i_in) AS i_in FROM poss GROUP BY symbol
  UNION ALL
  SELECT p.symbol, (SELECT min(q.i_in) FROM poss q WHERE q.symbol = p.symbol AND q.i_in > x.i_out) FROM pick p JOIN poss x USING (symbol, i_in) WHERE p.i_in IS NOT NULL),
trades AS (SELECT p.symbol, p.bar_ms AS signal_ms, e.bar_ms AS entry_ms, o.bar_ms AS exit_ms, p.dir, p.reason,
    p.dir * (o.open / e.open - 1) AS gross, p.dir * (o.open / e.open - 1) - {COST!r} AS net
  FROM pick k JOIN poss p USING (symbol, i_in) JOIN num e ON e.symbol = p.symbol AND e.i = p.i_in JOIN num o ON o.symbol = p.symbol AND o.i = p.i_out)"""

_TREND_BODY = f"""{ewm_sql("d", "v", "tv", 90)},
tr AS (SELECT d.*, tv.std * sqrt(365.0) AS vol, close / nullif(lag(close, 180) OVER {W.replace('symbol', 'd.symbol').replace('bar_ms', 'd.bar_ms')}, 0) - 1 AS mom,
  CASE WHEN count(close) OVER {frame(-119, 0).replace('symbol', 'd.symbol').replace('bar_ms', 'd.bar_ms')} >= 120 THEN avg(close) OVER {frame(-119, 0).replace('symbol', 'd.symbol').replace('bar_ms', 'd.bar_ms')} END AS ma
  FROM d LEFT JOIN tv USING (symbol, bar_ms)),
sig AS (SELECT symbol, bar_ms, open, coalesce(CASE WHEN mom > 0 AND close > ma THEN 1.0 ELSE 0.0 END * CASE WHEN vol = 0 THEN 1 ELSE least(0.2 / vol, 1) END, 0) AS pos FROM tr),
pnl0 AS (SELECT symbol, bar_ms, pos, pos * (lead(open, 2) OVER {W} / nullif(lead(open, 1) OVER {W}, 0) - 1) AS gross, coalesce(abs(pos - lag(pos) OVER {W}), abs(pos)) * {COST / 2!r} AS cost FROM sig),
pnl AS (SELECT *, gross - cost AS net FROM pnl0 WHERE gross IS NOT NULL)"""
_TREND = f"{DAILY}, d AS (SELECT *, {_V} AS v FROM daily), {_TREND_BODY}"

_CARRY = f"""{FUNDING}, f AS (SELECT *, funding * {365 * 24 / 8!r} AS ann, row_number() OVER {W} AS n FROM funding WHERE funding IS NOT NULL),
st AS (
  SELECT symbol, bar_ms, n, ann, funding, (ann > 0.05) AS pos, (ann > 0.05) AS entered, false AS left_ FROM f WHERE n = 1
  UNION ALL
  SELECT f.symbol, f.bar_ms, f.n, f.ann, f.funding,
    CASE WHEN s.pos THEN NOT (f.ann <= 0) ELSE f.ann > 0.05 END, NOT s.pos AND f.ann > 0.05, s.pos AND f.ann <= 0
  FROM st s JOIN f ON f.symbol = s.symbol AND f.n = s.n + 1),
carry AS (SELECT *, CASE WHEN entered THEN 'ENTER' WHEN left_ THEN 'EXIT' ELSE '' END AS event,
  CASE WHEN entered OR left_ THEN -{COST!r} ELSE 0 END + CASE WHEN pos AND NOT entered THEN funding ELSE 0 END AS net FROM st)"""

_RET = f"{DAILY}, ret AS (SELECT symbol, bar_ms, tanh(ln(close) - ln(open)) / 50 AS ret FROM daily)"
_EQ = f"{_RET}, eq0 AS (SELECT *, product(1 + ret) OVER {W} AS equity FROM ret), eq AS (SELECT *, 1 - equity / max(equity) OVER {W} AS drawdown FROM eq0)"


def _metrics(by: str, source: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY bar_ms)"
    return f"""mq AS (SELECT *, product(1 + ret) OVER {w} AS e FROM {source}), mp AS (SELECT *, 1 - e / max(e) OVER {w} AS dd FROM mq),
met AS (SELECT {by}, count(*) AS n_bars, last(e ORDER BY bar_ms) - 1 AS ret_total, pow(last(e ORDER BY bar_ms), 1 / (count(*) / {PER_YEAR})) - 1 AS ret_annual,
  avg(ret) / stddev_samp(ret) * sqrt({PER_YEAR}) AS sharpe, max(dd) AS max_dd FROM mp GROUP BY {by})"""


_YEAR = "year(make_timestamp(bar_ms * 1000))"
_QUARTERS = f"""qs AS (SELECT symbol, {_YEAR} AS y, quarter(make_timestamp(bar_ms * 1000)) AS q, sum(ret) AS s FROM ret GROUP BY ALL),
qshare AS (SELECT symbol, sum(s) AS total, CASE WHEN sum(s) > 0 THEN max(s) / sum(s) ELSE 1 END AS max_share FROM qs GROUP BY symbol)"""

# the breaker bar by bar, as a state machine
_BREAKER = f"""{_RET}, bn AS (SELECT *, row_number() OVER {W} AS n, product(1 + ret) OVER {W} AS raw FROM ret),
bp AS (SELECT *, greatest(1.0, max(raw) OVER {W}) AS rp FROM bn),
br AS (
  SELECT symbol, bar_ms, n, 1.0::DOUBLE * (1 + ret) AS eq, greatest(1.0, 1 + ret)::DOUBLE AS peak, true AS was, NOT (1 - (1 + ret) / greatest(1.0, 1 + ret) >= 0.1) AS on_, ret AS out FROM bp WHERE n = 1
  UNION ALL
  SELECT b.symbol, b.bar_ms, b.n, CASE WHEN x.on_ THEN x.eq * (1 + b.ret) ELSE x.eq END,
    CASE WHEN x.on_ THEN greatest(x.peak, x.eq * (1 + b.ret)) WHEN b.raw >= b.rp THEN x.eq ELSE x.peak END, x.on_,
    CASE WHEN x.on_ THEN NOT (1 - x.eq * (1 + b.ret) / greatest(x.peak, x.eq * (1 + b.ret)) >= 0.1) ELSE b.raw >= b.rp END,
    CASE WHEN x.on_ THEN b.ret ELSE 0 END
  FROM br x JOIN bp b ON b.symbol = x.symbol AND b.n = x.n + 1)"""

ORACLES = {
    "entries": f"WITH {_ENTRIES} SELECT symbol, bar_ms, dir + 0.0 AS dir FROM num WHERE vol_regime AND dir <> 0 AND t2_start",
    "trades_nonoverlap": f"WITH RECURSIVE {_TRADES} SELECT symbol, signal_ms, entry_ms, exit_ms, dir + 0.0 AS dir, reason, {r('gross')} AS gross, {r('net')} AS net FROM trades",
    "trade_return_series": f"WITH RECURSIVE {_TRADES}, s AS (SELECT symbol, exit_ms, sum(net) AS net FROM trades GROUP BY ALL) SELECT d.symbol, d.bar_ms, {r('coalesce(net, 0)')} AS ret FROM daily d LEFT JOIN s ON s.symbol = d.symbol AND s.exit_ms = d.bar_ms",
    "trade_metrics": f"WITH RECURSIVE {_TRADES} SELECT symbol, count(*) AS n, {r('avg((net > 0)::INTEGER)')} AS win_rate, {r('avg(net)')} AS mean_net, {r(f'avg(gross) / {COST!r}', 4)} AS edge_cost_ratio FROM trades GROUP BY symbol",
    "trend_signal": f"WITH {_TREND} SELECT symbol, bar_ms, {r('pos')} AS pos FROM sig",
    "trend_pnl": f"WITH {_TREND} SELECT symbol, bar_ms, {r('pos', 8)} AS pos, {r('gross', 8)} AS gross, {r('cost', 8)} AS cost, {r('net', 8)} AS net FROM pnl",
    "carry_state": f"WITH RECURSIVE {_CARRY} SELECT symbol, bar_ms, {r('ann')} AS annualized, pos AS in_pos, event FROM carry",
    "carry_pnl": f"WITH RECURSIVE {_CARRY} SELECT symbol, bar_ms, {r('net', 9)} AS net FROM carry",
    "equity_drawdown": f"WITH {_EQ} SELECT symbol, bar_ms, {r('equity')} AS equity, {r('drawdown')} AS drawdown FROM eq",
    "circuit_breaker": f"WITH RECURSIVE {_BREAKER} SELECT symbol, bar_ms, was AS active, {r('out', 8)} AS ret_cb FROM br",
    "portfolio_combine": f"WITH RECURSIVE {_TRADES}, {_TREND_BODY}, s AS (SELECT symbol, exit_ms, sum(net) AS net FROM trades GROUP BY ALL), u AS (SELECT symbol, bar_ms, 0.5 * net AS w FROM pnl UNION ALL SELECT d.symbol, d.bar_ms, 0.3 * coalesce(s.net, 0) FROM daily d LEFT JOIN s ON s.symbol = d.symbol AND s.exit_ms = d.bar_ms) SELECT symbol, bar_ms, {r('sum(w)', 8)} AS ret FROM u GROUP BY ALL",
    "yearly_gate": f"WITH {_RET}, y AS (SELECT *, {_YEAR} AS year FROM ret), {_metrics('symbol, year', 'y')} SELECT symbol, year, n_bars, {r('ret_total')} AS ret_total, {r('ret_annual')} AS ret_annual, {r('sharpe')} AS sharpe, {r('max_dd')} AS max_dd FROM met WHERE n_bars > 50",
    "quarter_share": f"WITH {_RET}, {_QUARTERS} SELECT symbol, {r('total')} AS total, {r('max_share')} AS max_share FROM qshare",
    "gate_report": f"WITH RECURSIVE {_TRADES}, ret AS (SELECT symbol, bar_ms, tanh(ln(close) - ln(open)) / 50 AS ret FROM daily), {_QUARTERS}, y AS (SELECT *, {_YEAR} AS year FROM ret), {_metrics('symbol, year', 'y').replace('mq AS', 'yq AS').replace('FROM mq', 'FROM yq').replace('mp AS', 'yp AS').replace('FROM mp', 'FROM yp').replace('met AS', 'ymet AS')}, {_metrics('symbol', 'ret')}, yy AS (SELECT symbol, count(*) AS years, count(*) FILTER (sharpe >= 0.8) AS years_passed FROM ymet WHERE n_bars > 50 GROUP BY symbol), tm AS (SELECT symbol, avg(gross) / {COST!r} AS edge FROM trades GROUP BY symbol), g AS (SELECT met.symbol, n_bars, sharpe, max_dd, years_passed, years_passed >= least(4, years) AS ok_years, max_dd <= 0.2 AS ok_drawdown, total <= 0 OR max_share <= 0.6 AS ok_quarter, coalesce(edge, 0) >= 3 AS ok_edge FROM met JOIN qshare USING (symbol) LEFT JOIN yy USING (symbol) LEFT JOIN tm USING (symbol)) SELECT symbol, n_bars, {r('sharpe')} AS sharpe, {r('max_dd')} AS max_dd, years_passed, ok_years, ok_drawdown, ok_quarter, ok_edge, ok_years AND ok_drawdown AND ok_quarter AND ok_edge AS passed FROM g",
    "rolling_84d_band": f"WITH {_RET}, span AS (SELECT symbol, min(bar_ms) AS a, max(bar_ms) AS b FROM ret GROUP BY 1), grid AS (SELECT symbol, unnest(generate_series(a, b, 86400000)) AS bar_ms FROM span), g AS (SELECT symbol, bar_ms, coalesce(ret, 0) AS ret FROM grid LEFT JOIN ret USING (symbol, bar_ms)), w AS (SELECT symbol, CASE WHEN count(*) OVER {frame(-83, 0)} >= 84 THEN product(1 + ret) OVER {frame(-83, 0)} - 1 END AS band FROM g) SELECT symbol, count(band) AS windows, {r('quantile_cont(band, 0.05)')} AS p05, {r('quantile_cont(band, 0.5)')} AS p50, {r('quantile_cont(band, 0.95)')} AS p95 FROM w GROUP BY symbol",
    "compound_by_year": f"WITH {_RET} SELECT symbol, {_YEAR} AS year, {r('product(1 + ret) - 1')} AS ret FROM ret GROUP BY ALL",
}
