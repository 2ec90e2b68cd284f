"""DuckDB building blocks of the oracle SQL, written independently of the Spark plans."""

from __future__ import annotations


def event_bars(name: str, step: int, key: str = "'ALL'") -> str:
    """A CTE of bars of ``events``."""
    return f"""{name} AS (
  SELECT {key} AS symbol, (epoch_ms(ts) // {step}) * {step} AS bar_ms,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS trades,
         sum(CASE WHEN event_type IN ('click', 'purchase') THEN value ELSE 0 END) AS taker_buy
  FROM events GROUP BY ALL)"""


DAILY = """daily0 AS (
  SELECT l_returnflag AS symbol, epoch_ms(l_shipdate) AS bar_ms,
         sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY ALL),
daily AS (
  SELECT symbol, bar_ms, open, greatest(open, close) AS high, least(open, close) AS low, close, volume
  FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY bar_ms), close) AS open FROM daily0))"""

FUNDING = """funding AS (
  SELECT 'ALL' AS symbol, epoch_ms(o_orderdate) AS bar_ms,
         sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN -o_totalprice ELSE 0 END) / sum(o_totalprice) / 1000 AS funding
  FROM orders GROUP BY ALL)"""

W = "(PARTITION BY symbol ORDER BY bar_ms)"


def frame(first: int, last: int) -> str:
    """A window over rows relative to the current one."""
    side = lambda n: "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"(PARTITION BY symbol ORDER BY bar_ms ROWS BETWEEN {side(first)} AND {side(last)})"


def r(x: str, digits: int = 6) -> str:
    return f"round(({x})::DOUBLE, {digits}) + 0.0"


def ema_sql(source: str, x: str, name: str, alpha: float = 0.05) -> str:
    """A CTE with the exponential average as an explicit weighted sum over all earlier bars."""
    return f"""{name}_n AS (
  SELECT symbol, bar_ms, {x} AS x, row_number() OVER {W} AS n FROM {source} WHERE {x} IS NOT NULL),
{name} AS (
  SELECT a.symbol, a.bar_ms, sum(b.x * pow({1 - alpha!r}, a.n - b.n) * CASE WHEN b.n = 1 THEN 1 ELSE {alpha!r} END) AS ema
  FROM {name}_n a JOIN {name}_n b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY ALL)"""


def ewm_sql(source: str, x: str, name: str, span: int) -> str:
    """A CTE with the bias-corrected weighted deviation from explicit weights."""
    keep = 1 - 2 / (span + 1)
    return f"""{name}_n AS (
  SELECT symbol, bar_ms, {x} AS x, row_number() OVER {W} AS n FROM {source} WHERE {x} IS NOT NULL),
{name}_s AS (
  SELECT a.symbol, a.bar_ms, a.n, sum(pow({keep!r}, a.n - b.n)) AS s0, sum(pow({keep!r}, a.n - b.n) * b.x) AS s1, sum(pow({keep!r}, 2 * (a.n - b.n))) AS sq
  FROM {name}_n a JOIN {name}_n b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY ALL),
{name} AS (
  SELECT s.symbol, s.bar_ms, CASE WHEN any_value(s.n) >= {span} THEN
    sqrt(sum(pow({keep!r}, s.n - b.n) * (b.x - s.s1 / s.s0) * (b.x - s.s1 / s.s0)) / any_value(s.s0) * any_value(s.s0) * any_value(s.s0) / (any_value(s.s0) * any_value(s.s0) - any_value(s.sq))) END AS std
  FROM {name}_s s JOIN {name}_n b ON s.symbol = b.symbol AND b.n <= s.n GROUP BY s.symbol, s.bar_ms)"""
