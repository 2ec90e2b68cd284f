"""Trading sleeves, portfolio rules and gates.

State machines are window expressions: a position with hysteresis is the last
decisive signal, a drawdown breaker what was last said of new highs and limits,
and the choice of trades that don't overlap a chain of successors, whose links
double their length in each round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflume.functions import scans, series
from quantflume.functions.scalar import ratio
from quantflume.functions.series import KEY, TIME, by_time, rows
from quantflume.session import written


@dataclass(frozen=True)
class Costs:
    """Per side; a round trip pays each twice."""

    fee: float = 0.00008
    slippage: float = 0.00005

    @property
    def round_trip(self) -> float:
        return 2 * (self.fee + self.slippage)


@dataclass(frozen=True)
class Burst:
    short: int = 12
    long: int = 96
    quantile: float = 0.90
    quantile_window: int = 500
    cluster: int = 3
    momentum: int = 8
    hold: int = 4
    stop: float = -0.012
    only_cluster: bool = True
    block_hours: tuple[int, ...] = ()
    regime_span: int = 96
    regime_window: int = 2000


@dataclass(frozen=True)
class Trend:
    lookback: int = 180
    average: int = 120
    vol_span: int = 90
    allow_short: bool = False
    target_vol: float = 0.20
    most: float = 1.0
    bars_per_year: float = series.BARS_PER_YEAR["4h"]


@dataclass(frozen=True)
class Carry:
    enter: float = 0.05
    leave: float = 0.0
    period_hours: int = 8


@dataclass(frozen=True)
class Gates:
    sharpe: float = 0.8
    years: int = 4
    edge_cost: float = 3.0
    drawdown: float = 0.20
    quarter_share: float = 0.60
    least_bars: int = 50


@dataclass(frozen=True)
class Config:
    costs: Costs = field(default_factory=Costs)
    burst: Burst = field(default_factory=Burst)
    trend: Trend = field(default_factory=Trend)
    carry: Carry = field(default_factory=Carry)
    gates: Gates = field(default_factory=Gates)
    breaker: float = 0.10


DEFAULT = Config()


def entries(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``bars`` with ``candidate`` (a burst in a volatile regime with a direction) and ``dir``."""
    c = cfg.burst
    df = series.burst_events(bars, c.short, c.long, c.quantile, c.quantile_window, c.cluster)
    df = series.volatility_regime(df, c.regime_span, c.regime_window)
    df = df.withColumn("dir", series.momentum_sign("close", c.momentum))
    ok = F.col("vol_regime") & (F.col("dir") != 0) & F.col("t2_start" if c.only_cluster else "event_start")
    if c.block_hours:
        ok = ok & ~F.hour(F.timestamp_millis(TIME)).isin(*c.block_hours)
    return df.withColumn("candidate", ok)


def exits(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Candidates with what a trade from each would do: fill at the next open, leave at the open after a stop, or after the hold."""
    c, w = cfg.burst, by_time()
    lead = lambda x, k: F.lead(x, k).over(w)
    entry = lead("open", 1)
    stops = [F.when(F.col("dir") * (lead("close", 1 + k) / entry - 1) <= c.stop, k + 1) for k in range(c.hold)]
    after = F.coalesce(*stops, F.lit(c.hold))
    stopped = F.coalesce(*stops).isNotNull()
    leave = F.coalesce(*[F.when(after == k, lead("open", 1 + k)) for k in range(1, c.hold + 1)])
    leave_at = F.coalesce(*[F.when(after == k, lead(TIME, 1 + k)) for k in range(1, c.hold + 1)])
    gross = F.col("dir") * (leave / entry - 1)
    df = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KEY)))
    df = df.select("*", lead(TIME, 1).alias("entry_ms"), leave_at.alias("exit_ms"), after.alias("_after"), F.when(stopped, "STOP").otherwise("TIME").alias("reason"), gross.alias("gross"))
    return df.where(F.col("candidate") & (F.col("_i") + 1 + c.hold + 1 < F.col("_n")))


def trades(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Trades one at a time: a candidate is skipped whose entry isn't after the exit of the last trade taken."""
    found = exits(entries(bars, cfg), cfg)
    cols = ["signal_ms", "entry_ms", "exit_ms", "dir", "reason", "gross", "net"]
    found = found.select(KEY, F.col(TIME).alias("signal_ms"), "entry_ms", "exit_ms", "dir", "reason", "gross", (F.col("gross") - cfg.costs.round_trip).alias("net"), (F.col("_i") + 1).cast("long").alias("_in"), (F.col("_i") + 1 + F.col("_after")).cast("long").alias("_out"))

    return taken(found).select(KEY, *cols)


def taken(found: DataFrame) -> DataFrame:
    """The candidates (``_in``, ``_out``: bars of entry and exit) that one trade at a time takes, without a pass over a symbol.

    A candidate's successor is the first whose entry lies after its exit. From
    a symbol's first candidate on, the chain of successors is what is taken:
    each round joins the taken ones to successors at twice the distance, so
    there are log2 of the longest chain of them. Candidates of a symbol enter
    at different bars.
    """
    at = written(found)
    # exits among entries in order; an exit sees the first entry behind it
    events = at.select(KEY, F.col("_in").alias("_at"), F.lit(1).alias("_kind"), F.col("_in").alias("_entry"), F.lit(None).cast("long").alias("_from"))
    events = events.unionByName(at.select(KEY, F.col("_out").alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast("long").alias("_entry"), F.col("_in").alias("_from")))
    behind = Window.partitionBy(KEY).orderBy("_at", "_kind").rowsBetween(1, Window.unboundedFollowing)
    jump = events.withColumn("_next", F.first("_entry", ignorenulls=True).over(behind)).where("_kind = 2 and _next is not null").select(KEY, "_from", "_next")
    on = written(at.groupBy(KEY).agg(F.min("_in").alias("_in")))
    jump = written(jump)
    while not jump.isEmpty():
        more = on.join(jump, (on[KEY] == jump[KEY]) & (on["_in"] == jump["_from"])).select(on[KEY], F.col("_next").alias("_in"))
        on = written(on.unionByName(more).distinct())
        far = jump.select(F.col(KEY).alias("_key"), F.col("_from").alias("_mid"), F.col("_next").alias("_far"))
        jump = written(jump.join(far, (F.col(KEY) == F.col("_key")) & (F.col("_next") == F.col("_mid"))).select(KEY, "_from", F.col("_far").alias("_next")))
    return at.join(on, [KEY, "_in"], "left_semi")


def trade_returns(bars: DataFrame, done: DataFrame) -> DataFrame:
    """Every bar's return: the net of the trades that leave at it, else 0."""
    sums = done.groupBy(KEY, F.col("exit_ms").alias(TIME)).agg(F.sum("net").alias("_net"))
    return bars.select(KEY, TIME).join(sums, [KEY, TIME], "left").select(KEY, TIME, F.coalesce("_net", F.lit(0.0)).alias("ret"))


def trend_signal(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``bars`` with ``pos``: in when momentum and average agree, sized to the target volatility."""
    t = cfg.trend
    mom, avg = series.pct_change("close", t.lookback), series.rolling("mean", "close", t.average)
    df = bars.withColumn("_mom", mom).withColumn("_avg", avg)
    df = series.annual_volatility(df, "_vol", t.vol_span, t.bars_per_year)
    raw = F.coalesce(((F.col("_mom") > 0) & (F.col("close") > F.col("_avg"))).cast("double"), F.lit(0.0))
    if t.allow_short:
        raw = raw - F.coalesce(((F.col("_mom") < 0) & (F.col("close") < F.col("_avg"))).cast("double"), F.lit(0.0))
    scale = F.when(F.col("_vol") == 0, t.most).otherwise(F.least(ratio(F.lit(t.target_vol), F.col("_vol")), F.lit(t.most)))
    scale = F.when(F.col("_vol").isNotNull(), scale)
    return df.withColumn("pos", F.coalesce(raw * scale, F.lit(0.0))).drop("_mom", "_avg", "_vol")


def trend_returns(bars: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Positions earn from the next open to the one after it; turnover pays half a round trip."""
    df, w = trend_signal(bars, cfg), by_time()
    gross = F.col("pos") * (ratio(F.lead("open", 2).over(w), F.lead("open", 1).over(w)) - 1)
    turnover = F.coalesce(F.abs(F.col("pos") - F.lag("pos").over(w)), F.abs("pos"))
    df = df.select(KEY, TIME, "pos", gross.alias("gross"), (turnover * (cfg.costs.round_trip / 2)).alias("cost"))
    return df.withColumn("net", F.col("gross") - F.col("cost")).where(F.col("net").isNotNull())


def carry_returns(funding: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """In from annual funding over ``enter`` until it is ``leave`` or less; the entering period pays its costs and earns nothing."""
    c = cfg.carry
    df = funding.where(F.col("funding").isNotNull()).withColumn("annualized", F.col("funding") * (365 * 24 / c.period_hours))
    said = F.when(F.col("annualized") > c.enter, 1).when(F.col("annualized") <= c.leave, 0)
    held = F.coalesce(F.last(said, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    df = df.withColumn("_in", held)
    before = F.coalesce(F.lag("_in").over(by_time()), F.lit(0))
    df = df.withColumn("event", F.when((F.col("_in") == 1) & (before == 0), "ENTER").when((F.col("_in") == 0) & (before == 1), "EXIT").otherwise(""))
    cost = F.when(F.col("event") != "", -cfg.costs.round_trip).otherwise(0.0)
    earned = F.when((F.col("_in") == 1) & (F.col("event") != "ENTER"), F.col("funding")).otherwise(0.0)
    return df.select(KEY, TIME, "funding", "annualized", (F.col("_in") == 1).alias("in_pos"), "event", (cost + earned).alias("net"))


def combine(sleeves: dict[str, DataFrame], weights: dict[str, float], ret: str = "ret") -> DataFrame:
    """Weighted sum of return series over the union of their bars; a sleeve without a bar adds 0."""
    parts = [df.select(KEY, TIME, (F.col(ret) * weights.get(name, 0.0)).alias("ret")) for name, df in sleeves.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(KEY, TIME).agg(F.sum("ret").alias("ret"))


def equity(df: DataFrame, ret: str = "ret") -> DataFrame:
    """``df`` with ``equity`` (compounded) and ``drawdown`` (from the highest equity so far), by a prefix scan."""
    df = scans.compounded(df, ret)
    df = df.withColumn("equity", F.col("qf_raw")).withColumn("drawdown", 1 - F.col("qf_raw") / F.col("qf_peak"))
    return df.drop("qf_raw", "qf_peak", scans.BLOCK)


def circuit_breaker(df: DataFrame, limit: float = 0.10, ret: str = "ret") -> DataFrame:
    """Returns with trading off after a drawdown of ``limit`` until the raw equity is at a new high.

    From one new high of the raw equity to the next the traded equity falls as
    the raw one does, so trading is off at a bar if the last bar before it that
    said anything reached the limit and wasn't a new high; the bar of the new
    high that ends an off time itself earns nothing. Two prefix scans, of the
    equity with its peak and of what was last said.
    """
    df = scans.compounded(df, ret)
    high = F.greatest(F.lit(1.0), F.col("qf_peak"))
    said = F.when(1 - F.col("qf_raw") / high >= limit, 1).when(F.col("qf_raw") >= high, 0)
    df = scans.last_before(df, said, "qf_off")
    off = F.coalesce(F.col("qf_off"), F.lit(0)) == 1
    df = df.withColumn("active", ~off).withColumn("ret_cb", F.when(off, 0.0).otherwise(F.coalesce(F.col(ret), F.lit(0.0))))
    return df.drop("qf_raw", "qf_peak", "qf_off", scans.BLOCK)


def metrics(df: DataFrame, bars_per_year: float, by: list[str] | None = None, ret: str = "ret") -> DataFrame:
    """Per group: bars, total and annual return, Sharpe ratio, deepest drawdown; zeros if nothing ever moves.

    Compounding and the running peak restart with the group.
    """
    by = by or [KEY]
    df = df.where(F.col(ret).isNotNull())
    past = Window.partitionBy(*by).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_eq", F.product(1 + F.col(ret)).over(past)).withColumn("_peak", F.max("_eq").over(past))
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bars"), F.max_by("_eq", TIME).alias("_end"), F.avg(ret).alias("_mu"), F.stddev_samp(ret).alias("_sd"), F.max(1 - F.col("_eq") / F.col("_peak")).alias("_dd"), F.sum(F.abs(F.col(ret))).alias("_moved"))
    alive = F.col("_moved") > 0
    years = F.col("n_bars") / bars_per_year
    sharpe = F.when(F.col("_sd") > 0, F.col("_mu") / F.col("_sd") * float(bars_per_year**0.5)).otherwise(0.0)
    zero = lambda x: F.when(alive, x).otherwise(0.0)
    return agg.select(*by, "n_bars", zero(F.col("_end") - 1).alias("ret_total"), zero(F.pow("_end", 1 / F.greatest(years, F.lit(1e-9))) - 1).alias("ret_annual"), zero(sharpe).alias("sharpe"), zero(F.col("_dd")).alias("max_dd"))


def trade_metrics(done: DataFrame, cost: float) -> DataFrame:
    """Per symbol: number, share of winners, mean net return, mean gross return over cost."""
    return done.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.avg("net").alias("mean_net"), (F.avg("gross") / cost).alias("edge_cost_ratio"))


def year(at: Column | str = TIME) -> Column:
    return F.year(F.timestamp_millis(F.col(at) if isinstance(at, str) else at)).cast("long")


def quarter(at: Column | str = TIME) -> Column:
    return F.quarter(F.timestamp_millis(F.col(at) if isinstance(at, str) else at)).cast("long")


def yearly(df: DataFrame, bars_per_year: float, cfg: Config = DEFAULT, ret: str = "ret") -> DataFrame:
    """``metrics`` of every year with more than ``least_bars`` bars."""
    out = metrics(df.withColumn("year", year()), bars_per_year, [KEY, "year"], ret)
    return out.where(F.col("n_bars") > cfg.gates.least_bars)


def quarter_share(df: DataFrame, ret: str = "ret") -> DataFrame:
    """Per symbol: the sum of returns, and the largest quarter's share of it (1 if the sum isn't positive)."""
    q = df.groupBy(KEY, year().alias("_y"), quarter().alias("_q")).agg(F.sum(ret).alias("_sum"))
    total = F.sum("_sum")
    return q.groupBy(KEY).agg(total.alias("total"), F.when(total > 0, F.max("_sum") / total).otherwise(1.0).alias("max_share"))


def gate_report(df: DataFrame, bars_per_year: float, done: DataFrame | None = None, cfg: Config = DEFAULT, ret: str = "ret") -> DataFrame:
    """Per symbol the gates' checks and the verdict, all of them together."""
    g = cfg.gates
    years = yearly(df, bars_per_year, cfg, ret).groupBy(KEY).agg(F.count(F.lit(1)).alias("_years"), F.sum((F.col("sharpe") >= g.sharpe).cast("long")).alias("years_passed"))
    out = metrics(df, bars_per_year, None, ret).join(years, KEY, "left").join(quarter_share(df, ret), KEY)
    out = out.withColumn("years_passed", F.coalesce("years_passed", F.lit(0)))
    checks = {
        "ok_years": F.col("years_passed") >= F.least(F.lit(g.years), F.coalesce("_years", F.lit(0))),
        "ok_drawdown": F.col("max_dd") <= g.drawdown,
        "ok_quarter": (F.col("total") <= 0) | (F.col("max_share") <= g.quarter_share),
    }
    if done is not None:
        out = out.join(trade_metrics(done, cfg.costs.round_trip).select(KEY, "edge_cost_ratio"), KEY, "left")
        checks["ok_edge"] = F.coalesce(F.col("edge_cost_ratio"), F.lit(0.0)) >= g.edge_cost
    verdict = F.lit(True)
    for c in checks.values():
        verdict = verdict & c
    return out.select(KEY, "n_bars", "sharpe", "max_dd", "years_passed", *[c.alias(k) for k, c in checks.items()], verdict.alias("passed"))


def compound_by(df: DataFrame, *by, ret: str = "ret") -> DataFrame:
    """The compounded return of every group of bars."""
    return df.groupBy(KEY, *by).agg((F.product(1 + F.col(ret)) - 1).alias("ret"))


def rolling_compound(df: DataFrame, size: int, ret: str = "ret") -> DataFrame:
    """``df`` with ``band``, the compounded return over the last ``size`` bars, once there are as many."""
    w = rows(1 - size, 0)
    return df.withColumn("band", F.when(F.count(ret).over(w) >= size, F.product(1 + F.col(ret)).over(w) - 1))


def daily_grid(df: DataFrame, ret: str = "ret") -> DataFrame:
    """One row for every day from the first bar to the last, compounded within the day, 0 where there is none."""
    day = 86_400_000
    days = df.groupBy(KEY, (F.floor(F.col(TIME) / day) * day).cast("long").alias(TIME)).agg((F.product(1 + F.col(ret)) - 1).alias("ret"))
    all_days = days.groupBy(KEY).agg(F.min(TIME).alias("_a"), F.max(TIME).alias("_b")).select(KEY, F.explode(F.sequence("_a", "_b", F.lit(day))).alias(TIME))
    return all_days.join(days, [KEY, TIME], "left").select(KEY, TIME, F.coalesce("ret", F.lit(0.0)).alias("ret"))
