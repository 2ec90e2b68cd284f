"""Bars and stateful features over streams.

A bar leaves once the watermark has passed its end, so it never changes later.
Ticks that come after that are dropped; of duplicate ticks within the watermark
the first stays (a batch run keeps the last).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantflume.functions.series import KEY, TIME


def tumbling_bars(ticks: DataFrame, length: str = "15 minutes", late: str = "10 minutes", key: str = KEY, at: str = "ts", price: str = "price", size: str = "size", tick_id: str | None = None) -> DataFrame:
    """OHLCV bars of a stream (or table) of ticks with an event time ``at``."""
    ticks = ticks.withWatermark(at, late)
    if tick_id:
        ticks = ticks.dropDuplicatesWithinWatermark([tick_id])
    order = F.struct(at, *([tick_id] if tick_id else []))
    out = ticks.groupBy(F.col(key).alias(KEY), F.window(at, length).alias("_w")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(size).alias("volume"), F.count(F.lit(1)).alias("trades"))
    return out.select(KEY, F.unix_millis(F.col("_w.start").cast("timestamp")).alias(TIME), F.col("_w.start").cast("timestamp").alias("bar_start"), "open", "high", "low", "close", "volume", "trades")


def running_state(bars: DataFrame, alpha: float = 0.05, breaker: float = 0.10) -> DataFrame:
    """Each bar's close average, equity and whether a drawdown breaker lets it trade, from state kept per symbol.

    Bars of a symbol must come in order, as ``tumbling_bars`` emits them; bars
    of one micro-batch are ordered here, older ones than the last seen are
    dropped. The state of a symbol is six numbers.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ema, close, raw, peak, on = state.get if state.exists else (-1, 0.0, 0.0, 1.0, 1.0, True)
        rows = pd.concat(list(pdfs)).sort_values(TIME)
        out = []
        for at, c in zip(rows[TIME].tolist(), rows["close"].tolist(), strict=True):
            if at <= last:
                continue
            ret = c / close - 1 if close else 0.0
            ema = c if last < 0 else (1 - alpha) * ema + alpha * c
            raw *= 1 + ret
            traded = ret if on else 0.0
            peak = max(peak, raw)
            on = raw >= peak if not on else 1 - raw / peak < breaker
            last, close = at, c
            out.append((key[0], at, c, ema, raw, traded, on))
        state.update((last, ema, close, raw, peak, on))
        yield pd.DataFrame(out, columns=[KEY, TIME, "close", "ema", "equity_raw", "traded", "active"])

    return bars.groupBy(KEY).applyInPandasWithState(
        step,
        f"{KEY} string, {TIME} long, close double, ema double, equity_raw double, traded double, active boolean",
        "last long, ema double, close double, raw double, peak double, active boolean",
        "append",
        GroupStateTimeout.NoTimeout,
    )
