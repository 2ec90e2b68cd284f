"""Prefix scans of series that are too long for one task.

A series is cut into blocks of time. Each block folds to one small state (rows,
product, peak, last value, decayed sums); the states of a symbol, a row a
block, are scanned in order; and a second pass applies to each block what came
before it. No task holds more of a symbol than a block, or a row for each.
Rows of one time lie in one block, those without a time in the last.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflume.session import written

KEY, TIME = "symbol", "bar_ms"
#: Milliseconds of a block: some 25 days, 36,000 minute bars.
BLOCK_MS = 1 << 31
BLOCK = "qf_block"


def earlier():
    """A window over a symbol's states before a block's own."""
    return Window.partitionBy(KEY).orderBy(F.asc_nulls_last(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)


def later():
    """A window over a symbol's states after a block's own."""
    return Window.partitionBy(KEY).orderBy(F.asc_nulls_last(BLOCK)).rowsBetween(1, Window.unboundedFollowing)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its blocks, written, as both passes read it."""
    return written(df.withColumn(BLOCK, F.floor(F.col(TIME) / BLOCK_MS).cast("long")))


def inside(*order: str | Column):
    """A window over a block's rows in order of time."""
    return Window.partitionBy(KEY, BLOCK).orderBy(F.asc_nulls_last(TIME), *order)


def up_to_now(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def carry(df: DataFrame, states: DataFrame, *by: str) -> DataFrame:
    """``df`` with the columns that ``states`` has beside the symbol and block (and ``by``)."""
    on, keys = F.lit(True), (KEY, BLOCK, *by)
    for k in keys:
        states = states.withColumnRenamed(k, f"qf_of_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"qf_of_{k}"))
    return df.join(states, on).drop(*[f"qf_of_{k}" for k in keys])


def numbered(df: DataFrame, name: str, *ties: str) -> DataFrame:
    """``df`` with ``name``, the number of a symbol's row from 0 in order of time and ``ties``."""
    df = cut(df)
    sizes = df.groupBy(KEY, BLOCK).agg(F.count(F.lit(1)).alias("qf_rows"))
    before = sizes.select(KEY, BLOCK, F.coalesce(F.sum("qf_rows").over(earlier()), F.lit(0)).alias("qf_before"))
    out = carry(df.withColumn(name, F.row_number().over(inside(*ties)) - 1), before)
    return out.withColumn(name, (F.col(name) + F.col("qf_before")).cast("long")).drop(BLOCK, "qf_before")


def compounded(df: DataFrame, ret: str) -> DataFrame:
    """``df``, cut, with ``qf_raw``, the product of 1 + return so far (null: 1), and ``qf_peak``, the highest of it."""
    df = cut(df)
    grown = F.product(1 + F.coalesce(F.col(ret), F.lit(0.0)))
    local = df.withColumn("qf_raw", grown.over(up_to_now(inside()))).withColumn("qf_peak", F.max("qf_raw").over(up_to_now(inside())))
    states = local.groupBy(KEY, BLOCK).agg(F.max("qf_peak").alias("qf_top"), grown.alias("qf_all"))
    states = states.withColumn("qf_start", F.coalesce(F.product("qf_all").over(earlier()), F.lit(1.0)))
    states = states.withColumn("qf_high", F.max(F.col("qf_start") * F.col("qf_top")).over(earlier()))
    out = carry(local, states.select(KEY, BLOCK, "qf_start", "qf_high"))
    out = out.withColumn("qf_raw", F.col("qf_raw") * F.col("qf_start"))
    return out.withColumn("qf_peak", F.greatest("qf_high", F.col("qf_peak") * F.col("qf_start"))).drop("qf_start", "qf_high")


def last_before(df: DataFrame, said: Column, name: str) -> DataFrame:
    """``df``, cut already, with ``name``: the last of ``said`` that isn't null at any earlier row of the symbol."""
    local = df.withColumn("qf_said", said)
    states = local.groupBy(KEY, BLOCK).agg(F.max_by("qf_said", F.when(F.col("qf_said").isNotNull(), F.col(TIME))).alias("qf_last"))
    states = states.select(KEY, BLOCK, F.last("qf_last", ignorenulls=True).over(earlier()).alias("qf_carried"))
    here = F.last("qf_said", ignorenulls=True).over(inside().rowsBetween(Window.unboundedPreceding, -1))
    return carry(local.withColumn(name, here), states).withColumn(name, F.coalesce(name, "qf_carried")).drop("qf_said", "qf_carried")


def changes(df: DataFrame, state: str) -> DataFrame:
    """Per symbol: its rows, and how often ``state`` differs from that of the row before (nulls differ from nothing)."""
    df = cut(df.select(KEY, TIME, F.col(state).alias("qf_state")))
    moved = (F.col("qf_state") != F.lag("qf_state").over(inside())).cast("long")
    ends = F.struct("qf_state")  # a struct, so that a null state is a state
    states = df.withColumn("qf_moved", moved).groupBy(KEY, BLOCK).agg(F.count(F.lit(1)).alias("qf_rows"), F.sum("qf_moved").alias("qf_inner"), F.min_by(ends, TIME).alias("qf_first"), F.max_by(ends, TIME).alias("qf_last"))
    between = (F.col("qf_first.qf_state") != F.lag("qf_last").over(Window.partitionBy(KEY).orderBy(F.asc_nulls_last(BLOCK)))["qf_state"]).cast("long")
    states = states.withColumn("qf_between", between)
    return states.groupBy(KEY).agg(F.sum("qf_rows").alias("rows"), (F.coalesce(F.sum("qf_inner"), F.lit(0)) + F.coalesce(F.sum("qf_between"), F.lit(0))).alias("changes"))


def first_values(df: DataFrame, x: str) -> DataFrame:
    """``df`` with ``qf_first`` and ``qf_since``: a symbol's first value of ``x`` that isn't null, and its time."""
    seen = df.where(F.col(x).isNotNull()).groupBy(F.col(KEY).alias("qf_key")).agg(F.min_by(x, TIME).alias("qf_first"), F.min(TIME).alias("qf_since"))
    return df.join(seen, F.col(KEY).eqNullSafe(F.col("qf_key")), "left").drop("qf_key")


def decayed(df: DataFrame, keep: float, sums: list[str], counts: list[str] = ()) -> DataFrame:
    """``df``, cut already, whose columns ``sums`` become sums over all rows so far of keep ** age * value, and ``counts`` plain running sums.

    Ages count rows; nulls weigh nothing. Blocks are cut again so that the
    powers of ``keep`` inside one stay in range; what a block starts with is
    the sum of the ends of those before it, as far back as they count.
    """
    size = max(8, int(300 / -log(keep)))
    n = F.row_number().over(inside()) - 1
    local = df.withColumn("qf_at", n).withColumn("qf_part", F.floor(F.col("qf_at") / size).cast("long")).withColumn("qf_at", (F.col("qf_at") % size).cast("double"))
    here = up_to_now(Window.partitionBy(KEY, BLOCK, "qf_part").orderBy("qf_at"))
    power = lambda k: F.pow(F.lit(keep), k)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    local = local.select(*[c for c in local.columns if c not in (*sums, *counts)], *[(F.sum(zero(c) * power(-F.col("qf_at"))).over(here) * power(F.col("qf_at"))).alias(c) for c in sums], *[F.sum(zero(c)).over(here).alias(c) for c in counts])
    states = local.groupBy(KEY, BLOCK, "qf_part").agg(F.count(F.lit(1)).alias("qf_rows"), *[F.max_by(c, "qf_at").alias(c) for c in (*sums, *counts)])
    order = Window.partitionBy(KEY).orderBy(F.asc_nulls_last(BLOCK), "qf_part")
    states = states.withColumn("qf_end", F.sum("qf_rows").over(up_to_now(order)))
    near = Window.partitionBy(KEY).orderBy("qf_end").rangeBetween(-2 * size, -1)
    states = states.withColumn("qf_ends", F.collect_list(F.struct("qf_end", *sums)).over(near)).withColumn("qf_start", F.col("qf_end") - F.col("qf_rows"))
    ends = lambda c: F.aggregate("qf_ends", F.lit(0.0), lambda s, e: s + e[c] * power(F.col("qf_start") - e["qf_end"]))
    carried = [ends(c).alias(f"qf_c_{c}") for c in sums]
    carried += [F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"qf_c_{c}") for c in counts]
    out = carry(local, states.select(KEY, BLOCK, "qf_part", *carried), "qf_part")
    for c in sums:
        out = out.withColumn(c, F.col(c) + power(F.col("qf_at") + 1) * F.col(f"qf_c_{c}"))
    for c in counts:
        out = out.withColumn(c, F.col(c) + F.col(f"qf_c_{c}"))
    return out.drop("qf_at", "qf_part", *[f"qf_c_{c}" for c in (*sums, *counts)])
