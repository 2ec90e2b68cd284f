"""Nearest-in-time joins of two series of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflume.functions import scans
from quantflume.functions.series import KEY, TIME, by_time


def default_tolerance(left: DataFrame) -> DataFrame:
    """Per symbol, in ms: twice the median step within half a minute and five minutes."""
    step = left.withColumn("_s", F.col(TIME) - F.lag(TIME).over(by_time()))
    return step.groupBy(KEY).agg(F.greatest(F.lit(30_000.0), F.least(F.lit(300_000.0), 2 * F.coalesce(F.median("_s"), F.lit(0.0)))).alias("_tol"))


def nearest(left: DataFrame, right: DataFrame, columns: list[str], tolerance_ms: int | str | None = None, prefer: str = "left") -> DataFrame:
    """``left`` with ``columns`` of the bar of ``right`` that is nearest in time; ties go to the earlier one.

    Both sides are united and ordered in blocks of time; each row of the left
    sees the last bar of the right before it and the first after it through
    running windows over its block and the ends of the blocks beside it (``scans``)
    so nothing is compared pair by pair. ``tolerance_ms``:
    farther bars don't count (None: any; "auto": ``default_tolerance``).
    ``prefer``: which side's value stays where both have a column ("right": the
    right's unless it is null). Left rows never multiply; the right's bars of
    one time must be unique.
    """
    payload = F.struct(TIME, *columns)
    a = left.select(KEY, TIME, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(KEY, TIME, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), payload.alias("_r"), F.lit(0).alias("_side"))
    both = scans.cut(a.unionByName(b))
    w = scans.inside("_side")
    right_at = F.when(F.col("_r").isNotNull(), F.col(TIME))
    ends = both.groupBy(KEY, scans.BLOCK).agg(F.min_by("_r", right_at).alias("_first"), F.max_by("_r", right_at).alias("_last"))
    ends = ends.select(KEY, scans.BLOCK, F.last("_last", ignorenulls=True).over(scans.earlier()).alias("_earlier"), F.first("_first", ignorenulls=True).over(scans.later()).alias("_later"))
    before = F.last("_r", ignorenulls=True).over(scans.up_to_now(w))
    after = F.first("_r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = scans.carry(both.select(KEY, TIME, scans.BLOCK, "_l", before.alias("_p"), after.alias("_f")).where(F.col("_l").isNotNull()), ends)
    both = both.withColumn("_p", F.coalesce("_p", "_earlier")).withColumn("_f", F.coalesce("_f", "_later"))
    gap_p, gap_f = F.col(TIME) - F.col(f"_p.{TIME}"), F.col(f"_f.{TIME}") - F.col(TIME)
    pick = F.when(gap_f.isNull() | (gap_p <= gap_f), F.col("_p")).otherwise(F.col("_f"))
    both = both.withColumn("_n", F.coalesce(pick, F.col("_f"), F.col("_p")))
    if tolerance_ms is not None:
        if tolerance_ms == "auto":
            both = both.join(default_tolerance(left), KEY)
            limit: Column = F.col("_tol")
        else:
            limit = F.lit(tolerance_ms)
        both = both.withColumn("_n", F.when(F.abs(F.col(f"_n.{TIME}") - F.col(TIME)) <= limit, F.col("_n")))
    out = []
    for c in left.columns:
        own = F.col(f"_l.{c}")
        out.append((F.coalesce(F.col(f"_n.{c}"), own) if c in columns and prefer == "right" else own).alias(c))
    out += [F.col(f"_n.{c}").alias(c) for c in columns if c not in left.columns]
    return both.select(*out, F.col(f"_n.{TIME}").alias("matched_ms"))


def aligned_by_tail(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the right counted from the end: last bar to last bar.

    Left bars that lie farther back than the right reaches take its oldest bar.
    """
    back = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TIME)))
    b = right.select(KEY, back.alias("_k"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    size = b.groupBy(KEY).agg(F.max("_k").alias("_size"))
    a = left.withColumn("_at", back).join(size, KEY, "left").withColumn("_k", F.least("_at", "_size"))
    out = a.join(b, [KEY, "_k"], "left")
    return out.select(*[F.coalesce(F.col(f"_b_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in left.columns], *[F.col(f"_b_{c}").alias(c) for c in columns if c not in left.columns])


def common_bars(left: DataFrame, right: DataFrame, skip: int = 0) -> DataFrame:
    """The bars of ``left`` that ``right`` has too, without the first ``skip`` of each symbol."""
    n = F.row_number().over(by_time())
    return left.withColumn("_n", n).where(F.col("_n") > skip).drop("_n").join(right.select(KEY, TIME).distinct(), [KEY, TIME], "left_semi")
