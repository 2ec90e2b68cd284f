"""Statistics over whole series and the scalings made from them.

They look at all bars, past and future alike (labels and profiles need that);
the causal versions are in ``series``. Layers of short series take a symbol's
few numbers as aggregates over its window, so that their chains stay one plan.
``long`` series have their quantiles selected exactly without a symbol in one
task: equal values are counted together, dealt by buckets that keep their
order, and ranks found from the buckets' sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflume.functions.scalar import clip
from quantflume.functions.series import KEY
from quantflume.session import written


def over_all(value: Column, key: str = KEY) -> Column:
    """An aggregate over all bars of the symbol, at every bar."""
    return value.over(Window.partitionBy(key))


#: Buckets of equal width between a column's ends, and to a doubling of the distance from the nearer end.
WIDE, FINE = 1024, 16


def selected(df: DataFrame, columns: dict[str, tuple[str, float]], key: str = KEY) -> DataFrame:
    """Per ``key`` each name -> (column, q): the linear-interpolated quantile of the values that aren't null, all of them at once.

    Values go to buckets by their place between the column's ends, and inside
    those by the logarithm of the distance from the nearer end, so that neither
    narrow nor heavy-tailed columns gather in a bucket; a task holds a bucket's
    different values. Symbols without a value have nulls.
    """
    names = sorted({c for c, _ in columns.values()})
    long = df.select(F.col(key).alias("qf_key"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in names])).alias("e"))
    values = long.select("qf_key", "e.c", "e.x").where("x is not null").groupBy("qf_key", "c", "x").agg(F.count(F.lit(1)).alias("n"))
    ends = values.groupBy("qf_key", "c").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("size"))
    same = F.col("qf_key").eqNullSafe(F.col("qf_of")) & (F.col("c") == F.col("of"))
    rename = lambda t: t.withColumnRenamed("qf_key", "qf_of").withColumnRenamed("c", "of")
    values = values.join(rename(ends), same).drop("qf_of", "of")
    share = F.when(F.col("high") > F.col("low"), (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    values = values.withColumn("wide", F.least(F.floor(share * WIDE), F.lit(WIDE - 1)).cast("long"))
    near = lambda d: F.floor(F.log2(F.greatest(d, F.lit(1e-300))) * FINE)
    fine = F.when(share < 0.5, near(share)).otherwise(-near(1 - share)).cast("long")
    values = values.withColumn("fine", fine)
    bucket = ("qf_key", "c", "wide", "fine")
    sums = values.groupBy(*bucket).agg(F.sum("n").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("qf_key", "c").orderBy("wide", "fine").rowsBetween(Window.unboundedPreceding, -1))
    sums = rename(sums.withColumn("before", F.coalesce(before, F.lit(0)))).withColumnRenamed("wide", "of_wide").withColumnRenamed("fine", "of_fine").drop("rows")
    values = values.join(sums, same & (F.col("wide") == F.col("of_wide")) & (F.col("fine") == F.col("of_fine")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*bucket).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    values = values.select("qf_key", "c", "x", "size", "n", upto.alias("upto"))
    out = []
    for k, (c, q) in enumerate(columns.values()):
        at = F.lit(float(q)) * (F.col("size") - 1)
        held = lambda rank, c=c: F.max(F.when((F.col("c") == c) & (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("x")))
        out += [held(F.floor(at)).alias(f"low_{k}"), held(F.ceil(at)).alias(f"high_{k}"), F.max(F.when(F.col("c") == c, at - F.floor(at))).alias(f"part_{k}")]
    found = values.groupBy("qf_key").agg(*out)
    between = [(F.col(f"low_{k}") + F.col(f"part_{k}") * (F.col(f"high_{k}") - F.col(f"low_{k}"))).alias(name) for k, name in enumerate(columns)]
    return found.select(F.col("qf_key").alias(key), *between)


def quantiles(df: DataFrame, columns: dict[str, tuple[str, float]], key: str = KEY, long: bool = False) -> DataFrame:
    """``df`` with each name -> (column, q): the linear-interpolated quantile over the symbol's bars.

    A symbol's bars meet in one task, unless it is ``long``: then its quantiles
    are ``selected``, which writes the table once and reads it twice.
    """
    if not long:
        return df.select("*", *[over_all(F.percentile(c, F.lit(q)), key).alias(name) for name, (c, q) in columns.items()])
    df = written(df)
    found = selected(df, columns, key).withColumnRenamed(key, "qf_selected")
    return df.join(found, F.col(key).eqNullSafe(F.col("qf_selected")), "left").drop("qf_selected")


def robust_z(df: DataFrame, columns: dict[str, str], key: str = KEY, long: bool = False) -> DataFrame:
    """``df`` with each name -> column: (x - median) / scale; scale is 1.4826 MAD, or the population deviation if that is 0, or 1."""
    df = quantiles(df, {f"_m_{n}": (c, 0.5) for n, c in columns.items()}, key, long)
    df = df.select("*", *[F.abs(F.col(c) - F.col(f"_m_{n}")).alias(f"_a_{n}") for n, c in columns.items()])
    df = quantiles(df, {f"_d_{n}": (f"_a_{n}", 0.5) for n in columns}, key, long)
    df = df.select("*", *[over_all(F.stddev_pop(c), key).alias(f"_s_{n}") for n, c in columns.items()])
    for n, c in columns.items():
        scale = F.when(F.col(f"_d_{n}") > 0, 1.4826 * F.col(f"_d_{n}")).otherwise(F.col(f"_s_{n}"))
        scale = F.when(scale.isNull() | (scale < 1e-9), 1.0).otherwise(scale)
        df = df.withColumn(n, (F.col(c) - F.col(f"_m_{n}")) / scale)
    return df.drop(*[f"_{k}_{n}" for k in "mads" for n in columns])


def robust_z_plain(df: DataFrame, columns: dict[str, str], key: str = KEY, long: bool = False) -> DataFrame:
    """As ``robust_z`` by 0.6745 (x - median) / MAD, and 0 where the MAD is under 1e-12."""
    df = quantiles(df, {f"_m_{n}": (c, 0.5) for n, c in columns.items()}, key, long)
    df = df.select("*", *[F.abs(F.col(c) - F.col(f"_m_{n}")).alias(f"_a_{n}") for n, c in columns.items()])
    df = quantiles(df, {f"_d_{n}": (f"_a_{n}", 0.5) for n in columns}, key, long)
    for n, c in columns.items():
        d = F.col(f"_d_{n}")
        df = df.withColumn(n, F.when(d.isNull() | (d < 1e-12), 0.0).otherwise(0.6745 * (F.col(c) - F.col(f"_m_{n}")) / F.when(d >= 1e-12, d)))
    return df.drop(*[f"_{k}_{n}" for k in "mad" for n in columns])


def winsorized(df: DataFrame, columns: dict[str, str], low: float = 0.005, high: float = 0.995, key: str = KEY, long: bool = False) -> DataFrame:
    """``df`` with each name -> column held within its quantiles."""
    out = quantiles(df, {f"_l_{n}": (c, low) for n, c in columns.items()} | {f"_h_{n}": (c, high) for n, c in columns.items()}, key, long)
    for n, c in columns.items():
        out = out.withColumn(n, clip(F.col(c), F.col(f"_l_{n}"), F.col(f"_h_{n}")))
    return out.drop(*[f"_{k}_{n}" for k in "lh" for n in columns])


def minmax(df: DataFrame, columns: dict[str, str], key: str = KEY, long: bool = False) -> DataFrame:
    """``df`` with each name -> column scaled from its 5 % to its 95 % quantile into [0, 1]; 0 where they are equal."""
    out = quantiles(df, {f"_l_{n}": (c, 0.05) for n, c in columns.items()} | {f"_h_{n}": (c, 0.95) for n, c in columns.items()}, key, long)
    for n, c in columns.items():
        span = F.col(f"_h_{n}") - F.col(f"_l_{n}")
        out = out.withColumn(n, F.when(span.isNull() | (F.abs(span) < 1e-9), 0.0).otherwise(clip((F.col(c) - F.col(f"_l_{n}")) / F.when(F.abs(span) >= 1e-9, span), 0.0, 1.0)))
    return out.drop(*[f"_{k}_{n}" for k in "lh" for n in columns])


def summary(df: DataFrame, column: str, key: str = KEY) -> DataFrame:
    """Count, mean, median, population deviation and quantiles per symbol."""
    q = lambda p: F.percentile(column, F.lit(p))
    return df.groupBy(key).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), q(0.5).alias("median"), F.stddev_pop(column).alias("std"), q(0.05).alias("p05"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.95).alias("p95"))
