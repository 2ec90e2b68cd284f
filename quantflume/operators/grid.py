"""Two-dimensional cells: aggregation, nearest occupied cell and bilinear lookup."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.functions import series
from quantflume.functions.robust import over_all, quantiles
from quantflume.functions.scalar import clip, finite
from quantflume.functions.series import KEY
from quantflume.kernels import gridfield


def line(low: Column, high: Column, k: Column, size: int) -> Column:
    """The k-th of ``size`` equally spaced grid lines; the last is exactly ``high``."""
    return F.when(k == size - 1, high).otherwise(low + k * ((high - low) / (size - 1)))


def next_line(x: Column, low: Column, high: Column, size: int) -> Column:
    """Number of the first grid line at or above x, held within the grid. Arithmetic finds it, a look at its neighbours corrects rounding."""
    step = (high - low) / (size - 1)
    k = clip(F.ceil(F.try_divide(x - low, step)).cast("double"), 0.0, float(size - 1))
    k = F.coalesce(k, F.lit(0.0))
    k = F.when((k > 0) & (line(low, high, k - 1, size) >= x), k - 1).when((k < size - 1) & (line(low, high, k, size) < x), k + 1).otherwise(k)
    return k.cast("int")


def force_map(df: DataFrame, x: str = "E", y: str = "jerk", size: int = 40) -> DataFrame:
    """Mean movement by cell: per symbol a ``size`` x ``size`` grid over the range of both columns.

    Movements are the differences to the bar before; a bar belongs to the next
    grid line up in both directions. Means skip the first bar's missing move.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fx, fy = series.difference(x), series.difference(y)
    df = df.withColumn("_fx", fx).withColumn("_fy", fy).withColumn("_fm", F.sqrt(F.col("_fx") ** 2 + F.col("_fy") ** 2))
    df = df.select("*", *[over_all(f(c)).alias(n) for n, f, c in (("_x0", F.min, x), ("_x1", F.max, x), ("_y0", F.min, y), ("_y1", F.max, y))])
    df = df.withColumn("ix", next_line(F.col(x), F.col("_x0"), F.col("_x1"), size)).withColumn("iy", next_line(F.col(y), F.col("_y0"), F.col("_y1"), size))
    cells = df.groupBy(KEY, "ix", "iy", "_x0", "_x1", "_y0", "_y1").agg(F.count(F.lit(1)).alias("n"), F.avg("_fx").alias("force_x"), F.avg("_fy").alias("force_y"), F.avg("_fm").alias("force_magnitude"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return cells.select(KEY, "ix", "iy", line(F.col("_x0"), F.col("_x1"), F.col("ix"), size).alias("E"), line(F.col("_y0"), F.col("_y1"), F.col("iy"), size).alias("jerk"), "n", *map(zero, ("force_x", "force_y", "force_magnitude")))


def nearest_of(axis: Column, x: Column) -> Column:
    """The element of a short array nearest to x; ties go to the smaller."""
    best = F.array_min(F.transform(axis, lambda a: F.struct(F.abs(x - a).alias("d"), a.alias("v"))))
    return best["v"]


def nearest_cell(df: DataFrame, cells: DataFrame, values: list[str], x: str = "E", y: str = "jerk") -> DataFrame:
    """``df`` with the values of the cell on the nearest occupied lines of both axes (null if that cell itself is empty).

    A symbol's axes have as many elements as the grid has lines; they travel as
    arrays, so that the lookup is an equi-join.
    """
    axes = cells.groupBy(KEY).agg(F.collect_set("E").alias("_ax"), F.collect_set("jerk").alias("_ay"))
    df = df.join(axes, KEY).withColumn("_cx", nearest_of(F.col("_ax"), F.col(x))).withColumn("_cy", nearest_of(F.col("_ay"), F.col(y)))
    side = cells.select(KEY, F.col("E").alias("_cx"), F.col("jerk").alias("_cy"), *[F.col(v).alias(f"{v}_local") for v in values])
    return df.join(side, [KEY, "_cx", "_cy"], "left").drop("_ax", "_ay", "_cx", "_cy")


def alignment(df: DataFrame, cells: DataFrame, x: str = "E", y: str = "jerk", empty_is_one: bool = False) -> DataFrame:
    """``df`` with the local force, its dot product and cosine with the bar's own move, and confidence flags.

    Cosines of next to no movement are null. ``empty_is_one``: an empty cell
    counts as cosine 1 instead of null.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    df = df.withColumn("dE_real", F.coalesce(series.difference(x), F.lit(0.0))).withColumn("dJ_real", F.coalesce(series.difference(y), F.lit(0.0)))
    df = df.withColumn("real_move_mag", F.sqrt(F.col("dE_real") ** 2 + F.col("dJ_real") ** 2))
    df = nearest_cell(df, cells, ["force_x", "force_y", "force_magnitude"], x, y)
    dot = F.col("force_x_local") * F.col("dE_real") + F.col("force_y_local") * F.col("dJ_real")
    size = F.col("force_magnitude_local") * F.col("real_move_mag")
    cos = F.when(size > 1e-12, clip(dot / size, -1.0, 1.0))
    if empty_is_one:
        cos = F.when(F.col("force_magnitude_local").isNull(), 1.0).otherwise(cos)
    df = df.withColumn("force_dot_move", dot).withColumn("force_alignment_cos", cos)
    df = quantiles(df, {"_lo": ("force_magnitude_local", 0.01), "_hi": ("force_magnitude_local", 0.99)})
    inlier = F.coalesce((F.col("force_magnitude_local") >= F.col("_lo")) & (F.col("force_magnitude_local") <= F.col("_hi")), F.lit(False))
    df = df.withColumn("force_mag_inlier", inlier.cast("int"))
    df = df.withColumn("force_alignment_cos_live", F.when(inlier, F.coalesce("force_alignment_cos", F.lit(0.0))).otherwise(0.0))
    live = F.col("force_alignment_cos_live")
    flags = {"aligned_positive": live > 0, "aligned_strong": live > 0.25, "aligned_very_strong": live > 0.50, "anti_aligned": live < 0}
    valid = F.col("force_alignment_cos").isNotNull() & (F.col("real_move_mag") > 1e-12)
    return df.select("*", valid.cast("int").alias("force_alignment_valid"), (1 - F.col("force_mag_inlier")).alias("force_alignment_low_confidence"), *[c.cast("int").alias(n) for n, c in flags.items()]).drop("_lo", "_hi")


def alignment_summary(df: DataFrame) -> DataFrame:
    """Per symbol: rows, shares of the flags, and statistics of cosine, dot product, force and move."""
    shares = [F.avg(F.col(c).cast("double")).alias(f"share_{c}") for c in ("aligned_positive", "aligned_strong", "aligned_very_strong", "anti_aligned")]
    stats = []
    for name, c in (("cos", "force_alignment_cos_live"), ("dot", "force_dot_move"), ("force_mag", "force_magnitude_local"), ("move_mag", "real_move_mag")):
        stats += [F.count(c).alias(f"{name}_count"), F.avg(c).alias(f"{name}_mean"), F.median(c).alias(f"{name}_median"), F.stddev_pop(c).alias(f"{name}_std")]
        stats += [F.percentile(c, F.lit(p / 100)).alias(f"{name}_p{p:02d}") for p in (5, 25, 75, 95)]
    return df.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows_total"), *shares, *stats)


def bilinear(df: DataFrame, nodes: DataFrame, x: str, y: str, value: str, low: tuple[float, float], high: tuple[float, float], size: tuple[int, int]) -> DataFrame:
    """``df`` with ``value`` between the four nodes (``ix``, ``iy``) of a regular grid around (x, y); points outside are moved to the edge.

    The cell comes from arithmetic; the corners are one equi-join on the cell.
    """
    px, py = clip(F.col(x), low[0], high[0]), clip(F.col(y), low[1], high[1])
    sx, sy = (high[0] - low[0]) / (size[0] - 1), (high[1] - low[1]) / (size[1] - 1)
    ix = F.least(F.floor((px - low[0]) / sx).cast("int"), F.lit(size[0] - 2))
    iy = F.least(F.floor((py - low[1]) / sy).cast("int"), F.lit(size[1] - 2))
    df = df.withColumn("_ix", ix).withColumn("_iy", iy).withColumn("_wx", (px - low[0]) / sx - F.col("_ix")).withColumn("_wy", (py - low[1]) / sy - F.col("_iy"))
    # every node serves as a corner of up to four cells
    corner = F.explode(F.array(*[F.struct((F.col("ix") - a).alias("_ix"), (F.col("iy") - b).alias("_iy"), F.lit(f"{a}{b}").alias("k")) for a in (0, 1) for b in (0, 1)]))
    cells = nodes.select(corner.alias("c"), F.col(value).alias("_v")).select("c._ix", "c._iy", "c.k", "_v").groupBy("_ix", "_iy").agg(*[F.max(F.when(F.col("k") == k, F.col("_v"))).alias(f"_v{k}") for k in ("00", "01", "10", "11")])
    out = df.join(cells, ["_ix", "_iy"], "left")
    wx, wy = F.col("_wx"), F.col("_wy")
    z = (1 - wx) * (1 - wy) * F.col("_v00") + wx * (1 - wy) * F.col("_v10") + (1 - wx) * wy * F.col("_v01") + wx * wy * F.col("_v11")
    return out.withColumn(value, z).drop("_ix", "_iy", "_wx", "_wy", "_v00", "_v01", "_v10", "_v11")


def multilinear(df: DataFrame, columns: list[str], axes: list[np.ndarray], values: np.ndarray, out: str) -> DataFrame:
    """``df`` with ``out``: a grid's values at the points (columns), linear along every axis; points outside are moved to the edge.

    The grid goes to every task, so its size should be that of a lookup table. A null coordinate gives null.
    """
    kept = df.drop(out)

    def run(pdfs):
        for pdf in pdfs:
            p = pdf[columns].to_numpy(dtype=float)
            got = gridfield.interpolate(axes, values, np.nan_to_num(p))
            yield pdf.assign(**{out: np.where(np.isfinite(p).all(axis=1), got, np.nan)})

    schema = T.StructType([*kept.schema, T.StructField(out, T.DoubleType())])
    return kept.mapInPandas(run, schema).withColumn(out, finite(out))
