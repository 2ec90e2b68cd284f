"""Small pieces of numpy training shared by the byte-level models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Adam:
    """Adam over a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        rate = self.rate * scale * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def held_out(id_col, of: int = 4, part: int = 2) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo ``of``, is ``part``. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == part, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, per_label: int, order, budget: int = 19_200) -> DataFrame:
    """About ``per_label`` rows of each label, ``budget`` rows in all at most: those with the smallest hashes.

    Labels are counted over all rows, by the different hashes (``order``, a
    long) that they have; each label then keeps rows whose hash lies under the
    threshold that leaves over twice ``per_label`` on average, and at most
    ``per_label`` of those. Every label is learned: with more than ``budget /
    per_label`` of them each has fewer rows. More than ``budget`` labels are an error.
    """
    counts = rows.groupBy(label).agg(F.approx_count_distinct(order, 0.05).alias("_count"))
    n = counts.limit(budget + 1).count()
    if not n:
        return rows.limit(0)
    if n > budget:
        raise ValueError(f"more than {budget} labels; a sample of {budget} rows cannot hold them")
    each = max(1, min(per_label, budget // n))
    shares = counts.select(F.col(label).alias("_label"), ((2.0 * each + 20) / F.greatest(F.lit(1), F.col("_count"))).alias("_share"))
    # a hash as a number from 0 to 1; the shares are a row for each label, ``budget`` at most
    at = (F.shiftrightunsigned(order, 11)).cast("double") / float(1 << 53)
    few = rows.withColumn("_at", at).join(F.broadcast(shares), F.col(label) == F.col("_label")).where("_at < _share")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_at"))
    return few.withColumn("_n", rank).where(F.col("_n") <= each).drop("_n", "_at", "_label", "_share")
