"""Helpers shared by the text operators: checkpoints, batches and components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.session import scratch_dir

#: Bytes of text handled at once inside a Python worker.
BLOCK_CHARS = 800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a temporary one only where none is named and the master is local."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def partitions_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Shuffle partitions of about ``bytes_each`` by the optimizer's estimate of ``df``; ``spark.sql.shuffle.partitions`` at least, and where nothing is known."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, -(-size // bytes_each))


def blocks(sizes: Iterable[int], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Half-open row ranges whose summed sizes stay near ``limit`` (one row at least)."""
    start = total = i = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if total or i >= start:
        yield start, i + 1


def text_blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        for a, b in blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
            yield batch.slice(a, b - a), [t or "" for t in column.slice(a, b - a).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Remembered(dict):
    """Values of strings, learned when they are first asked for.

    Strings of over ``longest`` characters are learned anew each time, and all
    are forgotten once keys and values take ``limit`` bytes, about.
    """

    def __init__(self, learn: Callable[[str], bytes], limit: int, longest: int = 64):
        super().__init__({"": b""})
        self.learn, self.limit, self.longest, self.bytes = learn, limit, longest, 0

    def __missing__(self, key: str) -> bytes:
        got = self.learn(key)
        if len(key) <= self.longest:
            if self.bytes > self.limit:
                self.clear()
                self[""], self.bytes = b"", 0
            self[key] = got
            self.bytes += getsizeof(key) + getsizeof(got) + 100
        return got


class Groups:
    """Which of n local nodes are already connected; keeps as many links as connect them, not all there are."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def join(self, node: int, others: np.ndarray) -> np.ndarray:
        """Connects ``node`` with ``others``; returns the few of them that needed a link for it."""
        labels, first = np.unique(self.labels[others], return_index=True)
        own = self.labels[node]
        new = labels != own
        if new.any():
            self.labels[np.isin(self.labels, labels[new])] = own
        return others[first[new]]


def schema_with(df: DataFrame, **added: T.DataType) -> T.StructType:
    """The schema of ``df`` with more columns at its end; all may be null."""
    return T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema), *(T.StructField(k, v, True) for k, v in added.items())])


#: Edges from which on a round's aggregates are written before they are joined.
WRITE_EDGES = 1_000_000


def components(edges: DataFrame, max_rounds: int = 60, write_edges: int = WRITE_EDGES) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges``: long columns ``src`` and ``dst``; nulls and self loops are
    ignored. Returns ``node``, ``component`` (smallest node reachable) for every
    node that has an edge to another node. Each round's edges go to the shared
    checkpoint folder, so lineage stays short and a lost executor costs one
    round at most. Aggregates combine before the shuffle; from ``write_edges``
    edges on they are also written before the join, whose sides are two plain
    shuffles then, so that a hub's edges can be split over tasks. Only a count
    and a checksum reach the driver.
    """
    now = cut_lineage(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        plain = cut_lineage if before[0] >= write_edges else lambda df: df
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = plain(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = plain(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        m = plain(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(m, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut_lineage(small)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.union(now.select("v", "v"))  # by now each v is the least node of its component
    return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
