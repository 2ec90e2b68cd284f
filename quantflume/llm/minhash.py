"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.llm.common import BLOCK_CHARS, partitions_for, schema_with, text_blocks
from quantflume.llm.hashing import U, Words, mix

#: Words in a shingle; a shorter text is one shingle.
WORDS = 5
#: Bins (a power of two); each keeps so many low-order bits of its least hash.
BINS, BITS = 256, 8

_EMPTY = U((1 << 64) - 1)
_Q = U(0xC2B2AE3D27D4EB4F)
#: Each bin's own order of bins to borrow from.
_ORDER = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64) + U(0x5851F42D4C957F2D)).reshape(BINS, BINS), axis=1)


def densify(bins: np.ndarray) -> np.ndarray:
    """Fills empty bins of each row: an empty bin follows its own random order of bins to one that wasn't empty at first."""
    empty, out = bins == _EMPTY, bins.copy()
    row, col = np.nonzero(empty & ~empty.all(axis=1, keepdims=True))
    for step in range(BINS):
        if not len(row):
            break
        donor = _ORDER[col, step]
        there = ~empty[row, donor]
        out[row[there], col[there]] = bins[row[there], donor[there]]
        row, col = row[~there], col[~there]
    return out


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints (texts, BINS) of the texts' word shingles in ASCII lower case, and which texts have words."""
    w = Words(texts, lower=True)
    n = len(texts)
    bins = np.full(n * BINS, _EMPTY, dtype=np.uint64)
    doc = np.repeat(np.arange(n), w.count)
    place = np.arange(len(w.hash)) - np.repeat(w.first, w.count)
    whole = place + WORDS <= np.repeat(w.count, w.count)
    h, owner = w.runs(WORDS)[whole], doc[whole]
    short = np.flatnonzero((w.count > 0) & (w.count < WORDS))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64)
        for k in range(WORDS - 1):
            more = w.count[short] > k
            own[more] = own[more] * _Q + w.hash[w.first[short[more]] + k]
        h, owner = np.concatenate([h, mix(own + U(1))]), np.concatenate([owner, short])
    shift = U(64 - BINS.bit_length() + 1)
    np.minimum.at(bins, owner * BINS + (h >> shift).astype(np.int64), h & ((U(1) << shift) - U(1)))
    packed = (densify(bins.reshape(n, BINS)) & U((1 << BITS) - 1)).astype(np.uint8)
    return packed, w.count > 0


def likeness(a: np.ndarray, b: np.ndarray, a_words: np.ndarray, b_words: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows: the share of equal bins, freed of chance agreement of BITS bits.

    Texts without words are like each other (1) and unlike all others (0).
    """
    chance = 0.5**BITS
    got = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_words & b_words, got, (a_words == b_words).astype(float))


def as_text(packed: np.ndarray, words: np.ndarray) -> list[str]:
    """Hex digits; empty for texts without words."""
    return [p.tobytes().hex() if w else "" for p, w in zip(packed, words, strict=True)]


def fingerprint_documents(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out_col``, the fingerprint of the whole text as hex digits (BINS * BITS / 4 of them).

    Null texts count as empty: an empty fingerprint. All rows and columns stay;
    a column named ``out_col`` is replaced; an empty table gives no rows.
    """
    docs = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(as_text(*fingerprints(texts)), pa.string())], [*rows.schema.names, out_col])

    return docs.mapInArrow(run, schema_with(docs, **{out_col: T.StringType()}))


def in_descending_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """Rows (run, extra, id, text), sorted within partitions, in which each row's successor in descending id order follows it.

    Ids are cut into ``runs`` ranges at their quantiles. A range's first row
    also goes, as ``extra``, behind the last row of the range before it, and
    the very first row behind the very last. So one shuffle of the texts by
    range gives every row its successor; to the driver go the quantiles and
    each range's first id. Ties of an id go by the text's hash; nulls come
    last. Ids must be integers (TypeError otherwise).
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, as its order is by number")
    n = partitions_for(docs)
    runs = runs or 4 * n
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    cuts = sorted(set(rows.approxQuantile("id", [k / runs for k in range(1, runs)], 0.2 / runs))) if runs > 1 else []
    if cuts:
        ranged = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep").transform(rows.withColumn("at", F.col("id").cast("double")))
        rows = ranged.withColumn("run", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.col("bucket").cast("int"))).drop("at", "bucket")
    else:
        rows = rows.withColumn("run", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.lit(0)))
    heads = rows.groupBy("run").agg(F.max(F.struct(F.col("id"), F.col("h"))).alias("head")).orderBy(F.desc("run")).collect()
    if not heads:
        return rows.select("run", F.lit(False).alias("extra"), "id", "text")
    # the head of each range follows the range of larger ids; the first head follows the last range
    target = [(heads[k].head.id, heads[k].head.h, heads[k - 1].run) for k in range(len(heads))]
    heads_df = F.broadcast(spark.createDataFrame(target, "head_id long, head_h long, target int"))  # a row for each range
    rows = rows.join(heads_df, F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")), "left")
    there = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("extra")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("run"), F.lit(True).alias("extra"))))
    rows = rows.select(F.explode(F.array_compact(there)).alias("at"), "id", "h", "text").select("at.run", "at.extra", "id", "h", "text")
    # neighbouring ranges share a partition, so that each has as many
    each = -(-(len(cuts) + 2) // n)
    return rows.repartitionById(n, ((F.col("run") + 1) / each).cast("int")).sortWithinPartitions("run", "extra", F.col("id").desc_nulls_last(), F.desc("h")).select("run", "extra", "id", "text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document's, in descending id order (after the
    last: the first). Returns ``id_col``, ``n_chars``, ``edited`` (text),
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Null texts count as empty. Null ids come last in the order and stay null;
    rows that repeat an id are ordered by a hash of their text and give a row
    each; a single document is its own next; an empty table gives no rows.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Blocks of (run, extra, id, text); each block begins with the last row of the one before."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((*row[:3], row[3] or ""))
                size += len(held[-1][3])
                if size > BLOCK_CHARS and len(held) > 1:
                    yield held
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in pairs(batches):
            at = [k for k in range(len(held) - 1) if not held[k][1] and held[k][0] == held[k + 1][0]]
            if not at:
                continue
            own, words = fingerprints([r[3] for r in held])
            edited = []
            for k in at:
                text, half = held[k][3], len(held[k][3]) // 2
                edited.append(text[: len(text) - half] + held[k + 1][3][:half])
            theirs, their_words = fingerprints(edited)
            k = np.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([held[j][2] for j in at], pa.int64()),
                    pa.array([len(held[j][3]) for j in at], pa.int64()),
                    pa.array(edited, pa.string()),
                    pa.array(as_text(own[k], words[k]), pa.string()),
                    pa.array(as_text(theirs, their_words), pa.string()),
                    pa.array(likeness(own[k], theirs, words[k], their_words)),
                    pa.array(likeness(own[k], own[k + 1], words[k], words[k + 1])),
                ],
                ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    out = in_descending_runs(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
