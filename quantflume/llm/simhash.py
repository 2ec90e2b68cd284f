"""SimHash fingerprints and their exact near-duplicate groups by tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflume.llm.common import Groups, components, cut_lineage, fresh, text_blocks

#: Fingerprint bits are counted in lanes of so many; a tile holds fingerprints of equal lane counts.
LANE_BITS = 16
LANES = 64 // LANE_BITS
#: Fingerprints in a tile at most (about; tiles are dealt by hash).
TILE = 2048


def shingle_hashes(text: str, words_each: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the ASCII-lower-cased text, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= words_each:
        return np.frombuffer(digest(joined, seed), dtype=">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - words_each + 1
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words_each - 1 :].tolist(), strict=True)]), dtype=">u8").astype(np.uint64)


def simhash(text: str, words_each: int = 3, seed: int = 42) -> int:
    """64 bits; each is 1 if it is set in over half the shingles' hashes (no words: 0)."""
    h = shingle_hashes(text, words_each, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (long, the 64 bits as they are) of every whole text.

    Null and wordless texts have fingerprint zero; null ids stay null; repeated
    rows give a row each; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64))], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, fingerprint long")
    return out.withColumnRenamed("id", id_col)


def cell_of(fingerprint) -> F.Column:
    """The lanes' population counts as digits of base ``LANE_BITS + 1``."""
    cell = F.lit(0)
    for k in range(LANES):
        cell = cell * (LANE_BITS + 1) + F.bit_count(F.shiftrightunsigned(fingerprint, k * LANE_BITS).bitwiseAND(F.lit((1 << LANE_BITS) - 1).cast("long")))
    return cell.cast("int")


def steps(radius: int) -> list[tuple[int, ...]]:
    """Changes of the lanes' counts that ``radius`` flipped bits can make, one of each pair of opposites."""
    return [d for d in product(range(-radius, radius + 1), repeat=LANES) if sum(map(abs, d)) <= radius and d >= (0,) * LANES]


def partner_cells(cell, radius: int) -> F.Column:
    """Array of the cells, itself included, that a tile must be compared with; others differ by more than the radius."""
    digits = [F.floor(cell / (LANE_BITS + 1) ** (LANES - 1 - k)) % (LANE_BITS + 1) for k in range(LANES)]
    found = []
    for d in steps(radius):
        inside, change = F.lit(True), 0
        for k, x in enumerate(d):
            change = change * (LANE_BITS + 1) + x
            if x:
                inside = inside & (digits[k] + x).between(0, LANE_BITS)
        found.append(F.when(inside, (cell + change).cast("int")))
    return F.array_compact(F.array(*found))


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, block: int = 512) -> list[tuple[int, int]]:
    """Links between different fingerprints of two tiles within the radius, a spanning forest of all there are.

    Every pair is compared, a block of rows at a time; a row's matches are
    merged at once, so that memory doesn't grow with the links.
    """
    groups, n, out = Groups(len(a) + len(b)), len(a), []
    for k in range(0, n, block):
        near = np.bitwise_count(a[k : k + block, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            match = np.flatnonzero(near[i])
            x = a[k + i]
            if len(match) == 1 and b[match[0]] == x:
                continue  # itself, in a tile compared with itself
            out += [(int(x), int(b[j - n])) for j in groups.join(k + i, match + n).tolist() if b[j - n] != x]
    return out


def links(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (``a``, ``b``) between different fingerprints within ``radius`` bits: all that their groups need.

    ``prints``: distinct longs in ``fingerprint``. Fingerprints lie in tiles of
    equal lane counts, cut by hash to ``tile`` each. Tile pairs whose counts
    differ beyond the radius are skipped; the others are met by an equi-join on
    the partner's cell and cut and compared bit by bit, so that a common cell's
    tiles are as many keys. Of a tile pair's links a spanning forest is kept,
    which leaves the groups as they are.
    """
    sizes = prints.groupBy(cell_of(F.col("fingerprint")).alias("cell")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("cuts"))
    # (LANE_BITS + 1) ** LANES = 83,521 cells of 8 bytes at most, at any input size
    tiles = (
        prints.withColumn("cell", cell_of(F.col("fingerprint")))
        .join(F.broadcast(sizes), "cell")
        .withColumn("cut", F.pmod(F.xxhash64("fingerprint"), F.col("cuts")).cast("int"))
        .groupBy("cell", "cut")
        .agg(F.collect_list("fingerprint").alias("prints"))
    )
    tiles = cut_lineage(tiles)
    one = tiles.select(F.col("cell").alias("cell_a"), F.col("cut").alias("cut_a"), F.col("prints").alias("prints_a"), F.explode(partner_cells(F.col("cell"), radius)).alias("cell"))
    one = one.join(F.broadcast(sizes), "cell").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where("cell <> cell_a or cut >= cut_a")
    pairs = one.join(tiles, ["cell", "cut"]).select("prints_a", "prints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            for k in range(batch.num_rows):
                a = batch.column(0)[k].values.to_numpy().view(np.uint64)
                b = batch.column(1)[k].values.to_numpy().view(np.uint64)
                for x, y in tile_links(a, b, radius):
                    found_a.append(x)
                    found_b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(f, dtype=np.uint64).view(np.int64)) for f in (found_a, found_b)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, tile: int = TILE) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links.

    Fingerprints link at ``radius`` or fewer differing bits. Equal fingerprints
    are one class throughout, so a group of copies costs one comparison.

    Null and wordless texts have fingerprint zero and link like any other; a
    null id stays null and takes part in its group, whose ``component_id`` is
    its smallest id that isn't null (null if it has none); repeated rows give a
    row each; an empty table gives no rows; other columns aren't read.
    """
    prints = cut_lineage(fingerprint_documents(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("id").alias("least")))
    edges = links(classes.select("fingerprint"), radius, tile)
    linked = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # a class in no link is its own group; a group's id is the least of its classes'
    grouped = classes.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint")
    least = grouped.groupBy("component").agg(F.min("least").alias("group_least"))
    named = grouped.join(least, "component").select("fingerprint", "group_least")
    named = classes.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("group_least", "least").alias("component_id"))
    # written first, so that the join's sides are two plain shuffles and a hot fingerprint's partition can be split
    out = prints.join(cut_lineage(named), "fingerprint")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest id. All columns stay.

    Null ids come last: such a row stays only in a group without other ids.
    Rows are told apart by id and text, so different texts under one id, or
    without one, go by their own groups. Of rows with the kept id in a group
    the least MD5 of the text stays (null first), and one of those that repeat
    it. Empty tables stay empty; texts may be null (they are copies of each other).
    """
    key, mark, n = fresh(docs, "qf_key", "qf_mark", "qf_rows")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("")).alias("text")))
    found = near_duplicates(keyed.select(key, text_col), key, text_col, radius)
    keep = cut_lineage(found.where(F.col("component_id") == F.col(key)).groupBy(F.col(key).alias(mark)).agg(F.count(F.lit(1)).alias(n)))
    out = keyed.join(keep, F.col(key) == F.col(mark), "left_semi")
    return (out if keep.where(F.col(n) > 1).isEmpty() else out.dropDuplicates([key])).drop(key)
