"""Exact duplicates through Patricia tries whose terminal nodes know their owners.

Texts are dealt to partitions by length and content hash. A partition inserts
the full bytes of each into a compressed radix trie; a terminal node is one
distinct text and keeps its owner, the row with the most code points and, of
those, the smallest id. Where a trie outgrows its memory its heaviest subtree
is spilled: the strings in it, and all that reach it later, leave the task as
rows and are dealt again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.llm.common import cut_lineage, fresh, partitions_for

#: Characters that don't count, and bytes that a task's trie may hold before it spills.
BLANKS, TRIE_BYTES = " \t\n\x0b\x0c\r", 192 << 20
#: A key with more than one in so many rows or bytes is dealt to SALTS tasks first; there are 2 * HOT_SHARE such keys at most.
HOT_SHARE, SALTS = 2000, 64
#: What a node costs beside its label, about.
NODE_BYTES = 300


class Node:
    """A node: the bytes on the arc to it, its kids by their first byte, and, if a string ends here, its value."""

    __slots__ = ("label", "kids", "value", "gone")

    def __init__(self, label: bytes):
        self.label, self.kids, self.value, self.gone = label, {}, None, False


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def merged(a: list, b: list) -> list:
    """Value of a text from two: [owner, rows, rows that are like the owner's, what goes with the text]; an owner is (-code points, id is None, id)."""
    if a[0] == b[0]:
        return [a[0], a[1] + b[1], a[2] + b[2], a[3]]
    first = a if a[0] < b[0] else b
    return [first[0], a[1] + b[1], first[2], a[3]]


class Trie:
    """A compressed radix trie over byte strings; ``limit``: bytes that it may hold."""

    def __init__(self, limit: int = TRIE_BYTES):
        self.root, self.limit, self.bytes = Node(b""), limit, 0

    def insert(self, key: bytes, value: list) -> bool:
        """Adds a string or merges its value; False if its subtree was spilled, and the string isn't here."""
        node, at, n = self.root, 0, len(key)
        while not node.gone and at < n:
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.bytes += n - at + NODE_BYTES
            elif not key.startswith(kid.label, at):
                # the arc splits where the string leaves it
                size = common(kid.label, key[at : at + len(kid.label)])
                stem = node.kids[key[at]] = Node(kid.label[:size])
                kid.label = kid.label[size:]
                stem.kids[kid.label[0]] = kid
                self.bytes += NODE_BYTES
                kid = stem
            at += len(kid.label)
            node = kid
        if node.gone:
            return False
        node.value = value if node.value is None else merged(node.value, value)
        return True

    def weight(self, top: Node) -> int:
        """Bytes of a subtree."""
        total, todo = 0, [top]
        while todo:
            node = todo.pop()
            total += len(node.label) + NODE_BYTES
            todo += node.kids.values()
        return total

    def terminals(self, top: Node | None = None, stem: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Strings and values of a subtree whose label follows ``stem``."""
        todo = [(top or self.root, stem)]
        while todo:
            node, before = todo.pop()
            here = before + node.label
            if node.value is not None:
                yield here, node.value
            todo += [(kid, here) for kid in node.kids.values()]

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """While the trie is over its limit, the strings of its heaviest subtree, which is closed from then on."""
        while self.bytes > self.limit:
            node, stem, total = self.root, b"", self.bytes
            while True:
                kids = [(self.weight(kid), kid) for kid in node.kids.values() if not kid.gone]
                if not kids:
                    break
                heavy, kid = max(kids, key=lambda x: x[0])
                stem, node = stem + node.label, kid
                if heavy * 2 <= total or not kid.kids:
                    break
            if node is self.root:
                return
            yield from self.terminals(node, stem)
            self.bytes -= self.weight(node) - NODE_BYTES - 1
            # no other arc starts with this byte, so one byte is enough to know the subtree by
            node.label = node.label[:1]
            node.kids, node.value, node.gone = {}, None, True


def _rows(found: Iterable[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes of rows, whose last field is a string of bytes or None."""
    part, size = [], 0
    for row in found:
        part.append(row)
        size += 150 + len(row[-1] or b"")
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES, hot_share: int = HOT_SHARE) -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row.

    Texts are equal if they are the same bytes without space and \\x09-\\x0D.
    Of equal texts the row with the most code points in the original text
    stays, then that of the smallest id (null ids come last).

    Tasks insert their own rows into a trie first, so that a shuffle carries
    each text once a task; keys with over one in ``hot_share`` rows or bytes
    are dealt to several tasks, whose tries meet in a second round. The owners
    are joined to the rows by length and SHA-256 of the text.

    Null texts are empty and equal all texts of blanks; rows that repeat the
    owner's id and code points are all of its group, and one of them is kept;
    an empty table gives no rows; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = F.translate("original", BLANKS, "")
    base = docs.select(F.col(id_col).alias("id"), text.alias("original"))
    base = base.select("id", F.length("original").cast("long").alias("n_chars"), body.alias("body"))
    base = base.select("id", "n_chars", F.octet_length("body").cast("long").alias("size"), F.xxhash64("body").alias("hash"), F.sha2("body", 256).alias("sha"), F.col("body").cast("binary").alias("body"))
    keys = cut_lineage(base.drop("body").withColumn("row", F.monotonically_increasing_id()))

    total = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    share = F.lit(hot_share)
    hot = keys.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"))
    # 2 * hot_share rows of three numbers at most, by the shares
    hot = cut_lineage(hot.where((F.col("n") > SALTS) & ((F.col("n") * share > total["n"]) | (F.col("n") * F.col("size") * share > total["bytes"]))).select("size", "hash", F.lit(True).alias("hot")))

    fields = [("size", T.LongType()), ("hash", T.LongType()), ("sha", T.StringType()), ("n_chars", T.LongType()), ("id", kind), ("rows", T.LongType()), ("ties", T.LongType()), ("again", T.BooleanType()), ("body", T.BinaryType())]
    columns = T.StructType([T.StructField(n, t) for n, t in fields])

    def own(final: bool):
        """A task's tries. A ``final`` one spills by subtree and leaves out the texts of owners that no other task has; others empty themselves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(trie_bytes)

            def row(key: bytes, value: list, spilled: bool) -> tuple:
                owner, rows, ties, (size, hashed, sha, shared) = value
                return size, hashed, sha, -owner[0], owner[2], rows, ties, spilled or shared, key if spilled or shared or not final else None

            def found() -> Iterator[tuple]:
                nonlocal trie
                for batch in batches:
                    for size, hashed, sha, n_chars, id_, rows, ties, shared, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        value = [(-n_chars, id_ is None, id_), rows, ties, (size, hashed, sha, shared)]
                        if not trie.insert(key, value):
                            yield row(key, value, True)
                        if trie.bytes > trie.limit:
                            if final:
                                yield from (row(k, v, True) for k, v in trie.spill())
                            else:
                                yield from (row(k, v, False) for k, v in trie.terminals())
                                trie = Trie(trie_bytes)
                yield from (row(k, v, False) for k, v in trie.terminals())

            first = next(batches, None)
            if first is not None:
                batches = chain([first], batches)
                yield from _rows(found(), pa.schema([(f.name, first.schema.field(f.name).type) for f in columns]))

        return run

    order = [n for n, _ in fields]
    one = F.lit(1).cast("long")
    ones = base.select(*order[:5], one.alias("rows"), one.alias("ties"), F.lit(False).alias("again"), "body")
    n = partitions_for(docs, 64 << 20)
    local = ones.mapInArrow(own(False), columns).drop("again").join(F.broadcast(hot), ["size", "hash"], "left").withColumn("again", F.coalesce("hot", F.lit(False)))
    dealt = local.repartition(n, "size", "hash", F.when(F.col("again"), F.pmod(F.spark_partition_id(), F.lit(SALTS))))
    owners = None
    for _ in range(32):
        # spilled texts, and those of hot keys once a salt, meet in the next round
        found = cut_lineage(dealt.select(*order).mapInArrow(own(True), columns))
        done = found.where(~F.col("again")).select("size", "sha", "n_chars", "id", "rows", "ties")
        owners = done if owners is None else owners.union(done)
        rest = found.where("again")
        if rest.isEmpty():
            break
        n *= 2
        dealt = rest.withColumn("again", F.lit(False)).repartition(n, "size", "hash")
    else:
        raise RuntimeError("tries kept spilling")

    owners = owners.select("size", "sha", F.col("n_chars").alias("most"), F.col("id").alias("keep_id"), F.col("rows").alias("group_size"), "ties")
    owners = cut_lineage(owners)
    out = keys.join(owners, ["size", "sha"])
    like = out["id"].eqNullSafe(out["keep_id"]) & (F.col("n_chars") == F.col("most"))
    ties = owners.where("ties > 1")
    if not ties.isEmpty():
        # of rows that repeat the owner the first stays
        first = cut_lineage(keys.join(ties, ["size", "sha"]).where(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))).groupBy("size", "sha").agg(F.min("row").alias("first")))
        out = keys.join(cut_lineage(owners.join(first, ["size", "sha"], "left")), ["size", "sha"])
        like = out["id"].eqNullSafe(out["keep_id"]) & (F.col("n_chars") == F.col("most")) & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce(like, F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, its owner; all columns stay. Rows that repeat the owner's id and text leave one."""
    owner, sha, rank = fresh(docs, "qf_owner", "qf_sha", "qf_rank")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("keep_id").alias(owner), F.col("text_sha256").alias(sha))
    out = docs.withColumn(sha, F.sha2(F.translate(text, BLANKS, ""), 256)).join(cut_lineage(kept), sha)
    out = out.where(F.col(id_col).eqNullSafe(F.col(owner)))
    first = F.row_number().over(Window.partitionBy(sha).orderBy(F.length(text).desc(), F.md5(text)))
    return out.withColumn(rank, first).where(F.col(rank) == 1).drop(owner, sha, rank)
