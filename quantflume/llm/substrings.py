"""Removal of repeated passages: a compacted de Bruijn graph of word windows.

Nodes are runs of WINDOW - 1 words, and every window of WINDOW words is an edge
from the node of its first words to that of its last. An edge is repeated if
its words start at two places or more, and the words that repeated edges cover
are removed.

The graph is compacted before it is built. Each edge has an anchor, the k-mer
of least hash among its words, and consecutive edges of one anchor make a
piece: a path of up to WINDOW - k + 1 edges and more that is one row. Equal
edges have equal anchors, so an anchor's edges need no others:

* an anchor that occurs once has unique edges only, which settles most;
* an anchor with one distinct piece, at several places, has no node where walks
  part or meet: the path doesn't branch, and is repeated as a whole;
* an anchor with several distinct pieces, or with one that it occurs in several
  times, has such nodes. A join finds these pieces, and another takes each to
  its source, the first place (document and word) where it occurs. There its
  words are read again, compared with its hash, and cut at every node; the
  edges are counted, each with the number of places its piece stands for. The
  ones that occur once cut the repeated paths.

Pieces and edges are told apart by two hashes, one of them of the words as
they stand at the coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.llm.common import cut_lineage, fresh, partitions_for, schema_with, text_blocks
from quantflume.llm.hashing import U, Words, mix

#: Words of an edge, and of the k-mers among which it has its anchor.
WINDOW, ANCHOR = 35, 12


def sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over x[i : i + n] for each i, by doubling; shorter by n - 1."""
    out, size = x, 1
    while size * 2 <= n:
        out, size = pick(out[: len(out) - size], out[size:]), size * 2
    return pick(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if size < n else out


class Edges:
    """The edges of a block of texts: ``at`` (first words), ``hash`` and ``anchor`` (longs)."""

    def __init__(self, texts: list[str], window: int, anchor: int):
        self.words = w = Words(texts, lower=False)
        self.n, self.window, reach = len(w.hash), window, window - anchor + 1
        none = np.zeros(0, dtype=np.int64)
        self.at = self.hash = self.anchor = self.anchors = self.anchor_doc = none
        if self.n < window:
            return
        place = np.arange(self.n) - np.repeat(w.first, w.count)
        room = np.repeat(w.count, w.count) - place
        whole = (room >= window)[: self.n - window + 1]
        kmers = w.runs(anchor)[: self.n - anchor + 1]
        least = sliding(kmers, reach, np.minimum)
        self.at = np.flatnonzero(whole)
        self.hash = w.runs(window)[self.at].view(np.int64)
        self.anchor = least[self.at].view(np.int64)
        # a k-mer is an anchor if it is as small as the least of some edge over it
        known = np.where(whole, least, np.uint64(0))
        known = np.concatenate([np.zeros(reach - 1, np.uint64), known, np.zeros(reach - 1, np.uint64)])
        most = sliding(known, reach, np.maximum)
        place = np.flatnonzero((most == kmers) & (most > 0))
        self.anchors = kmers[place].view(np.int64)
        self.anchor_doc = np.searchsorted(w.first, place, side="right") - 1

    def pieces(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First edges, numbers of edges and hashes (longs) of the runs of ``asked`` edges that follow each other and share their anchor."""
        mine = np.flatnonzero(asked)
        if not len(mine):
            return mine, mine, mine
        new = np.ones(len(mine), dtype=bool)
        at, anchor = self.at[mine], self.anchor[mine]
        new[1:] = (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(mine)))
        return mine[start], size, self.piece_hashes(mine, start, size)

    def piece_hashes(self, edges: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each run of edges: of all its edges and their order."""
        order = np.arange(len(edges)) - np.repeat(start, size)
        return mix(np.add.reduceat(mix(self.hash[edges].view(np.uint64) ^ mix(order.astype(np.uint64) + U(1))), start)).view(np.int64)

    def checks(self, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """XXH3 (a long) of the words as they stand, joined by one space: of ``words`` words from ``first`` on."""
        if not len(first):
            return np.zeros(0, dtype=np.int64)
        w = self.words
        plain = b" ".join(w.raw.split())
        ends = np.cumsum(w.end - w.start + 1)
        a, b = (ends - (w.end - w.start + 1))[first].tolist(), (ends[first + words - 1] - 1).tolist()
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(plain[i:j]) for i, j in zip(a, b, strict=True)], dtype=np.uint64).view(np.int64)

    def covered(self, keep: np.ndarray) -> np.ndarray:
        """Which words lie under the edges that ``keep`` picks."""
        change = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(change, self.at[keep], 1)
        np.add.at(change, self.at[keep] + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def _lists(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """All numbers of a list column's rows, sorted."""
    column = rows.column(rows.schema.get_field_index(name)).drop_null()
    return np.unique(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` and ``kept``.

    Words are runs of characters other than space and \\x09-\\x0D, unchanged.
    ``spans``: the repeated passages as (start, end), in words, end exclusive:
    every word that some window of ``window`` words covers whose words also
    start anywhere else, in this document or another. ``kept``: the other words
    joined by one space. Windows are judged on the texts as given.

    One shuffle of the texts serves all passes over them (by a hash of the id
    and the text); what is shuffled besides are anchors, pieces of repeated
    anchors, edges of those that branch, and what is unique among these, all
    pre-aggregated. Documents get lists of hashes, not places, so that rows of
    one key do each other no harm.

    Null texts have no words; ids may be null, and of any type; repeated rows
    are documents of their own, which repeat each other; an empty table gives
    no rows. Columns named like the three new ones are replaced.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has from 1 to window words")
    docs = docs.drop("n_words", "spans", "kept")
    names = docs.columns
    key, anchors_col, edges_col, asked_col = fresh(docs, "qf_key", "qf_anchors", "qf_edges", "qf_asked")
    docs = docs.withColumn(key, F.xxhash64(F.lit(1), F.col(id_col).cast("string"), F.col(text_col).cast("string")))

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, "text"):
            e = Edges(texts, window, anchor)
            keys = rows.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(e.anchors), pa.array(keys[e.anchor_doc])], ["anchor", "key"])

    def find_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, "text"):
            e = Edges(texts, window, anchor)
            first, size, piece = e.pieces(_among(e.anchor, _lists(rows, "anchors")))
            at = e.at[first]
            doc = np.searchsorted(e.words.first, at, side="right") - 1
            keys = rows.column(0).to_numpy(zero_copy_only=False)[doc]
            cols = [piece, e.checks(at, size + window - 1), e.anchor[first], keys, at - e.words.first[doc], size]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["piece", "check", "anchor", "key", "word", "size"])

    def find_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, text_col):
            e = Edges(texts, window, anchor)
            asked = rows.column(len(names) + 1)
            doc = np.repeat(np.arange(rows.num_rows), np.diff(asked.offsets.to_numpy()))
            word, size, piece, places = (asked.flatten().field(f).to_numpy() for f in ("word", "size", "piece", "places"))
            # a document of the same key may lack such a piece at that place
            at = e.words.first[doc] + word
            ok = at + size + window - 1 <= (e.words.first + e.words.count)[doc]
            doc, at, size, piece, places = doc[ok], at[ok], size[ok], piece[ok], places[ok]
            edges = np.repeat(np.searchsorted(e.at, at) - np.cumsum(size) + size, size) + np.arange(size.sum())
            if len(edges):
                same = np.repeat(e.piece_hashes(edges, np.cumsum(size) - size, size) == piece, size)
                edges, doc, places = edges[same], np.repeat(doc, size)[same], np.repeat(places, size)[same]
            keys = rows.column(len(names)).to_numpy(zero_copy_only=False)[doc]
            cols = [e.hash[edges], e.checks(e.at[edges], np.full(len(edges), window)), places, keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["edge", "check", "places", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, text_col):
            e = Edges(texts, window, anchor)
            asked = _among(e.anchor, _lists(rows, anchors_col))
            gone = e.covered(asked & ~_among(e.hash, _lists(rows, edges_col)))
            spans, kept = [], []
            for first, count in zip(e.words.first.tolist(), e.words.count.tolist(), strict=True):
                own = gone[first : first + count]
                edge = np.flatnonzero(np.diff(own, prepend=False, append=False)) if own.any() else own[:0]
                spans.append([{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)])
                if not count:
                    kept.append("")
                    continue
                words = e.words.raw[e.words.start[first] : e.words.end[first + count - 1]].split()
                last, parts = 0, []
                for s in spans[-1]:
                    parts += words[last : s["start"]]
                    last = s["end"]
                kept.append(b" ".join(parts + words[last:]).decode())
            new = [pa.array(e.words.count.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], *new], [*names, "n_words", "spans", "kept"])

    text = F.col(text_col).cast("string").alias("text")
    seen = docs.select(F.col(key).alias("key"), text).mapInArrow(find_anchors, "anchor long, key long")
    # written first, so that the join's sides are two plain shuffles and a very common anchor's partition can be split
    repeated = cut_lineage(seen.groupBy("anchor").count().where("count > 1").select("anchor"))
    lists = cut_lineage(seen.join(repeated, "anchor", "left_semi").groupBy(F.col("key").alias(key)).agg(F.collect_set("anchor").alias(anchors_col)))
    dealt = docs.repartition(partitions_for(docs), key)
    tagged = dealt.join(lists.hint("merge"), key, "left")  # lists are long for their number of rows, which misleads the optimizer
    order = [*names, key, anchors_col]
    pieces = tagged.where(F.col(anchors_col).isNotNull()).select(F.col(key).alias("key"), text, F.col(anchors_col).alias("anchors"))
    pieces = pieces.mapInArrow(find_pieces, "piece long, check long, anchor long, key long, word long, size long")
    source = F.min(F.struct("key", "word")).alias("source")
    pieces = cut_lineage(pieces.groupBy("anchor", "piece", "check").agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("places"), source, F.max("size").alias("size")))
    branching = cut_lineage(pieces.groupBy("anchor").count().where("count > 1").select("anchor"))
    asked = pieces.where("places > 1").join(branching, "anchor", "left_semi").unionByName(pieces.where("places = 1"))
    asked = asked.select(F.col("source.key").alias(key), F.struct(F.col("source.word").alias("word"), "size", "piece", "places").alias("asked"))
    # with all columns, so that one shuffle of the texts serves this and the last pass
    asked = dealt.join(asked.groupBy(key).agg(F.collect_list("asked").alias(asked_col)).hint("merge"), key).select(*names, key, asked_col)
    edges = asked.mapInArrow(find_edges, "edge long, check long, places long, key long")
    unique = edges.groupBy("edge", "check").agg(F.sum("places").alias("places"), F.max("key").alias("key")).where("places = 1")
    unique = unique.groupBy(F.col("key").alias(key)).agg(F.collect_list("edge").alias(edges_col))
    schema = schema_with(docs.select(*names), n_words=T.LongType(), spans=T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), kept=T.StringType())
    return tagged.join(unique.hint("merge"), key, "left").select(*order, edges_col).mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` whose texts lack their repeated passages: every occurrence goes. Texts without one stay as they are, as do all rows and columns."""
    names = docs.columns
    clash = [c for c in names if c.lower() in ("n_words", "spans", "kept")]
    aside = dict(zip(clash, fresh(docs, *[f"qf_{c}" for c in clash]), strict=True))
    for c, d in aside.items():
        docs = docs.withColumnRenamed(c, d)
    out = repeated_spans(docs, id_col, text_col, window)
    text = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col(text_col)).alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"`{aside.get(c, c)}`").alias(c) for c in names])
