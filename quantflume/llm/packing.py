"""Packing of tokenized documents into training sequences, balanced by attention cost."""

from __future__ import annotations

import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quantflume.llm.bpe import byte_chars
from quantflume.llm.common import Remembered, text_blocks

#: Bytes of words kept with their ids in a worker; beyond it the cache starts anew.
CACHE_BYTES = 96 << 20
#: ASCII signs that the tokenizer keeps together in a run (apostrophes may begin a word).
SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Tokens packed together: bounds a worker's memory, whatever the input.
SHARD_TOKENS = 1 << 22


class WordEncoder:
    """Encodes texts with a public tokenizer file, each distinct word once.

    The tokenizer squeezes and drops white space, so that a text's ids are those
    of its space-separated words one after another. Values are ids as
    little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = Remembered(self.learn, CACHE_BYTES)
        self.byte_chars = byte_chars()
        self.tails: dict[str, bytes] = {}
        self.merge = self.tokenizer.model.tokenize
        self.id_bytes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def _plain(self, word: str) -> str | None:
        """A word of Latin letters as the merges take it; None if the word isn't one, in either case."""
        if word.isascii():
            return word.lower() if word.isalpha() else None
        if not word.isalpha() or max(word) >= "\u0250" or not unicodedata.is_normalized("NFC", word):
            return None
        low = word.lower()
        # the lower case of some letters holds a mark, which would join the signs behind it
        return low.encode().decode("latin-1").translate(self.byte_chars) if low.isalpha() else None

    def _letters(self, low: str) -> bytes:
        table = self.id_bytes
        return b"".join([table[t.id] for t in self.merge(low)])

    def _tail(self, tail: str) -> bytes:
        """Ids of a run of signs, which is a word of its own."""
        got = self.tails.get(tail)
        if got is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            got = self.tails[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return got

    def learn(self, word: str) -> bytes:
        """Letters need the merges only, signs behind them are a word of their own; other words take the tokenizer's whole path."""
        stem = word.rstrip(SIGNS)
        low = self._plain(stem) if stem else None
        if low is None:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(stem) == len(word):
            return self._letters(low)
        # what is known of a stem of plain letters came from its merges too
        got = self.known.get(stem)
        return (self._letters(low) if got is None else got) + self._tail(word[len(stem) :])

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def capacities(total: int, size: int) -> list[int]:
    """Full sequences, then the rest as powers of two, so that nothing is padded."""
    return [size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if total % size >> b & 1]


def balance(lengths: list[int], size: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """For each document its pieces (start, length, sequence, offset).

    Documents go in descending order of ``linear * n + quadratic * n * n`` (for
    that the longest first; ties in input order) to the sequence of least cost
    that has room; what doesn't fit is cut off and assigned in the same way.
    """
    room = capacities(sum(lengths), size)
    used, heap = [0] * len(room), [(0.0, -c, k) for k, c in enumerate(room)]
    heapq.heapify(heap)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for i in sorted(range(len(lengths)), key=lambda i: -(linear * lengths[i] + quadratic * lengths[i] * lengths[i])):
        start, left = 0, lengths[i]
        while left:
            cost, _, k = heapq.heappop(heap)
            n = min(left, room[k] - used[k])
            out[i].append((start, n, k, used[k]))
            used[k] += n
            start, left = start + n, left - n
            if used[k] < room[k]:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, used[k] - room[k], k))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1 / 2048, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Cost-balanced packing of whole documents into sequences of ``max_tokens``.

    Every document's ids and ``end_id`` are cut into pieces that fill sequences
    without padding: a shard's last tokens make sequences whose lengths are
    powers of two. Shards are runs of rows of one input partition, so nothing is
    shuffled and a worker holds ``shard_tokens`` ids and one document at most.

    ``max_tokens`` must be a power of two. Returns ``id_col``, ``start``,
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` (partition number in the high bits) and ``offset``.

    Null texts count as empty: their piece is the end id. Null ids stay null;
    repeated rows are documents of their own; an empty table gives no rows;
    other columns of ``docs`` aren't used, so their names can't clash.
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")
    kind = docs.schema[id_col].dataType
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = encoder(tokenizer).encode, TaskContext.get().partitionId() << 36, 0
        ids, held, total, id_type = [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, total
            rows = balance([len(h) // 4 for h in held], max_tokens, linear, quadratic)
            cut = [(i, *p) for i, pieces in enumerate(rows) for p in pieces]
            for a in range(0, len(cut), 4096):
                part = cut[a : a + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[p[0]] for p in part], id_type),
                        pa.array([p[1] for p in part], pa.int64()),
                        pa.array([p[2] for p in part], pa.int64()),
                        pa.array([held[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in part], pa.binary()),
                        pa.array([len(held[p[0]]) // 4 for p in part], pa.int64()),
                        pa.array([base + made + p[3] for p in part], pa.int64()),
                        pa.array([p[4] for p in part], pa.int64()),
                    ],
                    ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            made += len(capacities(total, max_tokens))
            ids.clear()
            held.clear()
            total = 0

        for rows, texts in text_blocks(batches, "text"):
            id_type = rows.column(0).type
            # as Python values: slices would keep the batch, texts and all
            for own, got in zip(rows.column(0).to_pylist(), encode(texts), strict=True):
                ids.append(own)
                held.append(got + end)
                total += len(held[-1]) // 4
                if total >= shard_tokens:
                    yield from flush()
        if held:
            yield from flush()

    schema = f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
