"""Byte-pair encoding by a deterministic token automaton, compiled from the merges.

``Automaton`` holds the states that the merges' gadgets make, and the one
transition of a state under a token. ``Reader`` drives it by symbols: what it
has read is the transitions still possible, so that each symbol is one look
into a table. Nothing is tried and taken back.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantflume.llm.common import Remembered, fresh, schema_with, text_blocks

#: Bytes of words, and of white-space separated runs of them, kept with their ids in a worker; beyond it the caches start anew.
CACHE_BYTES = 80 << 20
#: Transitions kept in a worker's tables, of states under tokens and of readings under symbols; beyond it they are filled anew.
CACHE_ARCS = 250_000


def byte_chars() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Automaton:
    """The token automaton of an ordered list of merges.

    Its arcs are labelled with tokens, and a sequence of tokens is a path from
    state 0 if and only if it is the byte-pair encoding of its text. It is
    built merge by merge. At first one state loops on every symbol. The gadget
    of a merge (u, v) -> w: where the arcs u lead, a copy of the state takes its
    place that lacks the arc v; and wherever u v was a path, an arc w leads to
    where that path ended. All arcs of one label lead to the same state, ``to``.
    An arc w exists where u does, so a state that lacks u when w is made lacks w
    too; if u is v, the state after u also lacks w, as the leftmost pair merges first.

    A state is kept as the token whose arcs lead to its copies (``owner``), the
    merge that made it (``since``), and, by token, what its copies lack one
    after another (``gaps``: the merge's number by owner and label) and the
    state that the first of them was copied from (``born``). State 0 lacks nothing.
    """

    def __init__(self, symbols: list[int], merges: list[tuple[int, int, int]]):
        self.owner, self.since = [-1], [-1]
        self.to = dict.fromkeys(symbols, 0)
        self.born = dict.fromkeys(symbols, 0)
        self.gaps: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.made = dict.fromkeys(symbols, -1)
        self.live = set(symbols)
        for n, (u, v, w) in enumerate(merges):
            if w in self.made:
                raise ValueError("a token of two merges")
            if u in self.live and v in self.live and self._leads(self.to[u], v) >= 0:
                self.live.add(w)
            self.left[w], self.made[w] = u, n
            self.to[w] = self.born[w] = self.to[v]
            self.owner.append(u)
            self.since.append(n)
            self.to[u] = len(self.owner) - 1
            self.gaps[u << 20 | v] = n
        self.arcs: dict[int, int] = {}

    def _leads(self, state: int, x: int) -> int:
        """Where the arc ``x`` leads from a state, -1 if it has none: it lacks ``x`` if one of its copies does, or did lack what ``x`` begins with when that was made."""
        gaps, left, made, get = self.gaps, self.left, self.made, self.gaps.get
        begun, y, before = [(x, 1 << 60)], x, 1 << 60
        while y in left:
            before, y = made[y], left[y]
            begun.append((y, before))
        while state:
            u, n = self.owner[state] << 20, self.since[state]
            for y, before in begun:
                gap = get(u | y)
                if gap is not None and gap <= n and gap <= before:
                    return -1
            state = self.born[u >> 20]
        return self.to[x]

    def step(self, state: int, x: int) -> int:
        """``_leads`` through the table of transitions met so far."""
        key = state << 20 | x
        got = self.arcs.get(key)
        if got is None:
            if len(self.arcs) >= CACHE_ARCS:
                self.arcs.clear()
            got = self.arcs[key] = self._leads(state, x)
        return got


class Reader:
    """The automaton driven by symbols.

    ``tokens``: texts in symbols by token. Every text of known symbols has one
    path, so after each symbol exactly one token ends whose arc exists where it
    began; all that the rest of a text needs are the tokens that may still be
    under way, each with the state before it. That is a reading. ``moves`` has
    its transitions by symbol: the next reading, the token that ends and its
    number of symbols, in one integer. Readings are made as they are met and
    shared by all words that lead to them, up to ``CACHE_ARCS`` transitions.
    (Tables of integers, as objects would keep the garbage collector busy.)
    """

    def __init__(self, machine: Automaton, tokens: dict[int, tuple[str, ...]]):
        self.machine = machine
        # a trie over symbols: by node, symbol -> node << 24 | token + 1
        self.trie: list[dict[str, int]] = [{}]
        for x, spelled in tokens.items():
            if len(spelled) > 255:
                raise ValueError("a token of over 255 symbols")
            at = 0
            for c in spelled:
                got = self.trie[at].get(c)
                if got is None:
                    got = self.trie[at][c] = len(self.trie) << 24
                    self.trie.append({})
                node, at = at, got >> 24
            self.trie[node][spelled[-1]] |= x + 1
        self.reset()

    def reset(self) -> None:
        self.size, self.readings, self.moves, self.begun = 0, {}, [], []
        self._reading([], 0)

    def _reading(self, begun: list[int], state: int) -> int:
        """The reading of tokens begun (node << 40 | state << 8 | symbols so far) and of the state that is reached."""
        key = (*begun, state << 8)
        got = self.readings.setdefault(key, len(self.moves))
        if got == len(self.moves):
            self.moves.append({})
            self.begun.append(key)
        return got

    def after(self, reading: int, c: str) -> int:
        """The transition of a reading under a symbol, made now; -1 if no token ends there."""
        begun, last, size, trie, step = [], -1, 0, self.trie, self.machine.step
        for b in self.begun[reading]:
            found = trie[b >> 40].get(c)
            if found is not None:
                node, x = found >> 24, found & 0xFFFFFF
                if x and last < 0 and step(b >> 8 & 0xFFFFFFFF, x - 1) >= 0:
                    last, size = x - 1, (b & 255) + 1
                if trie[node]:
                    begun.append(node << 40 | (b & 0xFFFFFFFFFF) + 1)
        got = self.moves[reading][c] = -1 if last < 0 else self._reading(begun, self.machine.to[last]) << 32 | last << 8 | size
        self.size += 1
        return got

    def read(self, symbols: list[str]) -> list[int] | None:
        """The tokens of a text; None if it has an unknown symbol."""
        if self.size >= CACHE_ARCS:
            self.reset()
        reading, ends, moves = 0, [], self.moves
        for c in symbols:
            got = moves[reading].get(c)
            if got is None:
                got = self.after(reading, c)
            if got < 0:
                return None
            ends.append(got)
            reading = got >> 32
        path, i = [], len(ends) - 1
        while i >= 0:
            got = ends[i]
            path.append(got >> 8 & 0xFFFFFF)
            i -= got & 255
        path.reverse()
        return path


class Tokenizer:
    """Encoding and decoding with a tokenizer file of the public JSON format (a BPE model over byte-level symbols)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {u + v for u, v in pairs}
        symbols = [i for t, i in vocab.items() if t not in made]
        self.machine = Automaton(symbols, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.word_pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.byte_chars = byte_chars()
        ending = len(self.suffix)
        body = lambda t: t[:-ending] if ending and t.endswith(self.suffix) and len(t) > ending else t
        self.reader = Reader(self.machine, {i: (*body(t)[:-1], body(t)[-1] + t[len(body(t)) :]) for t, i in vocab.items() if i in self.machine.live})
        self.words = Remembered(self._word, CACHE_BYTES)
        self.runs = Remembered(self._run, CACHE_BYTES)

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-split word of byte-level characters; symbols outside the vocabulary are dropped."""
        symbols = list(word)
        symbols[-1] += self.suffix
        path = self.reader.read(symbols)
        if path is None:
            known = "".join(c if c in self.reader.trie[0] else " " for c in word)
            return b"".join(map(self.encode_word, filter(None, known.split(" ")))) if " " in known else b""
        return pack(f"<{len(path)}I", *path)

    def _split(self, part: str) -> list[str]:
        """The words of a normalized text; one of Latin letters, or with '.' or ',' behind it, without a look at the pattern."""
        if part.isalpha() and max(part) < "\u0250":
            return [part]
        if part[-1:] in (".", ",") and part[:-1].isalpha() and max(part) < "\u0250":
            return [part[:-1], part[-1]]
        return self.word_pattern.findall(part)

    def _word(self, word: str) -> bytes:
        """Ids of a word of a normalized text."""
        return self.encode_word(word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.byte_chars))

    def _run(self, run: str) -> bytes:
        """Ids of a text without spaces."""
        out = []
        for part in self.special_pattern.split(run) if self.special_pattern and "<" in run else [run]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # sigma in lower case, whatever follows
            part = part.lower()
            out += map(self.words.__getitem__, self._split(part))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        get = self.runs.__getitem__
        return [b"".join(map(get, text.replace("\n", " ").split(" "))) for text in texts]


class Labels:
    """The labels of the arcs by id: all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
        self.table = np.full(max(i for _, i in named) + 1, None, dtype=object)
        for t, i in named:
            self.table[i] = t

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the ids' arcs, joined by spaces as for a file without a decoder; unknown ids are skipped."""
        ids = ids[(ids >= 0) & (ids < len(self.table))]
        return " ".join(filter(None, self.table[ids].tolist()))


_loaded: dict[tuple[type, str], Tokenizer | Labels] = {}


def load(kind: type, path: str):
    """This worker's one object of a kind, made from a tokenizer file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_col`` and ``ids``, the token ids (array of int) of every whole text, without special tokens around it.

    ``decoded``: also decode them again, as column ``decoded``. Null texts count
    as empty (no ids); null ids stay null; repeated rows give a row each; an
    empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, "text"):
            raw = load(Tokenizer, path).encode(texts)
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            ids = np.frombuffer(b"".join(raw), dtype="<i4")
            out = [rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            if decoded:
                labels = load(Labels, path)
                out.append(pa.array([labels.decode(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][: len(out)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``, the text of the ids in ``ids_col``.

    Null arrays count as empty (an empty text); null and unknown ids are
    skipped. All rows and columns stay; a column named ``out_col`` is replaced.
    """
    rows = rows.drop(out_col)
    (work,) = fresh(rows, out_col)
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, column = load(Labels, path), batch.column(at)
            texts = [labels.decode(column[k].values.drop_null().to_numpy(zero_copy_only=False)) if column[k].is_valid and len(column[k].values) else "" for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, work])

    return rows.mapInArrow(run, schema_with(rows, **{work: T.StringType()}))
