"""Secret scans: trigram queries from regexes, an inverted index per block, verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.llm.common import fresh, schema_with, text_blocks


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping); those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: In the order that ties of a start are listed in.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

#: Strings that an exact part may stand for before it is turned into trigrams.
MOST_STRINGS = 64

#: A query: True (everything), a trigram, or ("and" | "or", parts).
Query = bool | bytes | tuple


def _all(op: str, parts: list[Query]) -> Query:
    """Simplified conjunction or disjunction."""
    if op == "and":
        parts = [p for p in dict.fromkeys(parts) if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: frozenset[str]) -> Query:
    """What holds for a text that has one of the strings somewhere."""
    raw = [s.encode() for s in sorted(strings)]
    return _all("or", [_all("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in raw])


def _character(code: int, folded: bool) -> str | None:
    """A literal as it stands in ASCII-lower-cased text; None where case folding beyond ASCII may match another (``folded``)."""
    c = chr(code)
    if not c.isascii():
        return None if folded else c
    return None if folded and c in "kKsS" else c.lower()


def _members(items: list, folded: bool) -> frozenset[str] | None:
    """The characters of a class, if they are few."""
    got: set[str | None] = set()
    for op, arg in items:
        if op is C.LITERAL:
            got.add(_character(arg, folded))
        elif op is C.RANGE and arg[1] - arg[0] < MOST_STRINGS:
            got |= {_character(c, folded) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(got) if len(got) <= 8 and None not in got else None


def _exact(op, arg, folded: bool) -> tuple[frozenset[str] | None, Query]:
    """All strings that a node stands for (None: too many to list, or unknown), and a query that holds wherever it matches."""
    if op is C.LITERAL:
        c = _character(arg, folded)
        return (None if c is None else frozenset([c])), True
    if op is C.IN:
        return _members(arg, folded), True
    if op is C.AT:
        return frozenset([""]), True
    if op is C.SUBPATTERN:
        return _sequence(arg[-1], folded or bool(arg[1] & re.IGNORECASE and not arg[1] & re.ASCII))
    if op is C.BRANCH:
        parts = [_sequence(p, folded) for p in arg[1]]
        if all(e is not None for e, _ in parts) and len(both := frozenset().union(*(e for e, _ in parts))) <= MOST_STRINGS:
            return both, True
        return None, _all("or", [_of_strings(e) if e is not None else q for e, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = arg
        e, q = _sequence(body, folded)
        if e is not None and high <= 4 and (few := _repeated(e, low, high)) is not None:
            return few, True
        if low == 0:
            return None, True
        return None, q if e is None else _of_strings(e)
    return None, True


def _repeated(strings: frozenset[str], low: int, high: int) -> frozenset[str] | None:
    """All strings of ``low`` to ``high`` of the given ones; None if they are too many."""
    now, out = frozenset([""]), frozenset()
    for n in range(high + 1):
        if n >= low:
            out |= now
        if len(out) > MOST_STRINGS or len(now) > MOST_STRINGS:
            return None
        now = frozenset(a + b for a in now for b in strings)
    return out


def _sequence(nodes, folded: bool) -> tuple[frozenset[str] | None, Query]:
    now, found, whole = frozenset([""]), [], True
    for op, arg in nodes:
        e, q = _exact(op, arg, folded)
        if e is not None and len(now) * len(e) <= MOST_STRINGS:
            now = frozenset(a + b for a in now for b in e)
            continue
        found.append(_of_strings(now))
        whole = False
        now = e if e is not None and len(e) <= MOST_STRINGS else frozenset([""])
        found.append(q)
    if whole:
        return now, True
    return None, _all("and", [*found, _of_strings(now)])


@lru_cache(maxsize=256)
def trigram_query(pattern: str) -> Query:
    """Boolean query over ASCII-lower-cased UTF-8 trigrams that every text with a match fulfils; True: none can be derived.

    Without the ASCII flag, ignored case reaches beyond ASCII (the Kelvin sign
    matches k, the long s matches s); such letters don't count.
    """
    tree = P.parse(pattern)
    flags = tree.state.flags
    e, q = _sequence(tree, bool(flags & re.IGNORECASE and not flags & re.ASCII))
    return _of_strings(e) if e is not None else q


def trigrams(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams(p) for p in query[1])) if isinstance(query, tuple) else set()


class Index:
    """Postings of the wanted trigrams over the texts of one block."""

    def __init__(self, texts: list[str], wanted: set[bytes]):
        self.n = len(texts)
        raw = [t.encode("utf-8", "replace").lower() for t in texts]
        data = np.frombuffer(b"\xff".join([*raw, b"", b""]), dtype=np.uint8)  # a byte that UTF-8 doesn't have parts the texts
        starts = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])]) if raw else np.zeros(0, int)
        codes = np.array(sorted(int.from_bytes(w, "big") for w in wanted), dtype=np.uint32)
        self.postings: dict[bytes, np.ndarray] = {}
        if not len(codes) or len(data) < 3:
            return
        filt = np.zeros(1 << 16, dtype=bool)
        filt[(codes ^ (codes >> np.uint32(8))) & np.uint32(0xFFFF)] = True
        wide = data.astype(np.uint32)
        all_codes = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        at = np.flatnonzero(filt[(all_codes ^ (all_codes >> np.uint32(8))) & np.uint32(0xFFFF)])
        found = all_codes[at]
        slot = np.searchsorted(codes, found)
        slot[slot == len(codes)] = 0
        real = codes[slot] == found
        doc = np.searchsorted(starts, at[real], side="right") - 1
        pairs = np.unique(slot[real].astype(np.int64) * self.n + doc)
        for k, code in enumerate(codes):
            lo, hi = np.searchsorted(pairs, (k * self.n, (k + 1) * self.n))
            self.postings[int(code).to_bytes(3, "big")] = pairs[lo:hi] - k * self.n

    def candidates(self, query: Query) -> np.ndarray:
        """Sorted numbers of the texts that fulfil the query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(query, np.zeros(0, dtype=np.int64))
        parts = [self.candidates(p) for p in query[1]]
        out = min(parts, key=len) if query[0] == "and" else parts[0]
        for p in parts:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def find_spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """For each text its (kind, start, end) by start, then the rules' order; code points, end exclusive."""
    asked = [trigram_query(r.pattern) for r in rules]
    index = Index(texts, set().union(*map(trigrams, asked)) if asked else set())
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, asked, strict=True)):
        finder = re.compile(rule.pattern).finditer
        for i in index.candidates(query).tolist():
            for m in finder(texts[i]):
                if len(m[rule.group]) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    return [[(rules[k].kind, a, b) for a, k, b in sorted(s)] for s in out]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans of secrets in whole texts: ``id_col`` and ``spans``, an array of (kind, start, end).

    From each rule's regex a Boolean trigram query is derived; a block's texts
    are indexed by the trigrams that any query names, postings are intersected
    and united, and the regex verifies the candidates. Rules without mandatory
    trigrams scan every text. Scans and index stay inside a partition: no
    shuffle, and a worker holds one block.

    Null texts count as empty (no spans); null ids stay null; repeated rows
    give a row each; an empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in find_spans(texts, rules)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, pa.list_(_SPAN))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping spans as one, named after the first."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((kind, a, b))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    parts, at = [], 0
    for kind, a, b in merged(spans):
        parts += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret of ``text_col`` replaced by its rule's kind; all rows and columns stay.

    Overlapping spans are replaced as one. Null texts stay null, empty tables
    stay empty, repeated rows stay repeated.
    """
    (work,) = fresh(docs, "redacted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, text_col):
            found = find_spans(texts, rules)
            clean = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            old = rows.column(names.index(text_col))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([c if v else None for c, v in zip(clean, old.is_valid().to_pylist(), strict=True)], pa.string())], [*names, work])

    out = docs.mapInArrow(run, schema_with(docs, **{work: T.StringType()}))
    return out.select(*[F.col(work).alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
