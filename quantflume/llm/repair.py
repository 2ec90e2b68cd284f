"""Repair of conversations by cheapest edits: Dijkstra on a lattice of (turn index, grammar state).

The lattice is implicit: nodes come into being as they are reached. Keys are
(cost, audit), where the audit is the string of the edits' initials, so that
ties go to the audit that is least in ASCII; the search stops at the first end
node it pops that the grammar accepts.

A conversation of over CHUNK rows is cut into chunks. In a chunk the cheapest
way from each grammar state to each other is found on its own; inserts come
right before a row there, so that no audit of a chunk begins another, and the
order of two ways through several chunks is that of the first in which they
differ. Chunks are then joined by sixteen costs and sixteen ranks each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflume.llm.common import cut_lineage, fresh, partitions_for

#: Rows of a chunk, and bytes of text from which on a conversation is cut, too.
CHUNK, CHUNK_BYTES = 1000, 16 << 20
#: Bytes of the long conversations' keys up to which they are broadcast.
KEY_BYTES = 8 << 20

#: Grammar (s?(ua)+)?: nothing yet, after s, after u, after ua. The role that may come next by an edit, and all that may.
START, SYSTEM, USER, DONE = range(4)
NEXT = "uuau"
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}
ENDS = (START, DONE)
BLANKS = " \t\n\x0b\x0c\r"

Row = tuple[str, bool, bool]  # the role's initial, must go, is truncated


def search(rows: list[Row], enter: int = START, chunk: bool = False) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from the state ``enter`` before the first row to the states after the last.

    A whole conversation may insert at its end, and has one result: the first
    end popped that the grammar accepts. A ``chunk`` may not, and has all.
    """
    n, heap, settled, found = len(rows), [(0, "", 0, enter)], set(), {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n:
            if chunk:
                found[state] = (cost, audit)
                continue
            if state in ENDS:
                return {state: (cost, audit)}
        else:
            initial, must_go, truncated = rows[i]
            heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not must_go:
                kept = STEPS.get((state, initial))
                if kept is not None:
                    heappush(heap, (cost + truncated, audit + "K", i + 1, kept))
                heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, STEPS[state, NEXT[state]]))
        heappush(heap, (cost + 2, audit + "I", i, STEPS[state, NEXT[state]]))
    return found


def replay(audit: str, turns: list[tuple[str, str]], state: int = START) -> tuple[list[str], int]:
    """The repaired ``role:text`` lines of (role, text) rows under an audit, and the state after them."""
    lines, i = [], 0
    for edit in audit:
        if edit in "IR":
            name = NAMES[NEXT[state]]
            lines.append(f"{name}:{turns[i][1] if edit == 'R' else ''}")
            state = STEPS[state, NEXT[state]]
        elif edit == "K":
            lines.append(f"{turns[i][0]}:{turns[i][1]}")
            state = STEPS[state, turns[i][0][:1]]
        i += edit != "I"
    return lines, state


def legal(a: str, b: str) -> bool:
    """Whether rows of these roles' initials may follow each other."""
    return a + b in ("su", "ua", "au")


def faults(turns: list[tuple[str, str]], again: list[bool] | None = None) -> list[str]:
    """Each row's first fault, or nothing: b(lank), d(uplicate), t(runcated). ``again``: which rows were seen earlier, where that is known."""
    seen, out = set(), []
    for k, (role, text) in enumerate(turns):
        bare = text.rstrip(BLANKS)
        if not bare:
            out.append("b")
        elif again[k] if again is not None else (role, text) in seen:
            out.append("d")
        else:
            out.append("" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def lattice(turns: list[tuple[str, str]], fault: list[str]) -> list[Row]:
    return [(role[:1], f in ("b", "d"), f == "t") for (role, _), f in zip(turns, fault, strict=True)]


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after the damage that their key chooses: ``key``, ``conv``, ``turn``, ``role``, ``text`` and ``gone``.

    Nulls of role and text are one space, and so are those of conversation and
    turn in the key; ``key`` tells a null conversation from all others. Dropped
    rows stay, marked ``gone`` and without text, so that no conversation is lost.
    """
    conv, turn = F.col(conv_col), F.col(turn_col)
    kind = F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    base = rows.select(
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"), conv.alias("conv"), turn.cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 0, F.lit(None)).when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    base = base.select("key", "conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return base.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("time", "times")


_FIELDS = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def repaired(turns: list[tuple[int | None, str, str]]) -> tuple:
    """All of ``_FIELDS`` but the conversation, from its rows in order."""
    plain = [(role, text) for _, role, text in turns]
    fault = faults(plain)
    ((cost, audit),) = search(lattice(plain, fault)).values()
    lines, _ = replay(audit, plain)
    illegal = sum(not legal(a[0][:1], b[0][:1]) for a, b in zip(plain, plain[1:], strict=False))
    return _gaps([t for t, _, _ in turns]), fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode("utf-8", "replace")).hexdigest()


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``conv_col``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` of every conversation, after ``damage``.

    Rows go by turn, nulls first; rows of one turn by role and text. Every row
    counts once, by its first fault: blank, duplicate (role and text came
    earlier), truncated (ends in none of ``.!?``). Keeping a row costs nothing,
    a new role 2, an inserted empty turn 2, deletion 3; truncated rows that
    stay cost 1 more; blank rows and duplicates go. The roles' initials must
    then read (s?(ua)+)?, at the least cost, ties to the least audit.

    Null conversations are one; a conversation that lost all rows has zeros, an
    empty audit and the hash of nothing. Repeated rows are duplicates of each
    other. An empty table gives no rows; other columns aren't read.
    Conversations of more than ``chunk`` rows or ``chunk_bytes`` bytes run in
    chunks, over as many tasks as they need; a last task sees what is left of
    one, a string a chunk, for its digest.
    """
    damaged = damage(rows, conv_col, turn_col, role_col, text_col)
    sizes = damaged.where(~F.col("gone")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = cut_lineage(sizes.where((F.col("n") > chunk) | (F.col("bytes") > chunk_bytes)).select("key"))
    keys = long.agg(F.coalesce(F.sum(F.octet_length("key") + 32), F.lit(0))).first()[0]
    kind = rows.schema[conv_col].dataType.simpleString()
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    small = damaged
    if keys:
        listed = F.broadcast(long) if keys <= KEY_BYTES else long.hint("merge")
        small = damaged.join(listed, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, turns, out, kind_ = None, None, [], [], None

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out, strict=True)]
            out.clear()
            types = [kind_, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _FIELDS)

        for batch in batches:
            kind_ = batch.schema.field("conv").type
            for key, c, turn, role, text, gone in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        out.append((conv, *repaired(turns)))
                    now, conv, turns = key, c, []
                if not gone:
                    turns.append((turn, role, text))
            if len(out) >= 1000:
                yield flush()
        if now is not None:
            out.append((conv, *repaired(turns)))
        if out:
            yield flush()

    columns = ["key", "conv", "turn", "role", "text", "gone"]
    dealt = small.repartition(partitions_for(rows, 64 << 20), "key").sortWithinPartitions("key", "turn", "role", "text").select(*columns)
    found = dealt.mapInArrow(run, schema)
    if keys:
        found = found.union(_in_chunks(damaged.where(~F.col("gone")).join(listed, "key", "left_semi"), schema, chunk, chunk_bytes))
    (name,) = fresh(found.drop("conv"), conv_col)
    return found.withColumnRenamed("conv", name)


def join_chunks(costs: np.ndarray, ranks: np.ndarray) -> tuple[int, list[tuple[int, int]], str]:
    """The cheapest way through chunks in a row: its cost, (enter, leave) of each chunk, and the inserts after the last.

    ``costs``, ``ranks``: a 4 by 4 table for each chunk, by the state before
    and after (cost -1: no way); ranks order a chunk's audits. No audit of a
    chunk begins another's, so two ways are in the order of the first chunk
    where they differ; all that is kept of the ways so far is that order.
    """
    ways, back = {START: (0, 0)}, []  # state: (cost, order of the audit so far)
    for cost, rank in zip(costs, ranks, strict=True):
        new, came = {}, {}
        for after in range(4):
            options = [(c + int(cost[s, after]), order, int(rank[s, after]), s) for s, (c, order) in ways.items() if cost[s, after] >= 0]
            if options:
                new[after] = min(options)
                came[after] = new[after][3]
        order = {x: k for k, x in enumerate(sorted({v[1:3] for v in new.values()}))}
        ways = {s: (v[0], order[v[1:3]]) for s, v in new.items()}
        back.append(came)
    tails = {START: "", SYSTEM: "II", USER: "I", DONE: ""}
    cost, _, _, state = min((c + 2 * len(tails[s]), order, tails[s], s) for s, (c, order) in ways.items())
    tail, path = tails[state], []
    for came in reversed(back):
        path.append((came[state], state))
        state = came[state]
    return cost, path[::-1], tail


def _in_chunks(rows: DataFrame, schema: str, chunk: int, chunk_bytes: int) -> DataFrame:
    """Long conversations, of which no task has more than a chunk's rows, or a string for each chunk."""
    spread = cut_lineage(rows.drop("gone").withColumn("row", F.monotonically_increasing_id()))
    order = ["key", "turn", "role", "text", "row"]
    n = partitions_for(spread, 64 << 20)
    # ranges in order, so that a conversation's partitions and the places in them number its rows
    placed = spread.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))
    placed = cut_lineage(placed)
    first = cut_lineage(placed.groupBy("key", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again")))
    # chunks end where their rows or their bytes would be too many
    width = F.greatest(F.lit(1), F.least(F.lit(chunk), F.floor(F.lit(chunk_bytes) / F.greatest(F.lit(1), F.col("longest"))))).cast("long")
    widths = cut_lineage(placed.groupBy("key", F.shiftright("at", 33).alias("part")).agg(F.max(F.octet_length("text")).alias("longest")).select("key", "part", width.alias("width")))
    cut = placed.join(first, "at", "left").withColumn("part", F.shiftright("at", 33)).join(widths, ["key", "part"])
    cut = cut.select("key", "conv", "turn", "role", "text", "at", F.coalesce("again", F.lit(True)).alias("again"), "part", F.expr("(at & 8589934591) div width").alias("cut"))
    cut = cut_lineage(cut)
    turns = cut_lineage(cut.groupBy("key").agg(F.first("conv").alias("conv"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")))

    def read(pdf: pd.DataFrame) -> tuple[list[tuple[str, str]], list[str]]:
        pdf = pdf.sort_values("at", kind="stable")
        plain = list(zip(pdf["role"].tolist(), pdf["text"].tolist(), strict=True))
        return plain, faults(plain, pdf["again"].tolist())

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        plain, fault = read(pdf)
        rows_ = lattice(plain, fault)
        found = {(s, e): way for s in range(4) for e, way in search(rows_, s, chunk=True).items()}
        rank = {a: k for k, a in enumerate(sorted({a for _, a in found.values()}))}
        costs = [found[s, e][0] if (s, e) in found else -1 for s in range(4) for e in range(4)]
        ranks = [rank[found[s, e][1]] if (s, e) in found else -1 for s in range(4) for e in range(4)]
        illegal = sum(not legal(a[0][:1], b[0][:1]) for a, b in zip(plain, plain[1:], strict=False))
        one = {"key": pdf["key"].iloc[0], "part": pdf["part"].iloc[0], "cut": pdf["cut"].iloc[0], "blank": fault.count("b"), "duplicate": fault.count("d"), "truncated": fault.count("t"), "illegal": illegal, "first": plain[0][0][:1], "last": plain[-1][0][:1], "costs": costs, "ranks": ranks}
        return pd.DataFrame([one])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "cut"], kind="stable")
        table = lambda c: np.array(pdf[c].tolist(), dtype=np.int64).reshape(-1, 4, 4)
        cost, path, tail = join_chunks(table("costs"), table("ranks"))
        between = sum(not legal(a, b) for a, b in zip(pdf["last"].tolist(), pdf["first"].tolist()[1:], strict=False))
        out = pdf[["key", "part", "cut"]].copy()
        out["enter"], out["leave"] = [p[0] for p in path], [p[1] for p in path]
        for c in ("blank", "duplicate", "truncated", "illegal"):
            out[c] = int(pdf[c].sum()) + (between if c == "illegal" else 0)
        out["cost"], out["tail"] = cost, tail
        return out

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        plain, fault = read(pdf)
        one = pdf.iloc[0]
        audit = search(lattice(plain, fault), int(one["enter"]), chunk=True)[int(one["leave"])][1]
        lines, _ = replay(audit, plain, int(one["enter"]))
        return pd.DataFrame([{"key": one["key"], "part": one["part"], "cut": one["cut"], "audit": audit, "lines": len(lines), "repaired": "\n".join(lines)}])

    solved = cut.groupBy("key", "part", "cut").applyInPandas(solve, "key string, part long, cut long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, ranks array<long>")
    chosen = cut_lineage(solved.groupBy("key").applyInPandas(combine, "key string, part long, cut long, enter int, leave int, blank long, duplicate long, truncated long, illegal long, cost long, tail string"))
    pieces = cut.join(chosen.select("key", "part", "cut", "enter", "leave"), ["key", "part", "cut"]).groupBy("key", "part", "cut").applyInPandas(apply, "key string, part long, cut long, audit string, lines long, repaired string")
    sums = chosen.groupBy("key").agg(*[F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "tail")]).join(turns, "key")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audits, lines, sha, tail = None, [], 0, hashlib.sha256(), ""

        def close() -> pa.RecordBatch:
            state = {"": DONE, "I": USER, "II": SYSTEM}[tail]
            more, _ = replay(tail, [], state)
            for line in more:
                sha.update(("\n" if lines or line is not more[0] else "").encode() + line.encode())
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array(["".join(audits) + tail]), pa.array([sha.hexdigest()])], ["key", "audit", "sha"])

        for batch in batches:
            for key, end, audit, n_, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        yield close()
                    now, audits, lines, sha, tail = key, [], 0, hashlib.sha256(), end
                audits.append(audit)
                if n_:
                    sha.update(("\n" if lines else "").encode() + text.encode("utf-8", "replace"))
                    lines += n_
        if now is not None:
            yield close()

    order = ["key", "part", "cut"]
    ends = cut_lineage(pieces).join(sums.select("key", "tail"), "key").repartition(n, "key").sortWithinPartitions(*order).select("key", "tail", "audit", "lines", "repaired")
    hashed = ends.mapInArrow(digest, "key string, audit string, sha string")
    return sums.join(hashed, "key").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
