"""How far the sources of a language part from each other, by distinct count columns.

A term's column is its sparse vector of (source, count). Terms of a language
with the same column are one: every pair of sources is evaluated once for each
distinct column and multiplied by the number of its terms. Where a column is
empty in both sources of a pair the value depends on the pair alone, so only
the rest is evaluated. Shares are whole numbers of billionths, so that all
arithmetic is exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantflume.llm.common import cut_lineage, text_blocks

#: Documents of a language that a term needs, and ranks of terms that are listed.
LEAST_DOCUMENTS, LISTED = 3, 200
#: Distinct columns of a language that one task evaluates, about, and entries that a task's counts may have before they leave it.
COLUMNS, ENTRIES = 8192, 300_000
#: Hashes of listed columns up to which they are sent to every task.
SENT = 500_000
#: Shares are in parts of this.
UNIT = 1_000_000_000

#: Runs of letters A-Z in either case and of all that isn't ASCII, as UTF-8.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents with the term), pre-aggregated in tasks.

    Every group also has a row of the empty term, which no text has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            langs, sources, terms, n, docs_ = [], [], [], [], []
            for (lang, source), (times, texts) in held.items():
                terms += [b"", *times]
                n += [0, *times.values()]
                docs_ += [0, *(texts[t] for t in times)]
                langs += [lang] * (len(times) + 1)
                sources += [source] * (len(times) + 1)
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs_, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for part, texts in text_blocks(batches, "text"):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                times, seen = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(times)
                terms = _TERM.findall(text.encode("utf-8", "replace").lower())
                times.update(terms)
                seen.update(set(terms))
                size += len(times) - before
            if size > ENTRIES:
                yield rows()
                held, size = {}, 0
        if held:
            yield rows()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    found = docs.select(*plain).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division, so that no product overflows."""
    left, out = np.asarray(count, dtype=np.int64) + 1, 0
    for _ in range(3):
        left = left * 1000
        digit = left // total
        left, out = left - digit * total, out * 1000 + digit
    return out + 1


def apart(p, q):
    """The divergence of a share from another, a whole number."""
    return (p - q) * (p - q) // q


def pair_sums(row: np.ndarray, source: np.ndarray, count: np.ndarray, terms: np.ndarray, total: np.ndarray, a: int, block: int = 2048) -> np.ndarray:
    """For source ``a`` against every other: what columns change of the value that an empty column has, times their terms.

    ``row``, ``source``, ``count``: the columns' entries, by row; ``terms``:
    each column's number of terms; ``total``: each source's denominator.
    """
    empty = shares(np.zeros(len(total), dtype=np.int64), total)
    base = apart(empty[a], empty)
    p = shares(count, total[source])
    mine = np.flatnonzero(source == a)
    with_a = np.zeros(len(terms), dtype=bool)
    with_a[row[mine]] = True
    out = np.zeros(len(total), dtype=np.int64)
    # columns that a has: all others differ from the base
    at = np.full(len(terms), -1, dtype=np.int64)
    ends = np.searchsorted(row, np.arange(len(terms) + 1))
    for k in range(0, len(mine), block):
        rows = row[mine[k : k + block]]
        at[rows] = np.arange(len(rows))
        dense = np.tile(empty, (len(rows), 1))
        own = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows.tolist()])
        dense[at[row[own]], source[own]] = p[own]
        out += ((apart(p[mine[k : k + block]][:, None], dense) - base) * terms[rows][:, None]).sum(axis=0)
    # columns that it hasn't: those that the other has
    rest = np.flatnonzero(~with_a[row])
    np.add.at(out, source[rest], (apart(empty[a], p[rest]) - base[source[rest]]) * terms[row[rest]])
    return out


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, listed: int = LISTED, columns: int = COLUMNS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    A language keeps the V terms that ``least_documents`` of its documents
    have. A group is a (lang, source) that occurs; a term's share there is
    p = 1 + floor(10^9 (count + 1) / (N + V)), N the group's occurrences of kept
    terms; q is another group's or the whole language's share, and a term's
    value floor((p - q)^2 / q). ``pair``: the sum over all kept terms against
    every other source of the language. ``term``: the terms that the group has
    with p over the language's q, up to rank ``listed``. Ranks go by value
    descending, then by the item's bytes.

    Nulls in text, language and source count as empty strings, which are a
    language and a source like others. Repeated rows are documents of their
    own. A group without terms has pairs, a language without kept terms pairs
    of value 0; an empty table gives no rows; other columns aren't read.
    Two times the number of sources of a language squared rows come out of a
    language at most, beside the listed terms.
    """
    counts = cut_lineage(count_terms(docs, text_col, lang_col, source_col))
    by_term = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column"))
    terms = cut_lineage(by_term.where(F.col("docs") >= least_documents).select("lang", "term", "total", "column"))

    entries = terms.select("lang", F.explode("column").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    by_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    groups = counts.where("term = ''").select("lang", "source").join(entries, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "lang_n")]))
    distinct = terms.groupBy("lang", "column").agg(F.count(F.lit(1)).alias("terms"), F.max("total").alias("total"))
    distinct = cut_lineage(distinct.withColumn("id", F.monotonically_increasing_id()))
    return _pairs(groups, distinct, columns).unionByName(_terms(groups, distinct, terms, listed))


def _pairs(groups: DataFrame, distinct: DataFrame, columns: int) -> DataFrame:
    """Sums over all pairs of sources: every task evaluates some of a language's distinct columns."""
    cuts = max(1, -(-distinct.count() // columns))

    def evaluate(own: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source", kind="stable")
        lang, cut, names = group["lang"].iloc[0], int(group["cut"].iloc[0]), group["source"].to_numpy()
        v, total = int(group["v"].iloc[0]), group["n"].to_numpy(dtype=np.int64) + int(group["v"].iloc[0])
        size = len(names)
        if v == 0:
            sums = np.zeros((size, size), dtype=np.int64)
        else:
            place = {s: k for k, s in enumerate(names.tolist())}
            row = np.repeat(np.arange(len(own)), [len(s) for s in own["sources"]])
            source = np.array([place[s] for c in own["sources"] for s in c], dtype=np.int64)
            count = np.concatenate([np.zeros(0, dtype=np.int64), *own["counts"]]).astype(np.int64)
            weight = own["terms"].to_numpy(dtype=np.int64)
            sums = np.stack([pair_sums(row, source, count, weight, total, a) for a in range(size)])
            if cut == 0:  # what empty columns give, for all terms
                empty = shares(np.zeros(size, dtype=np.int64), total)
                sums += v * apart(empty[:, None], empty[None, :])
        a, b = np.nonzero(~np.eye(size, dtype=bool))
        return pd.DataFrame({"lang": lang, "source": names[a], "item": names[b], "value": sums[a, b]})

    # a column's cut depends on its contents, so that a language is as many tasks as its columns need
    own = distinct.select("lang", F.pmod(F.xxhash64("column"), F.lit(cuts)).cast("int").alias("cut"), F.col("column.source").alias("sources"), F.col("column.n").alias("counts"), "terms")
    every = groups.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    found = own.groupBy("lang", "cut").cogroup(every.groupBy("lang", "cut")).applyInPandas(evaluate, "lang string, source string, item string, value long")
    sums = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(groups: DataFrame, distinct: DataFrame, terms: DataFrame, listed: int) -> DataFrame:
    """The terms by which groups part most from their language: columns are ranked, then the terms that have them.

    Ranks go by the columns' numbers. Only terms whose column's hash is that of a
    listed column are moved, to be joined by the columns themselves.
    """
    share = lambda n, total: (F.lit(UNIT).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))
    hashed = F.xxhash64("lang", "column").alias("h")
    entries = distinct.select("lang", "id", hashed, "total", F.explode("column").alias("e")).select("lang", "id", "h", "total", F.col("e.source").alias("source"), F.col("e.n").alias("count"))
    entries = entries.join(groups, ["lang", "source"])
    (p_up, p_down), (q_up, q_down) = share(F.col("count"), F.col("n") + F.col("v")), share(F.col("total"), F.col("lang_n") + F.col("v"))
    entries = entries.select("lang", "source", "id", "h", p_up.alias("pu"), p_down.alias("pd"), q_up.alias("qu"), q_down.alias("qd"))
    entries = entries.select("lang", "source", "id", "h", F.expr("1 + pu div pd").alias("p"), F.expr("1 + qu div qd").alias("q")).where("p > q")
    valued = entries.select("lang", "source", "id", "h", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    valued = cut_lineage(valued.withColumn("at", best).where(F.col("at") <= listed).drop("at"))
    hashes = valued.select("h").distinct()
    hashes = F.broadcast(hashes) if hashes.count() <= SENT else hashes
    # a column's terms all have one value, so only its first ones can be listed
    first = F.row_number().over(Window.partitionBy("lang", "column").orderBy("term"))
    named = terms.select("lang", "column", "term", hashed).join(hashes, "h", "left_semi").drop("h").withColumn("at", first).where(F.col("at") <= listed).drop("at")
    named = named.join(distinct.select("lang", "column", "id", hashed).join(hashes, "h", "left_semi").drop("h"), ["lang", "column"]).select("id", "term")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    ranked = valued.join(named, "id").select("lang", "source", "value", "term", rank.alias("rank")).where(F.col("rank") <= listed)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
