import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quantflume.llm import queries, substrings


def brute(docs, window=35):
    """id -> (words, removed flags), from counts of all windows as tuples."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs.items()}
    seen = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out[i] = (w, gone)
    return out


def kept(w, gone):
    return " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: (len(w), sum(g), hashlib.sha256(kept(w, g).encode()).hexdigest()) for i, (w, g) in brute(docs).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_substrings(spark, sf_dir).collect()}
    assert got == want and any(n for _, n, _ in want.values())


@pytest.mark.parametrize("window,anchor,letters", [(6, 3, 2), (8, 2, 3), (5, 5, 3), (9, 1, 2)])
def test_small_windows_with_periods_and_overlaps(spark, window, anchor, letters):
    rng = np.random.default_rng(window)
    docs = {i: " ".join("abc"[x] for x in rng.integers(0, letters, rng.integers(0, 40))) for i in range(30)}
    docs |= {50: "a b " * 20, 51: "c c c c c c c", 52: "c " * 12}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.kept, [(s.start, s.end) for s in r.spans]) for r in substrings.repeated_spans(df, window=window, anchor=anchor).collect()}
    for i, (w, gone) in brute(docs, window).items():
        assert got[i][:2] == (len(w), kept(w, gone)), (i, w)
        flags = [False] * len(w)
        for a, b in got[i][2]:
            flags[a:b] = [True] * (b - a)
        assert flags == gone


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(1, None, "x"), (2, "", "y"), (None, "null id\n" + long, "z"), (None, "other " + long + " tail", "z"), (4, "same " * 34, "q"), (4, "same " * 34, "q"), (5, "v " * 60000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(1, None, "x"), (2, "", "y"), (None, "null id", "z"), (None, "other tail", "z"), (4, "same " * 34, "q"), (4, "same " * 34, "q"), (5, "", "q")], key=str)
    assert substrings.remove_repeats(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([("k", long), ("k", long)], "doc_id string, text string")
    assert [r.kept for r in substrings.repeated_spans(twice).collect()] == ["", ""]


def test_long_words_that_differ_everywhere(spark):
    """Words that any polynomial modulo a power of two takes for equal."""
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{common} {one}"), (2, f"{common} {other}"), (3, f"{one} {other}"), (4, f"{one} " * 36), (5, f"{other} " * 35)]
    got = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 36, 5: 0}
