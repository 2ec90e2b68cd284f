import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantflume.llm import minhash, queries
from quantflume.llm.hashing import Words


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edit(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def check(rows, docs):
    """Digests exactly, likenesses within a few standard errors of the true Jaccard similarity."""
    order = sorted(docs, reverse=True)
    errors = []
    got = {r.doc_id: r for r in rows}
    assert got.keys() == docs.keys()
    for k, i in enumerate(order):
        text, following = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        changed = edit(text, following)
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        errors += [r.near_edited - jaccard(text, changed), r.near_next - jaccard(text, following)]
        if not shingles(text) or shingles(text) == shingles(changed):
            assert r.near_edited == jaccard(text, changed)
    return np.array(errors)


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_minhash(spark, sf_dir).collect()
    errors = check(rows, docs)
    assert np.abs(errors).max() < 0.16 and abs(errors.mean()) < 0.01 and errors.std() < 0.03
    by_text = {}
    for r in rows:
        assert by_text.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint


def test_word_hashes():
    texts = ["a bb\tccc", "", "  bb ", "ccc\n\na bb ccc dd"]
    w = Words(texts, lower=False)
    assert w.count.tolist() == [3, 0, 1, 5]
    spelled = [w.raw[a:b] for a, b in zip(w.start, w.end, strict=True)]
    assert spelled == b"a bb ccc bb ccc a bb ccc dd".split()
    for x, h in zip(spelled, w.hash, strict=True):
        assert {y for y, g in zip(spelled, w.hash, strict=True) if g == h} == {x}
    for n in (1, 2, 3, 5, 7, 9):
        runs = w.runs(n)
        for i in range(9 - n + 1):
            for j in range(9 - n + 1):
                assert (runs[i] == runs[j]) == (spelled[i : i + n] == spelled[j : j + n])


def test_densification_fills_every_bin():
    bins = np.full((3, minhash.BINS), minhash._EMPTY, dtype=np.uint64)
    bins[0, 7] = 5
    bins[1, ::2] = np.arange(minhash.BINS // 2)
    out = minhash.densify(bins)
    assert (out[0] == 5).all() and (out[1] < minhash.BINS).all() and (out[1, ::2] == bins[1, ::2]).all()
    assert (out[2] == minhash._EMPTY).all()


def test_edge_rows(spark):
    rows = [(9, None, "x"), (2, "", "y"), (None, "null id words here now", "z"), (4, "Hello world and more words", "z"), (4, "Hello world and more words", "z"), (7, "several long words " * 40000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id is None, -(r.doc_id or 0)), r.n_chars, r.edited) for r in minhash.compare_with_next(docs).collect())
    text = "Hello world and more words"
    want = [((False, -9), 0, ""), ((False, -7), 760000, edit(rows[5][1], text)), ((False, -4), 26, text[:13] + text[:13]), ((False, -4), 26, text[:13]), ((False, -2), 0, ""), ((True, 0), 22, "null id wor")]
    assert got == sorted(want)
    alone = minhash.compare_with_next(docs.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert minhash.compare_with_next(docs.limit(0)).collect() == []
    marked = minhash.fingerprint_documents(docs)
    assert sorted(marked.columns) == sorted(docs.columns) and marked.count() == 6
    assert {r.fingerprint for r in marked.where("doc_id in (2, 9)").collect()} == {""}
    with pytest.raises(TypeError):
        minhash.compare_with_next(docs.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_many_ranges_with_ties_and_nulls(spark):
    """More ranges than partitions and than ids; every row has its successor whatever the ranges."""
    rng = np.random.default_rng(0)
    ids = [None if k % 17 == 0 else int(x) for k, x in enumerate(rng.integers(-50, 50, 400))]
    docs = spark.createDataFrame([(i, f"text {k} of the table") for k, i in enumerate(ids)], "doc_id long, text string")
    for runs in (1, 3, 40, 500):
        at = minhash.in_descending_runs(docs, runs=runs).withColumn("part", F.spark_partition_id()).collect()
        assert sorted((r.id is None, r.id, r.text) for r in at if not r.extra) == sorted((i is None, i, f"text {k} of the table") for k, i in enumerate(ids))
        owner = {}
        assert all(owner.setdefault(r.run, r.part) == r.part for r in at)
    assert minhash.compare_with_next(docs).count() == 400


def test_slices_of_long_texts_hash_alike(monkeypatch):
    from quantflume.llm import hashing

    words = hashing.Words(["one two  three\tfour " * 30, "", "x" * 5000 + " y", "é ü\n日本" * 9], lower=False)
    whole = words.hashes(0), words.hashes(9)
    for size in (1, 7, 64, 4096):
        monkeypatch.setattr(hashing, "SLICE", size)
        assert (words.hashes(0) == whole[0]).all() and (words.hashes(9) == whole[1]).all()
