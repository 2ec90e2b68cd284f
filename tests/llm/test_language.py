import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantflume.llm import language, neural, queries


def test_held_out_accuracy_over_the_whole_table(spark, sf_dir):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_language(spark, sf_dir).collect()}
    assert got.keys() == truth.keys()
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(0 <= r.score <= 1 for r in got.values())
    right = [got[i].lang_pred == truth[i][0] for i in got if got[i].held_out]
    assert np.mean(right) > 0.97


def reference(model, raw, width=language.WINDOW, margin=language.MARGIN):
    """One window at a time, one position at a time; a window's margins count only at the text's ends."""
    p, h = model.params, model.hidden
    sig = lambda x: 1 / (1 + np.exp(-x))
    total, step, start = [], width - 2 * margin, 0
    while True:
        x = raw[start : start + width]
        states = np.zeros((len(x), 2 * h))
        x = [*x, *[256] * (width - len(x))]
        for d in range(2):
            s = np.zeros(h)
            for t in range(width) if d == 0 else reversed(range(width)):
                e, u = p[f"e{d}"][x[t]].astype(float), p[f"u{d}"].astype(float)
                z, r = sig(e[:h] + s @ u[:, :h]), sig(e[h : 2 * h] + s @ u[:, h : 2 * h])
                s = z * s + (1 - z) * np.tanh(e[2 * h :] + (r * s) @ u[:, 2 * h :])
                if t < len(states):
                    states[t, d * h : (d + 1) * h] = s
        y = states @ p["w"] + p["b"]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        end = start + width >= len(raw)
        total += list((y / y.sum(axis=1, keepdims=True))[margin if start else 0 : None if end else width - margin])
        if end:
            assert len(total) == len(raw)
            return np.mean(total, axis=0)
        start += step


def test_batched_run_equals_the_plain_recurrence():
    model = language.new_model(["a", "b", "c"], 5, 3)
    texts = ["", "x", "héllo " * 61, "q" * 128, "z" * 129, "ab " * 75, "k" * 224, "k" * 225]
    got = language.predict(language.Runner(model), texts)
    assert not got[0].any()
    for g, t in zip(got[1:], texts[1:], strict=True):
        assert np.allclose(g, reference(model, t.encode()), atol=1e-4)


def test_whole_table_against_the_plain_recurrence(spark):
    """The query's languages and scores of every document of the small table, a position at a time."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.train(docs)
    got = {r.doc_id: r for r in queries.op1_language(spark, small).collect()}
    rows = docs.collect()
    assert len(rows) == len(got) and rows
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (language.UNDETERMINED, 0)
            continue
        want = reference(model, r.text.encode())
        assert abs(got[r.doc_id].score - want.max()) < 1e-3
        best = np.sort(want)
        assert got[r.doc_id].lang_pred == model.labels[int(want.argmax())] or best[-1] - best[-2] < 1e-3


def test_gradients_reduce_the_loss():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(97, 105, (60, 32)), rng.integers(101, 109, (60, 32))]).astype(np.int16)
    y = np.repeat([0, 1], 60)
    model = language.learn(x, y, ["p", "q"], hidden=4, epochs=15, batch=20)
    sums, _ = language.Runner(model).pooled(x)
    assert (sums.argmax(axis=1) == y).mean() > 0.95


def test_edge_rows(spark):
    rows = [(1, None, "en", 5.0), (2, "", "en", 5.0), (None, "12 34 !!", "en", 5.0), (4, "the cat and the hat " * 20, "en", 5.0), (4, "the cat and the hat " * 20, "en", 5.0), (5, "der hund und die katze " * 9000, "de", 5.0), (6, "the thing " * 5, None, 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").withColumnRenamed("lang", "lang")
    model = language.train(docs, epochs=2)
    out = language.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {(r.doc_id, r.lang_pred) for r in out.collect() if r.doc_id in (1, 2, None)}
    assert got == {(1, "und"), (2, "und"), (None, "und")}
    assert out.count() == 7
    none = language.train(docs.limit(0))
    assert [r.lang_pred for r in language.identify(docs, none).collect()] == ["und"] * 7
    assert language.identify(docs.limit(0), model).collect() == []


def test_logits_beyond_the_exponent_give_no_nan():
    model = language.new_model(["a", "b"], 4, 3)
    model.params["w"] *= 1000
    got = language.predict(language.Runner(model), ["some text " * 30])[0]
    assert np.isfinite(got).all() and np.allclose(got, reference(model, b"some text " * 30), atol=1e-3)


def test_more_labels_than_the_sample_has_room_for_at_first(spark):
    """Every label is learned from; empty texts and repeated ids take no label's place."""
    rows = [(k, f"word{k} " * 5, f"l{k % 70:02d}") for k in range(700) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows += [(None, "copy " * 9, "copies")] * 300 + [(10_000 + k, "", "l00") for k in range(500)]
    x, y, labels = language.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 300, 1)
    assert labels == sorted({lang for _, _, lang in rows}) and set(y.tolist()) == set(range(71))
    few = neural.bounded_sample(spark.createDataFrame([(k, f"l{k % 50}") for k in range(5000)], "id long, label string"), "label", 10, F.xxhash64("id"), budget=100)
    assert few.columns == ["id", "label"] and {r["count"] for r in few.groupBy("label").count().collect()} == {2} and few.count() == 100
    with pytest.raises(ValueError):
        neural.bounded_sample(spark.range(30).selectExpr("id", "id label"), "label", 10, F.xxhash64("id"), budget=20)
