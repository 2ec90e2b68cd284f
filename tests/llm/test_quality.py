import numpy as np

from quantflume.llm import quality, queries


def test_held_out_accuracy_over_the_whole_table(spark, sf_dir):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    kept = [i for i in truth if got[i].held_out]
    right = np.array([got[i].predicted == truth[i] for i in kept])
    assert right.mean() > 0.93
    low, high = [got[i].score for i in kept if not truth[i]], [got[i].score for i in kept if truth[i]]
    assert np.mean([a < b for a in low for b in high]) > 0.95


def test_chunks_cover_the_text():
    for n in (0, 1, 64, 511, 512, 513, 960, 961, 5000):
        raw = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        got = quality.chunks(raw)
        step = quality.CHUNK - quality.OVERLAP
        seen = np.full(len(got) * step + quality.CHUNK, 256)
        for k, row in enumerate(got):
            seen[k * step : k * step + quality.CHUNK] = row
        assert bytes(seen[:n].astype(np.uint8)) == raw and (seen[n:] == 256).all()


def test_batched_scores_equal_a_plain_convolution():
    rng = np.random.default_rng(1)
    model = quality.learn([quality.chunks(bytes(rng.integers(97, 123, 700, dtype=np.uint8))) for _ in range(8)], np.array([0, 1] * 4), filters=3, hidden=2, steps=3)
    p = model.params
    for text in ("", "ab", "hello world " * 200):
        z = []
        for row in quality.chunks(text.encode()):
            best = [max(sum(float(p["t"][j, row[i + j], f]) for j in range(quality.WIDTH)) for i in range(quality.CHUNK - quality.WIDTH + 1)) for f in range(3)]
            z.append(float(quality.chunk_logits(p, np.array(best))[2][0]))
        assert abs(quality.score_texts(model, [text])[0] - 1 / (1 + np.exp(-np.mean(z)))) < 1e-4


def test_whole_table_against_a_plain_convolution(spark):
    """The query's scores of every document of the small table, a chunk, a place and a filter at a time."""
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    p = {k: v.astype(float) for k, v in model.params.items()}
    got = {r.doc_id: r for r in queries.op8_quality(spark, small).collect()}
    rows = docs.collect()
    assert len(rows) == len(got) and rows
    for r in rows:
        raw = (r.text or "").encode()
        z, start = [], 0
        while True:
            part = [*raw[start : start + quality.CHUNK]]
            part += [256] * (quality.CHUNK - len(part))
            places = quality.CHUNK - quality.WIDTH + 1
            response = sum(p["t"][j][part[j : j + places]] for j in range(quality.WIDTH))
            features = np.maximum(response.max(axis=0) + p["c"], 0)
            z.append(float(np.tanh(features @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]))
            if start + quality.CHUNK >= len(raw):
                break
            start += quality.CHUNK - quality.OVERLAP
        want = 1 / (1 + np.exp(-(np.mean(z) + model.shift)))
        assert abs(got[r.doc_id].score - want) < 1e-4 and (got[r.doc_id].predicted == int(want >= 0.7) or abs(want - 0.7) < 1e-4)


def test_edge_rows(spark):
    rows = [(1, None, 0.1), (2, "", 0.1), (None, "x", 0.1), (4, "some text here " * 50, 0.2), (4, "some text here " * 50, 0.2), (5, "long words " * 20000, 0.3), (6, "%%% &&& *** " * 40, 0.4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1), (6, 0), (5, 1), (5, None), (99, 1), (None, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, steps=5)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id == 1} == {r.score for r in got if r.doc_id == 2}
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).collect() == []
