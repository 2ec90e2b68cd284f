"""A quality classifier: a convolutional network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantflume.llm.common import text_blocks
from quantflume.llm.neural import Adam, bounded_sample, held_out

#: Bytes of a chunk, and how many of them the next chunk has too.
CHUNK, OVERLAP = 512, 64
#: Bytes that a filter sees.
WIDTH = 6
#: Chunks run through the network together.
BATCH = 64


@dataclass
class Model:
    """``t``: what byte b at place j adds to each filter (WIDTH, 257, filters); ``c``: filter biases; then two dense layers; ``shift``: log odds added for the labels' shares."""

    params: dict[str, np.ndarray]
    shift: float = 0.0


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping rows of CHUNK bytes that cover the whole text; 256 pads the last. An empty text is one row of padding."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, 256, dtype=np.int16)
    padded[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def filtered(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Filter responses (positions, chunks, filters) of chunks given as (CHUNK, chunks)."""
    n = len(x) - WIDTH + 1
    out = np.take(p["t"][0], x[:n], axis=0, mode="clip")
    more = np.empty_like(out)
    for j in range(1, WIDTH):
        out += np.take(p["t"][j], x[j : j + n], axis=0, out=more, mode="clip")
    return out


def chunk_logits(p: dict[str, np.ndarray], pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = np.maximum(pooled + p["c"], 0)
    h = np.tanh(f @ p["w1"] + p["b1"])
    return f, h, h @ p["w2"] + p["b2"]


def learn(docs: list[np.ndarray], y: np.ndarray, filters: int = 28, hidden: int = 12, steps: int = 1000, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Model:
    """Gradient descent on whole documents' probabilities: a document's log odds are its chunks' mean."""
    rng = np.random.default_rng(seed)
    p = {
        "t": (rng.standard_normal((WIDTH, 257, filters)) * 0.2).astype(np.float32),
        "c": np.zeros(filters, dtype=np.float32),
        "w1": (rng.standard_normal((filters, hidden)) / np.sqrt(filters)).astype(np.float32),
        "b1": np.zeros(hidden, dtype=np.float32),
        "w2": (rng.standard_normal(hidden) / np.sqrt(hidden)).astype(np.float32),
        "b2": np.zeros(1, dtype=np.float32),
    }
    adam, total, done = Adam(p, rate), steps, 0
    while done < total:
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            pick = order[at : at + batch]
            owner = np.repeat(np.arange(len(pick)), [len(docs[i]) for i in pick])
            share = (1 / np.bincount(owner))[owner].astype(np.float32)
            x = np.ascontiguousarray(np.concatenate([docs[i] for i in pick]).T).astype(np.intp)
            r = filtered(p, x)
            where = r.argmax(axis=0)
            pooled = np.take_along_axis(r, where[None], axis=0)[0]
            f, h, z = chunk_logits(p, pooled)
            logit = np.bincount(owner, weights=z * share)
            err = (1 / (1 + np.exp(-logit)) - y[pick]) / len(pick)
            dz = (err[owner] * share).astype(np.float32)
            dh = dz[:, None] * p["w2"] * (1 - h * h)
            df = (dh @ p["w1"].T) * (f > 0)
            g = {"w2": h.T @ dz, "b2": dz.sum(keepdims=True), "w1": f.T @ dh, "b1": dh.sum(axis=0), "c": df.sum(axis=0), "t": np.zeros_like(p["t"])}
            chunk = np.arange(x.shape[1])[:, None]
            for j in range(WIDTH):
                np.add.at(g["t"][j], (x[where + j, chunk], np.arange(filters)[None, :]), df)
            done += 1
            adam.step(g, scale=max(0.05, 1 - done / total))
    return Model(p)


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Each whole text's probability of label 1."""
    parts = [chunks(t.encode("utf-8", "replace")) for t in texts]
    x, p = np.concatenate(parts), model.params
    dense = {k: v.astype(np.float64) for k, v in p.items() if k != "t"}  # so that a text's company in a batch doesn't show
    z = np.empty(len(x))
    for a in range(0, len(x), BATCH):
        z[a : a + BATCH] = chunk_logits(dense, filtered(p, np.ascontiguousarray(x[a : a + BATCH].T).astype(np.intp)).max(axis=0))[2]
    sizes = np.array([len(q) for q in parts])
    logit = np.add.reduceat(z, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes + model.shift
    return np.round(1 / (1 + np.exp(-np.clip(logit, -50, 50))), 9)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1500, each: int = 3, **how) -> Model | None:
    """A model from a bounded sample of the labelled documents that aren't held out.

    At most ``per_label`` labels of each value (0 and 1; others and nulls are
    ignored) are drawn by hash, so 2 * per_label ids are broadcast to the
    documents and as many texts' cuts, ``each`` of CHUNK characters at places
    set by hash, reach the driver. The labels' shares are counted over all rows
    and enter the probabilities. None if there isn't a text of either label.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    few = bounded_sample(known, "label", per_label, F.xxhash64("id"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("length(text) > 0").join(F.broadcast(few), "id")
    size = F.greatest(F.lit(1), F.length("text") - CHUNK + 1)
    cuts = F.array(*[F.substring("text", F.pmod(F.xxhash64("id", F.lit(k)), size).cast("int") + 1, CHUNK) for k in range(each)])
    rows = texts.select("id", "label", cuts.alias("cuts")).orderBy("id", "label", "cuts").limit(4 * per_label).collect()
    if len({r.label for r in rows}) < 2:
        return None
    y = np.array([r.label for r in rows])
    model = learn([np.concatenate([chunks(c.encode("utf-8", "replace")[:CHUNK]) for c in r.cuts]) for r in rows], y, **how)
    model.shift = float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``score`` and ``predicted`` (1 from ``threshold`` on) of every whole text.

    Null texts count as empty; an empty text is scored as a chunk of padding.
    Without a model every score is 0.5. Null ids stay null; repeated rows give a
    row each; an empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, "text"):
            score = score_texts(model, texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
