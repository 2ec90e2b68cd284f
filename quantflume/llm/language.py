"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantflume.llm.common import fresh, schema_with, text_blocks
from quantflume.llm.neural import Adam, bounded_sample, held_out

#: Bytes of a window, and of the margin at its borders with others: windows overlap by two margins, and
#: positions in a margin only give the states a start.
WINDOW, MARGIN = 128, 16
#: Windows run through the network together.
BATCH = 2048
UNDETERMINED = "und"
#: Bytes of doubt before a text is rejected.
DOUBT = 8
#: Bytes of the cuts on which limits of rejection are fitted; a text has the limit of the longest that it fills.
LENGTHS = (16, 32, 64, 128)
#: Characters below which a text counts as short in the sample that the rejecting model learns from.
SHORT = 256


@dataclass
class Model:
    """Weights of both directions (0 forward, 1 backward) and of the output layer.

    ``e``: input part of the gates by byte (257: padding), ``u``: recurrent
    part; columns are update, reset and candidate, each of the hidden size.

    ``limits``: the output layer has a last column, for text in none of the
    labels; a document is rejected whose share of it, less ``DOUBT``, exceeds its best label's limit
    for its length (a row for each label, a column for each of ``LENGTHS``).
    """

    labels: list[str]
    params: dict[str, np.ndarray]
    limits: np.ndarray | None = None

    @property
    def hidden(self) -> int:
        return self.params["u0"].shape[0]


def windows(raw: bytes, width: int = WINDOW, margin: int = 0) -> np.ndarray:
    """All of a text's bytes as rows of ``width`` that overlap by two margins; 256 pads the last."""
    step = width - 2 * margin
    n = -(-len(raw) // width) if len(raw) <= width else 1 + -(-(len(raw) - width) // step)
    out = np.full((n - 1) * step + width if n else 0, 256, dtype=np.int16)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(out, width)[::step] if n else out.reshape(0, width)


def new_model(labels: list[str], hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "01":
        p["e" + d] = (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32)
        p["e" + d][:, :hidden] += 0.5  # the update gate keeps most of the state at first
        p["u" + d] = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
    p["w"] = (rng.standard_normal((2 * hidden, len(labels))) * 0.3).astype(np.float32)
    p["b"] = np.zeros(len(labels), dtype=np.float32)
    return Model(labels, p)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def learn(x: np.ndarray, y: np.ndarray, labels: list[str], hidden: int = 8, epochs: int = 8, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Model:
    """Backpropagation through time: every byte's position is to name its document's language."""
    model = new_model(labels, hidden, seed)
    p, h = model.params, hidden
    adam, rng = Adam(p, rate), np.random.default_rng(seed)
    total, done = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            xs, ys = x[pick], y[pick]
            n, width = xs.shape
            real = xs < 256
            states, kept = np.zeros((n, width, 2 * h), dtype=np.float32), []
            for d in range(2):
                e, u = p[f"e{d}"], p[f"u{d}"]
                s, trace = np.zeros((n, h), dtype=np.float32), []
                for t in range(width) if d == 0 else range(width - 1, -1, -1):
                    g = e[xs[:, t]]
                    zr = _sigmoid(g[:, : 2 * h] + s @ u[:, : 2 * h])
                    z, r = zr[:, :h], zr[:, h:]
                    c = np.tanh(g[:, 2 * h :] + (r * s) @ u[:, 2 * h :])
                    new = z * s + (1 - z) * c
                    trace.append((t, s, z, r, c))
                    s = new
                    states[:, t, d * h : (d + 1) * h] = s
                kept.append(trace)
            prob = _softmax(states @ p["w"] + p["b"])
            err = prob
            err[np.arange(n), :, ys] -= 1
            err *= (real / real.sum())[:, :, None]
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            grads["w"] = np.einsum("nth,ntk->hk", states, err, optimize=True).astype(np.float32)
            grads["b"] = err.sum(axis=(0, 1)).astype(np.float32)
            back = err @ p["w"].T
            for d in range(2):
                u, gu, ge = p[f"u{d}"], grads[f"u{d}"], grads[f"e{d}"]
                ds = np.zeros((n, h), dtype=np.float32)
                for t, s, z, r, c in reversed(kept[d]):
                    ds = ds + back[:, t, d * h : (d + 1) * h]
                    dc = ds * (1 - z) * (1 - c * c)
                    dz = ds * (s - c) * z * (1 - z)
                    drs = dc @ u[:, 2 * h :].T
                    dr = drs * s * r * (1 - r)
                    dzr = np.concatenate([dz, dr], axis=1)
                    gu[:, : 2 * h] += s.T @ dzr
                    gu[:, 2 * h :] += (r * s).T @ dc
                    np.add.at(ge, xs[:, t], np.concatenate([dzr, dc], axis=1))
                    ds = ds * z + drs * r + dzr @ u[:, : 2 * h].T
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            if norm > 1:
                grads = {k: g / norm for k, g in grads.items()}
            done += 1
            adam.step(grads, scale=max(0.05, 1 - done / total))
    return model


class Runner:
    """Applies a model to many windows at once.

    Gates are kept apart and scaled so that one hyperbolic tangent serves all
    three: sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, model: Model):
        h, p = model.hidden, model.params
        self.h, self.k = h, p["w"].shape[1]
        f = lambda a: np.ascontiguousarray(a, dtype=np.float32)
        self.e = [[f(p[f"e{d}"][:, a * h : (a + 1) * h] * (0.5 if a < 2 else 1)) for a in range(3)] for d in range(2)]
        self.u = [[f(p[f"u{d}"][:, a * h : (a + 1) * h] * (0.5 if a < 2 else 1)) for a in range(3)] for d in range(2)]
        self.w, self.b = f(p["w"]), f(p["b"])
        # states lie between -1 and 1, so logits have a bound; beyond it their exponentials could overflow
        self.tame = bool((np.abs(self.w).sum(axis=0) + np.abs(self.b)).max() < 80)

    def _states(self, x: np.ndarray, d: int, out: np.ndarray) -> None:
        """``x``: (width, n) bytes; ``out``: (width, n, hidden)."""
        n, h = x.shape[1], self.h
        (ez, er, ec), (uz, ur, uc) = self.e[d], self.u[d]
        s = np.zeros((n, h), dtype=np.float32)
        z, r, c, m = (np.empty((n, h), dtype=np.float32) for _ in range(4))
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            at = x[t]
            np.take(ez, at, axis=0, out=z, mode="clip")
            z += np.matmul(s, uz, out=m)
            np.tanh(z, out=z)
            np.take(er, at, axis=0, out=r, mode="clip")
            r += np.matmul(s, ur, out=m)
            np.tanh(r, out=r)
            r += 1
            r *= s
            r *= 0.5
            np.take(ec, at, axis=0, out=c, mode="clip")
            c += np.matmul(r, uc, out=m)
            np.tanh(c, out=c)
            z += 1
            z *= 0.5
            s = out[t]
            np.subtract(out[t - 1] if d == 0 and t else out[t + 1] if d and t + 1 < len(x) else 0, c, out=s)
            s *= z
            s += c

    def pooled(self, x: np.ndarray, first: np.ndarray | int = 0, last: np.ndarray | int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
        """For each window the sum of the label probabilities of its positions from ``first`` to before ``last``, and their number."""
        at = np.arange(x.shape[1])[None, :]
        counted = (x < 256) & (at >= np.reshape(first, (-1, 1))) & (at < np.reshape(last, (-1, 1)))
        sums = np.empty((len(x), self.k))
        for a in range(0, len(x), BATCH):
            part, own = np.ascontiguousarray(x[a : a + BATCH].T).astype(np.intp), counted[a : a + BATCH].T
            width, n = part.shape
            fwd, bwd = (np.empty((width, n, self.h), dtype=np.float32) for _ in range(2))
            self._states(part, 0, fwd)
            self._states(part, 1, bwd)
            got = np.zeros((n, self.k), dtype=np.float32)
            for t in range(width):
                y = fwd[t] @ self.w[: self.h]
                y += bwd[t] @ self.w[self.h :]
                y += self.b
                if not self.tame:
                    y -= y.max(axis=1, keepdims=True)
                np.exp(y, out=y)
                share = y @ np.ones((self.k, 1), dtype=np.float32)
                np.divide(own[t][:, None], share, out=share)
                y *= share
                got += y
            sums[a : a + BATCH] = got
        return sums, counted.sum(axis=1)


def predict(runner: Runner, texts: list[str]) -> np.ndarray:
    """Each text's label probabilities, the mean over all its bytes' positions (no bytes: zeros)."""
    parts = [windows(t.encode("utf-8", "replace"), margin=MARGIN) for t in texts]
    sizes = np.array([len(p) for p in parts])
    out = np.zeros((len(texts), runner.k))
    if not sizes.sum():
        return out
    ends = np.cumsum(sizes)
    rows = np.arange(ends[-1])
    first = np.where(np.isin(rows, ends - sizes), 0, MARGIN)
    last = np.where(np.isin(rows, ends - 1), WINDOW, WINDOW - MARGIN)
    sums, counts = runner.pooled(np.concatenate(parts), first, last)
    starts, some = np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes > 0
    out[some] = np.add.reduceat(sums, starts[some], axis=0) / np.add.reduceat(counts, starts[some])[:, None]
    return out


#: Ranges of letters of other scripts.
_SCRIPTS = ((0xE0, 0xFF), (0x100, 0x17F), (0x370, 0x3FF), (0x400, 0x45F), (0x590, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0x3041, 0x3096), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_KEYS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef")


def stand_in(text: str, kind: int, rng: np.random.Generator) -> str:
    """A text of no learned language, of the shape of ``text``."""
    if kind < 2:  # another language in the same letters: vowels for vowels, consonants for consonants
        swap = {a: b for group in ("aeiouy", "bcdfghjklmnpqrstvwxz") for a, b in zip(group, rng.permutation(list(group)).tolist(), strict=True)}
        swap |= {a.upper(): b.upper() for a, b in swap.items()}
        return "".join(swap.get(c, c) for c in text)
    if kind == 2:  # letters in any order
        return "".join(rng.permutation(list(text)).tolist())
    if kind < 5:  # another script, and one read in the wrong encoding
        low, high = _SCRIPTS[rng.integers(len(_SCRIPTS))]
        out = "".join(chr(int(rng.integers(low, high))) if c.isalpha() else c for c in text)
        return out if kind == 3 else out.encode().decode("latin-1")
    keys, spaced = _KEYS[rng.integers(len(_KEYS))], rng.random() < 0.5
    return "".join(c if spaced and c == " " else keys[rng.integers(len(keys))] for c in text)


def learn_with_rejects(x: np.ndarray, y: np.ndarray, labels: list[str], hidden: int = 16, seed: int = 7, quantile: float = 0.995, typical: float = 0.98, **how) -> Model:
    """A model with one more class, learned from a stand-in for each training window.

    A quarter of the windows, set by a hash of their bytes, is kept from
    training and fits the limits. A label's limit for a length is the
    ``quantile`` of the share that its kept windows, cut to that length, give
    the class, so that few of its texts are rejected however short they are.
    At the longest length it lies halfway from the ``typical`` quantile, which
    a window full of junk inside a labelled document doesn't move, to the
    median of the windows' stand-ins, where that is more. It is 0.5 at least.
    A label without a kept window has its training windows instead.
    """
    rng, width = np.random.default_rng(seed), x.shape[1]
    texts = [bytes(row[row < 256].astype(np.uint8)).decode("utf-8", "ignore") for row in x]
    kept = np.array([zlib.crc32(t.encode()) % 4 == 0 for t in texts], dtype=bool)
    learned = np.flatnonzero(~kept if not kept.all() else kept)
    others = [windows((stand_in(texts[i], k % 6, rng) or "?").encode("utf-8")[:width], width) for k, i in enumerate(learned)]
    model = learn(np.concatenate([x[learned], *others]), np.concatenate([y[learned], np.full(len(learned), len(labels))]), [*labels, UNDETERMINED], hidden, seed=seed, **how)
    fits = [np.flatnonzero((y == k) & kept) if ((y == k) & kept).any() else np.flatnonzero(y == k) for k in range(len(labels))]
    limits, runner = np.zeros((len(labels), len(LENGTHS))), Runner(model)
    for k, rows in enumerate(fits):
        strange = np.concatenate([windows((stand_in(texts[i], a % 6, rng) or "?").encode("utf-8")[:width], width) for a, i in enumerate(rows)])
        for j, n in enumerate(LENGTHS):
            own, other = (runner.pooled(np.where(np.arange(width) < n, cut, 256)) for cut in (x[rows], strange))
            own, other = (sums[:, -1] / np.maximum(counts, 1) for sums, counts in (own, other))
            usual = np.quantile(own, typical)
            limits[k, j] = max(0.5, usual, (usual + np.median(other)) / 2) if n == LENGTHS[-1] else max(0.5, np.quantile(own, quantile))
    return Model(labels, model.params, limits)


def training_windows(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, each: int, width: int = WINDOW, short: int = 0) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample for training: ``each`` windows, at places set by hash, of ``per_label`` documents of each label.

    With ``short``, of each label as many are taken among texts of fewer
    characters than that as among the others.
    """
    usable = docs.where(F.col(label_col).isNotNull() & ~held_out(id_col) & (F.length(F.col(text_col).cast("string")) > 0)).select(F.col(label_col).cast("string").alias("label"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    if short:
        usable = usable.withColumn("stratum", F.struct("label", (F.length("text") < short).alias("short")))
    few = bounded_sample(usable, "stratum" if short else "label", per_label, F.xxhash64("id"))
    size = F.greatest(F.lit(1), F.length("text") - width + 1)
    cuts = F.array(*[F.substring("text", F.pmod(F.xxhash64("id", F.lit(k)), size).cast("int") + 1, width) for k in range(each)])
    rows = few.select("label", F.explode(cuts).alias("cut"), F.col("id")).orderBy("label", "id", "cut").collect()
    labels = sorted({r.label for r in rows})
    if not rows:
        return np.zeros((0, width), dtype=np.int16), np.zeros(0, dtype=int), labels
    x = np.concatenate([windows(r.cut.encode("utf-8", "replace")[:width], width) for r in rows])
    return x, np.array([labels.index(r.label) for r in rows]), labels


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 300, each: int = 2, rejects: bool = False, **how) -> Model:
    """A model of the labels of ``docs`` from a bounded sample of the documents that aren't held out.

    At most ``per_label`` documents of each label, fewer where there are more
    than 64 labels, and ``each`` windows of a document (so 19,200 * each windows
    of 128 bytes reach the driver at most; see ``neural.bounded_sample``).
    Without labelled texts the model knows no label. With ``rejects`` it also
    learns to tell texts that are in none of the labels, from two thirds as many
    short texts of each label and as many long ones.
    """
    if rejects:
        x, y, labels = training_windows(docs, id_col, text_col, label_col, max(1, per_label * 2 // 3), each, short=SHORT)
    else:
        x, y, labels = training_windows(docs, id_col, text_col, label_col, per_label, each)
    return (learn_with_rejects if rejects else learn)(x, y, labels, **how) if labels else Model([], {})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from the whole text.

    The network labels every byte's position; a document's probabilities are
    the mean over its positions. Null texts and texts without a letter are
    ``und`` with score 0, as is everything if the model knows no label, and
    what a model with limits rejects. Other
    columns and all rows stay; columns named like the two new ones are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner = Runner(model) if model.labels else None
        for rows, texts in text_blocks(batches, text_col):
            ok = np.array(rows.column(len(names)).to_pylist(), dtype=bool)
            prob = predict(runner, texts) if runner else np.zeros((len(texts), 1))
            ok &= bool(runner)
            if model.limits is not None:
                # a few bytes say little: the share counts as if so many bytes of the label came besides
                size = np.array([len(t.encode("utf-8", "replace")) for t in texts])
                prob, none = prob[:, :-1], prob[:, -1] * size / (size + DOUBT)
                length = np.maximum(np.searchsorted(LENGTHS, size, side="right") - 1, 0)
                ok &= none <= model.limits[prob.argmax(axis=1), length]
            best = prob.argmax(axis=1)
            label = [model.labels[b] if o else UNDETERMINED for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
            score = np.where(ok, np.clip(prob.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(label, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    picked = docs.select(*[F.col(f"`{c}`") for c in names])
    (work,) = fresh(picked, "lettered")
    schema = schema_with(picked, lang_pred=T.StringType(), score=T.DoubleType())
    return picked.withColumn(work, lettered).mapInArrow(run, schema)
