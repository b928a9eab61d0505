"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network is trained in numpy by backpropagation through time; its squashing function is x / (1 + |x|). It reads windows of WINDOW bytes from both ends, labels
every byte position, and a document's probabilities are the means over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.llm import textops

WINDOW, HIDDEN = 64, 8
#: Bounds of the fit: labelled documents that are collected and windows taken from each.
SAMPLE_ROWS, SAMPLE_WINDOWS = 3_000, 4
#: Bytes that one pass of the network takes.
SLICE_BYTES = 1 << 19
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Two directions: inputs (2, 256, 3H) with the biases in them, recurrent weights (2, H, 3H); the output (2H, C) and its bias.
    The 3H columns are reset gate, update gate and candidate."""

    langs: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: a tanh that costs a tenth of numpy's."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def _read(inputs: np.ndarray, recurrent: np.ndarray, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over bytes x (T, B); keep: also what backpropagation needs."""
    h_size = recurrent.shape[0]
    gates, cand = np.ascontiguousarray(recurrent[:, : 2 * h_size]), np.ascontiguousarray(recurrent[:, 2 * h_size :])
    h = np.zeros((x.shape[1], h_size), np.float32)
    states, kept = np.empty((len(x), *h.shape), np.float32), []
    for t in range(len(x)):
        g = inputs[x[t]]
        rz = h @ gates
        rz += g[:, : 2 * h_size]
        rz = _squash(rz)
        rz *= 0.5
        rz += 0.5
        u = h @ cand
        n = _squash(g[:, 2 * h_size :] + rz[:, :h_size] * u)
        if keep:
            kept.append((h, rz, u, n))
        h = n + rz[:, h_size:] * (h - n)
        states[t] = h
    return states, kept


def _back(recurrent: np.ndarray, x: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of inputs and recurrent weights from the gradients of the states, last step first."""
    h_size = recurrent.shape[0]
    d_in, d_rec = np.zeros((256, 3 * h_size), np.float32), np.zeros_like(recurrent)
    dh = np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, rz, u, n = kept[t]
        r, z = rz[:, :h_size], rz[:, h_size:]
        dh = dh + grad[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        gate = np.concatenate([dn * u, dh * (h - n)], 1)
        gate *= 0.5 * (1 - np.abs(2 * rz - 1)) ** 2
        np.add.at(d_in, x[t], np.concatenate([gate, dn], 1))
        back = np.concatenate([gate, dn * r], 1)
        d_rec += h.T @ back
        dh = dh * z + back @ recurrent.T
    return d_in, d_rec


def _softmax(a: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(a - a.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def fit(windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 350, batch: int = 192, seed: int = 7) -> Model:
    """windows: (n, WINDOW) bytes, padded with 0 behind sizes. Adam on the cross entropy of every position."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c, h = len(langs), HIDDEN
    p = [rng.normal(0, 0.3, (2, 256, 3 * h)), rng.normal(0, 0.4, (2, h, 3 * h)), rng.normal(0, 0.4, (2 * h, c)), np.zeros(c)]
    p = [x.astype(np.float32) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    one_hot = np.eye(c, dtype=np.float32)
    for step in range(1, steps + 1):
        k = rng.integers(0, len(windows), batch)
        x, y = windows[k].T, one_hot[labels[k]]
        seen = (np.arange(WINDOW)[:, None] < sizes[k]).astype(np.float32)[..., None]
        fore, keep_f = _read(p[0][0], p[1][0], x, True)
        rear, keep_r = _read(p[0][1], p[1][1], x[::-1], True)
        both = np.concatenate([fore, rear[::-1]], 2)
        miss = (_softmax(both @ p[2] + p[3], 2) - y) * seen / seen.sum()
        d_both = miss @ p[2].T
        f_in, f_rec = _back(p[1][0], x, keep_f, d_both[..., :h])
        r_in, r_rec = _back(p[1][1], x[::-1], keep_r, d_both[::-1, :, h:])
        grads = [np.stack([f_in, r_in]), np.stack([f_rec, r_rec]), both.reshape(-1, 2 * h).T @ miss.reshape(-1, c), miss.sum((0, 1))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for i, g in enumerate(grads):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            p[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(langs, *p)


def windowed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows (n, WINDOW), each window's number of bytes, and its text's row."""
    length = np.diff(offsets)
    parts = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), parts)
    start = offsets[:-1][row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    size = np.minimum(WINDOW, offsets[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)
    x = np.where(np.arange(WINDOW) < size[:, None], np.concatenate([data, np.zeros(WINDOW, np.uint8)])[at], 0)
    return x.astype(np.uint8), size, row


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray, block: int = 4096) -> np.ndarray:
    """(rows, languages): the mean over every byte position of a text; zeros for an empty one. A last window is read with zeros behind it, as in training, whatever stands beside it."""
    total = np.zeros((len(offsets) - 1, len(model.langs)))
    x, size, row = windowed(data, offsets)
    h = model.recurrent.shape[1]
    out_f, out_r = np.ascontiguousarray(model.output[:h]), np.ascontiguousarray(model.output[h:])
    for at in range(0, len(x), block):
        part, n = np.ascontiguousarray(x[at : at + block].T), size[at : at + block]
        fore, _ = _read(model.inputs[0], model.recurrent[0], part)
        rear, _ = _read(model.inputs[1], model.recurrent[1], part[::-1])
        pooled = np.zeros((len(n), len(model.langs)), np.float32)
        for t in range(WINDOW):
            e = fore[t] @ out_f
            e += rear[WINDOW - 1 - t] @ out_r
            e += model.bias
            e = np.exp(np.clip(e, -30, 30, out=e), out=e)
            e *= ((t < n) / e.sum(1))[:, None].astype(np.float32)
            pooled += e
        np.add.at(total, row[at : at + block], pooled)
    return total / np.maximum(1, np.diff(offsets))[:, None]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fits on SAMPLE_WINDOWS windows, spread evenly, of each of the SAMPLE_ROWS texts with a language whose ids have the smallest hashes.

    Null or empty texts and null languages are left out, and of an id with several texts or languages one, the first in their order, is learned from; without any, no language is learned and every prediction is `und`.
    """
    known = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("y")).filter((F.octet_length("t") > 0) & F.col("y").isNotNull())
    # the ids are picked without their texts, and of the texts only the windows move
    keys = textops.least_hashed(known.select("k"), "k", SAMPLE_ROWS)
    few = docs.sparkSession.createDataFrame([(r.k,) for r in keys], "k long")
    n, step = F.octet_length("t"), F.greatest(F.lit(0), F.octet_length("t") - WINDOW)
    cut = [F.substring(F.col("t").cast("binary"), (step * F.lit(i) / F.lit(max(1, SAMPLE_WINDOWS - 1))).cast("int") + 1, F.lit(WINDOW)).alias(f"w{i}") for i in range(SAMPLE_WINDOWS)]
    rows = known.join(F.broadcast(few), "k").select("k", F.struct("y", n.alias("n"), *cut).alias("s"))
    rows = [r.s for r in sorted(rows.groupBy("k").agg(F.min("s").alias("s")).collect(), key=lambda r: r.k)]
    if not rows:
        return Model([], np.zeros((2, 256, 3 * HIDDEN), np.float32), np.zeros((2, HIDDEN, 3 * HIDDEN), np.float32), np.zeros((2 * HIDDEN, 0), np.float32), np.zeros(0, np.float32))
    langs = sorted({r.y for r in rows})
    each = [(bytes(r[f"w{i}"]), langs.index(r.y)) for r in rows for i in range(SAMPLE_WINDOWS if r.n > WINDOW else 1)]
    x = np.zeros((len(each), WINDOW), np.uint8)
    for k, (b, _) in enumerate(each):
        x[k, : len(b)] = np.frombuffer(b, np.uint8)
    return fit(x, np.array([len(b) for b, _ in each]), np.array([y for _, y in each]), langs)


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row: the likeliest learned language of the whole text and its mean probability.

    `und` with score 0 where the text is null, empty or without a letter, or where nothing was learned. Ties go to the first
    language by code point. One row for each input row; other columns aren't read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, pred, score = batch.column(1), [], []
            data, offsets = textops.buffers(column)
            for i, j in textops.slices(offsets, SLICE_BYTES):
                known = [bool(t and model.langs and _LETTER.search(t)) for t in column.slice(i, j - i).to_pylist()]
                got = probabilities(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) if model.langs else np.zeros((j - i, 1))
                best = got.argmax(1)
                pred += [model.langs[b] if k else "und" for k, b in zip(known, best.tolist(), strict=True)]
                score += [float(s) if k else 0.0 for k, s in zip(known, np.clip(got.max(1), 0, 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, "doc_id long, lang_pred string, score double")
