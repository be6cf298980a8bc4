"""Operator 3, language ID: a byte convolutional network in numpy.

Bytes are embedded; filters of several widths slide over them; each filter's
largest value in a window goes to a softmax over the learned languages. Texts
are cut whole into windows of fixed length, windows are scored in batches, and
a text's score is the mean of its windows' probabilities by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, bounded_sample, chunks, flat, held_out, tidied

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 8
#: Texts of each language that the network is fitted on, and windows of each text.
PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 4
EPOCHS = 8
BATCH = 512


def windows_of(data: np.ndarray, off: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (byte 0 pads), their rows and lengths; every byte is in one window."""
    size = np.diff(off)
    count = -(-size // width)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = off[row] + nth * width
    length = np.minimum(width, off[row + 1] - start)
    at = start[:, None] + np.arange(width)
    out = LOWER[data[np.minimum(at, max(0, len(data) - 1))]] if len(data) else np.zeros((0, width), np.uint8)
    out[np.arange(width) >= length[:, None]] = 0
    return out, row, length


class ByteNet:
    """Weights, forward pass and training of the network."""

    def __init__(self, n_classes: int, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        span, out = max(WIDTHS), FILTERS * len(WIDTHS)
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.mask = np.zeros((span * DIM, out), np.float32)
        for i, w in enumerate(WIDTHS):  # a narrower filter sees only its first bytes
            self.mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filt = (r.normal(0, (2 / (span * DIM)) ** 0.5, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(out, np.float32)
        self.dense = r.normal(0, 0.1, (out, n_classes)).astype(np.float32)
        self.base = np.zeros(n_classes, np.float32)

    def patches(self, x: np.ndarray) -> np.ndarray:
        span = max(WIDTHS)
        e = self.embed[np.pad(x, ((0, 0), (0, span - 1)))]
        n, width = x.shape
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, width, span * DIM), (s[0], s[1], s[2])).reshape(n * width, span * DIM)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = x.shape
        p = self.patches(x)
        conv = (p @ self.filt).reshape(n, width, -1)
        return np.maximum(conv.max(1) + self.bias, 0), conv

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x)[0] @ self.dense + self.base
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        names = ("embed", "filt", "bias", "dense", "base")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                g = self._gradients(x[order[i : i + batch]], y[order[i : i + batch]])
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, width = x.shape
        span = max(WIDTHS)
        p = self.patches(x)
        conv = (p @ self.filt).reshape(n, width, -1)
        top = conv.argmax(1)
        hidden = np.maximum(np.take_along_axis(conv, top[:, None, :], 1)[:, 0] + self.bias, 0)
        z = hidden @ self.dense + self.base
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        dh = (z @ self.dense.T) * (hidden > 0)
        which = (np.arange(n)[:, None] * width + top).ravel()  # the patch each filter chose
        col = np.tile(np.arange(dh.shape[1]), n)
        chosen = p[which]
        weighted = chosen * dh.ravel()[:, None]
        filt = np.zeros_like(self.filt)
        np.add.at(filt.T, col, weighted)
        back = (self.filt.T[col] * dh.ravel()[:, None]).reshape(-1, span, DIM)
        padded = np.pad(x, ((0, 0), (0, span - 1)))
        rows, at = np.divmod(which, width)
        embed = np.zeros_like(self.embed)
        for k in range(span):
            np.add.at(embed, padded[rows, at + k], back[:, k])
        return {"embed": embed, "filt": filt * self.mask, "bias": dh.sum(0), "dense": hidden.T @ z, "base": z.sum(0)}


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each sampled text, spread over it."""
    for batch in batches:
        data, off = flat(batch.column(1))
        langs = batch.column(0).to_pylist()
        out, lang = [], []
        for r in range(len(langs)):
            x, _, length = windows_of(data[off[r] : off[r + 1]], np.array([0, off[r + 1] - off[r]]))
            x = x[length >= min(64, length.max(initial=0))]
            for i in np.unique(np.linspace(0, len(x) - 1, WINDOWS_PER_TEXT).astype(int)) if len(x) else []:
                out.append(x[i].tobytes())
                lang.append(langs[r])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], ByteNet | None]:
    """Languages and network, fitted on at most PER_LANGUAGE texts of each language that aren't held out."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("_out"))
    rows = rows.where("not _out and lang is not null and text is not null and text rlike '\\\\p{L}'").select("lang", "text")
    sample = bounded_sample(rows, "lang", PER_LANGUAGE).select("lang", "text")
    t = sample.mapInArrow(tidied(_training_windows), "lang string, window binary").toArrow()
    names = np.array(t.column("lang").to_pylist(), dtype=object)
    if not len(names):
        return [], None
    raw = np.frombuffer(b"".join(t.column("window").to_pylist()), np.uint8).reshape(len(names), WINDOW)
    order = np.lexsort((np.array([w.tobytes() for w in raw], dtype="S16"), names.astype(str)))
    names, raw = names[order], raw[order]
    langs = sorted(set(names))
    net = ByteNet(len(langs))
    if len(langs) > 1:
        y = np.searchsorted(np.array(langs), names.astype(str))
        net.fit(raw, y)
    return langs, net


def _predict(model):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, net = model.value
        for batch in batches:
            data, off = flat(batch.column(3))
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, scores = [], []
            for i, j, d, o in chunks(data, off, 1 << 18):
                total = np.zeros((j - i, max(1, len(langs))))
                if langs and len(d):
                    x, row, length = windows_of(d, o)
                    for k in range(0, len(x), BATCH):
                        p = net.probabilities(x[k : k + BATCH]) if len(langs) > 1 else np.ones((len(x[k : k + BATCH]), 1))
                        np.add.at(total, row[k : k + BATCH], p * length[k : k + BATCH, None])
                total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
                best = total.argmax(1)
                for r in range(j - i):
                    known = bool(langs) and letter[i + r]
                    names.append(langs[best[r]] if known else "und")
                    scores.append(float(min(1.0, total[r, best[r]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    ``lang`` is only read for training, of rows that aren't held out. Null
    texts, texts without a letter and all texts when nothing could be learned
    are ``und`` with score 0; repeated rows are judged alike; other columns are
    not read; an empty table gives an empty result. Texts are read whole; no
    shuffle of texts. The network (some ten kilobytes) is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, doc_id, text, lang))
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), letter.alias("_letter"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidied(_predict(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
