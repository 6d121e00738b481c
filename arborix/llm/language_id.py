"""Language identification by a byte-level convolutional network.

Filters of several widths slide over windows of fixed length, their maxima over
the window pass a rectifier, and a softmax layer gives the languages. The whole
network is trained in numpy on the driver, on at most max_train windows of
labelled text. Every byte of a text lies in one window; the text's
probabilities are those of its windows averaged by length.

A text that is null or has no letter is `und` with score 0; an empty table gives
no rows. Languages are the labels seen in training, in order; without any labelled
row every text is `und`. Repeated rows are scored alike; a null id counts as the
id '' in the split. Equal probabilities give the first label. A very long text is
read in pieces of PIECE_WINDOWS windows. Columns other than those of keep and the
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table, with_columns
from .samples import remainder, sampled

LENGTH, WIDTHS, FILTERS, EMBED, PIECE_WINDOWS = 128, (2, 3, 4), 12, 6, 256
MAX_TRAIN, PIECES, EPOCHS, RATE, BATCH = 4000, 4, 6, 0.01, 32
#: Byte classes: letters without case, the space, and all other ASCII as one; each other byte for itself.
_FOLD = np.full(256, 1, dtype=np.uint8)
_FOLD[97:123] = np.arange(2, 28)
_FOLD[65:91] = np.arange(2, 28)
_FOLD[128:] = np.arange(28, 156)
_FOLD[[9, 10, 11, 12, 13, 32]] = 0
CLASSES = 156


class ByteCnn:
    """Tables of filter responses by byte and position (embedding times filter), and the softmax layer."""

    def __init__(self, labels: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (CLASSES, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 0.4, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def tables(self) -> list[np.ndarray]:
        return [np.stack([self.embed @ f[i * EMBED : (i + 1) * EMBED] for i in range(w)]) for f, w in zip(self.filters, WIDTHS, strict=True)]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each window of x (windows by LENGTH)."""
        out = []
        for t, b, w in zip(self.tables(), self.bias, WIDTHS, strict=True):
            n = x.shape[1] - w + 1
            r = t[0][x[:, :n]]
            for i in range(1, w):
                r += t[i][x[:, i : i + n]]
            out.append(r.max(axis=1) + b)
        return np.maximum(np.concatenate(out, axis=1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x).astype(np.float64) @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> None:
        """Adam on the cross-entropy; the gradient passes the maximum to the place that held it."""
        rng = np.random.default_rng(seed)
        parameters = self.parameters()
        first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                batch = order[lo : lo + BATCH]
                step += 1
                for p, g, m, v in zip(parameters, self._gradient(x[batch], y[batch]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        rows, best, pool = np.arange(len(x))[:, None], [], []
        for t, b, w in zip(self.tables(), self.bias, WIDTHS, strict=True):
            n = x.shape[1] - w + 1
            r = sum(t[i][x[:, i : i + n]] for i in range(w))
            best.append(r.argmax(axis=1))
            pool.append(np.take_along_axis(r, best[-1][:, None, :], axis=1)[:, 0] + b)
        z = np.concatenate(pool, axis=1)
        a = np.maximum(z, 0)
        s = a @ self.out + self.out_bias
        e = np.exp(s - s.max(axis=1, keepdims=True))
        ds = e / e.sum(axis=1, keepdims=True)
        ds[np.arange(len(y)), y] -= 1
        ds /= len(y)
        dz = (ds @ self.out.T) * (z > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for f, w, at, d in zip(self.filters, WIDTHS, best, np.split(dz, len(WIDTHS), axis=1), strict=True):
            df = np.zeros_like(f)
            for i in range(w):
                codes = x[rows, at + i]  # windows by filters
                part = f[i * EMBED : (i + 1) * EMBED]
                df[i * EMBED : (i + 1) * EMBED] = np.einsum("bke,bk->ek", self.embed[codes], d)
                np.add.at(d_embed, codes, d[:, :, None] * part.T[None])
            d_filters.append(df)
            d_bias.append(d.sum(axis=0))
        return [d_embed, *d_filters, *d_bias, a.T @ ds, ds.sum(axis=0)]


def window_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Folded windows of LENGTH bytes that cover each text (the rest of the last is blank), the text of each, and the bytes in it; PIECE_WINDOWS at a time."""
    lengths = np.diff(offsets)
    n = -(-lengths // LENGTH)
    ends = np.cumsum(n)
    padded = np.concatenate([_FOLD[data], np.zeros(LENGTH, np.uint8)])
    for lo in range(0, int(n.sum()), PIECE_WINDOWS):
        at = np.arange(lo, min(lo + PIECE_WINDOWS, int(n.sum())))
        doc = np.searchsorted(ends, at, side="right")
        within = at - (ends - n)[doc]
        begin = offsets[:-1][doc] + within * LENGTH
        size = np.minimum(lengths[doc] - within * LENGTH, LENGTH)
        x = padded[begin[:, None] + np.arange(LENGTH)]
        x[np.arange(LENGTH) >= size[:, None]] = 0
        yield x, doc, size


def fit(rows: list[tuple[str, str]], max_train: int = MAX_TRAIN) -> ByteCnn | None:
    """A network from (text, language) rows: one or more windows of each, max_train at most."""
    rows = [(t, y) for t, y in rows if t and y is not None and any(c.isalpha() for c in t)]
    labels = sorted({y for _, y in rows})
    if not labels:
        return None
    net, rng = ByteCnn(labels), np.random.default_rng(4)
    _, _, data, offsets = next(tk.slices(pa.array([t for t, _ in rows], pa.large_string()), 1 << 60))
    x, doc, size = (np.concatenate(v) for v in zip(*window_rows(data, offsets), strict=True))
    good = np.flatnonzero((size >= min(LENGTH, 16)) | (np.bincount(doc, minlength=len(rows))[doc] == 1))
    chosen = rng.permutation(good)
    _, once = np.unique(doc[chosen], return_index=True)  # every text has a window before any has two
    rest = np.setdiff1d(np.arange(len(chosen)), once)
    chosen = chosen[np.concatenate([once, rest])][:max_train]
    net.train(x[chosen], np.array([labels.index(rows[d][1]) for d in doc[chosen]]))
    return net


def identify(docs: DataFrame, net: ByteCnn | None, keep: list[str]) -> DataFrame:
    """The columns of keep, lang_pred and score of every whole text."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, F.when(letter, F.col("text")).alias("__text"))
    if net is None:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = with_columns(rows.schema.fields[:-1], "lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            best, top = [], []
            for lo, hi, data, offsets in tk.slices(batch.column(len(keep)), 1 << 20):
                total = np.zeros((hi - lo, len(model.labels)))
                for x, doc, size in window_rows(data, offsets):
                    np.add.at(total, doc, model.probabilities(x) * size[:, None])
                total = np.round(total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300), 9)  # the last digits depend on the batch
                best.append(total.argmax(axis=1))
                top.append(total.max(axis=1))
            best, top = np.concatenate(best or [np.zeros(0, int)]), np.concatenate(top or [np.zeros(0)])
            some = np.asarray(batch.column(len(keep)).is_valid())
            names = np.where(some, np.array(model.labels, dtype=object)[best], "und") if len(best) else []
            columns = [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(np.where(some, np.clip(top, 0, 1), 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def training_rows(docs: DataFrame, learnable: Column, most: int = MAX_TRAIN, pieces: int = PIECES) -> list[tuple[str, str]]:
    """(piece, language): up to `pieces` windows of each of at most `most` labelled texts, spread evenly over the whole text.

    The texts are chosen by the hash of id and text. Both bounds are of training alone; predictions read every byte.
    """
    known = sampled(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable).select("doc_id", "lang", "text"), most, "doc_id", "text")
    spread = f"array_distinct(transform(sequence(0, {pieces - 1}), i -> substring(text, 1 + int(greatest(length(text) - {LENGTH}, 0) * i div {max(pieces - 1, 1)}), {LENGTH})))"
    cut = known.select(F.xxhash64("doc_id", "text").alias("h"), "lang", F.posexplode(F.expr(spread)).alias("i", "t"))
    return [(r.t, r.lang) for r in sorted(cut.collect(), key=lambda r: (r.h, r.lang, r.i))]


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder by 4 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    net = fit(training_rows(docs, remainder("doc_id", 4) != 2))
    return identify(docs, net, ["doc_id"]).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
