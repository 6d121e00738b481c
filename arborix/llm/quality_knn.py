"""Quality by nearest neighbours in a latent-semantic space.

Terms of a text are its hashed byte trigrams, the shapes of its words and pairs
of shapes, and words that repeat their predecessor. Weighted counts of the
labelled texts (at most max_labelled) are factored by a truncated singular value
decomposition. The latent vectors of those texts are broadcast, each document is
projected, its cosines with all of them are computed in blocks, and the labels of
the nearest are averaged, weighted by similarity.

A score depends on the text alone, not on its neighbours, order or batch. Null
and empty texts have no terms and get the share of label 1 among the labelled
rows; without labelled rows every score is 0.5; an empty table gives no rows. A
null id matches no label; repeated rows are scored alike. Ties at the last
neighbour share its place. A very long text is counted in one piece, in memory in
proportion to it; only its counts leave the executor. Columns other than those
of keep and the text are not read.
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

TRIGRAMS, SHAPES, TERMS = 1024, 512, 2048
RANK, NEIGHBOURS, MAX_LABELLED, POWER, DIGITS = 48, 15, 3000, 8, 9
_CLASS = np.full(256, 5, dtype=np.uint64)  # of a byte in a word: 0 lower, 1 upper, 2 digit, 3 mark of a sentence, 4 other symbol, 5 not ASCII
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[33, 34, 39, 40, 41, 44, 46, 58, 59, 63]] = 3
_FRACTION = 53


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the hashed terms of each text, logarithmic and of length 1 within each kind of term."""
    n = len(offsets) - 1
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, TERMS), dtype=np.float32)
    if len(data) > 2:
        b = tk.LOWER[data].astype(np.uint32)
        code = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
        code = ((code * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)  # 10 bits
        inside = doc_of[2:] == doc_of[:-2]
        out[:, :TRIGRAMS] = np.bincount((doc_of[2:] * TRIGRAMS + code)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    starts, ends, first = tk.words(data, offsets)
    if len(starts):
        doc = np.repeat(np.arange(n), np.diff(first))
        bits = np.uint64(1) << _CLASS[data]
        kinds = np.bitwise_or.reduceat(bits, np.stack([starts, ends], 1).reshape(-1)[: 2 * len(starts) - (ends[-1] == len(data))])[::2]
        shape = ((kinds << np.uint64(6)) | (np.uint64(1) << _CLASS[data[starts]])) * np.uint64(8) + np.minimum(ends - starts, 7).astype(np.uint64)
        last = _CLASS[data[ends - 1]]
        shape = tk.mix(shape * np.uint64(8) + last)
        h = tk.word_hashes(data, starts, ends, 9)
        before = np.zeros(len(h), dtype=bool)
        before[1:] = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
        single = TRIGRAMS + (shape % np.uint64(SHAPES)).astype(np.int64)
        pair = np.zeros(len(h), dtype=np.uint64)
        pair[1:] = np.where(doc[1:] == doc[:-1], shape[:-1] * np.uint64(3), np.uint64(0))  # a text's first word has no predecessor
        double = TRIGRAMS + SHAPES + (tk.mix(pair + shape) % np.uint64(SHAPES - 1)).astype(np.int64)
        double = np.where(before, TERMS - 1, double)
        for term in (single, double):
            out += np.bincount(doc * TERMS + term, minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)
    for part in (out[:, :TRIGRAMS], out[:, TRIGRAMS : TRIGRAMS + SHAPES], out[:, TRIGRAMS + SHAPES :]):
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1)  # shares, so that length doesn't matter
        np.sqrt(part, out=part)
    return out


class Latent:
    """The projection, the labelled vectors and their labels, from the term counts of the labelled texts."""

    def __init__(self, x: np.ndarray, labels: list[int], rank: int = RANK) -> None:
        self.labels = np.array(labels, dtype=np.float64)
        self.share = float(self.labels.mean())
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.3
        weighted = x * self.idf
        self.mean = weighted.mean(axis=0)
        centred = weighted - self.mean
        values, vectors = np.linalg.eigh(centred.T @ centred)  # terms by terms: its size doesn't depend on the rows
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(rank, len(x))])
        self.vectors = self._unit(centred @ self.basis)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """With every labelled vector, to DIGITS digits, so that a text's cosines don't depend on its neighbours in a block."""
        return np.round(self._unit((x * self.idf - self.mean) @ self.basis) @ self.vectors.T, DIGITS)

    def scores(self, x: np.ndarray, k: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        """The weighted share of label 1 among the k nearest labelled vectors, over exact cosines.

        Vectors as near as the k-th share the places that those nearer leave.
        """
        cosine = self.cosines(x)
        k = min(k, len(self.labels))
        last = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
        nearer, level = cosine > last, cosine == last
        places = (k - nearer.sum(axis=1)) / level.sum(axis=1)
        weight = np.where(nearer, np.maximum(cosine, 1e-3) ** power, level * (np.maximum(last, 1e-3) ** power * places[:, None]))
        score = np.round((weight @ self.labels) / weight.sum(axis=1), DIGITS)
        return np.where(x.any(axis=1), score, self.share)


def _blocks(texts: pa.Array, rows: int = 512) -> Iterator[np.ndarray]:
    """The term counts of the texts, some rows at a time."""
    for lo, hi, data, offsets in tk.slices(texts, 1 << 20):
        for at in range(0, hi - lo, rows):
            o = offsets[at : min(at + rows, hi - lo) + 1]
            yield term_counts(data[o[0] : o[-1]], o - o[0])


def fit(rows: list[tuple[str | None, int]]) -> Latent | None:
    """A model from (text, label) rows."""
    return Latent(np.concatenate(list(_blocks(pa.array([t for t, _ in rows], pa.large_string())))), [y for _, y in rows]) if rows else None


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, most: int = MAX_LABELLED) -> Latent | None:
    """A model from at most `most` labelled texts, chosen by the hash of id and text; ids whose labels disagree count as 0.

    The driver gets term counts, 4 * TERMS bytes for each chosen text however long that is.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = F.broadcast(sampled(known, most, "doc_id"))  # at most `most` rows of 12 bytes
    found = sampled(docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", "text"), most, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(2)):
                cells = pa.array([row.tobytes() for row in x.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), batch.column(1).slice(at, len(x)), cells], names=["key", "quality", "x"])
                at += len(x)

    got = found.select(F.xxhash64("doc_id", "text"), "quality", "text").mapInArrow(count, "key long, quality int, x binary").collect()
    got = sorted(got, key=lambda r: (r.key, r.quality))
    return Latent(np.stack([np.frombuffer(r.x, np.float32) for r in got]), [r.quality for r in got]) if got else None


def score_quality(docs: DataFrame, model: Latent | None, keep: list[str]) -> DataFrame:
    """The columns of keep and score of every whole text."""
    rows = docs.select(*keep, F.col("text").alias("__text"))
    if model is None:
        return rows.select(*keep, F.lit(0.5).alias("score"))
    schema = with_columns(rows.schema.fields[:-1], "score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_labelled and TERMS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.scores(x) for x in _blocks(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.clip(np.concatenate(got or [np.zeros(0)]), 0, 1).astype(np.float64))], names=[*keep, "score"])

    return rows.mapInArrow(score, schema)


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels whose remainder by 5 isn't 0."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    out = score_quality(docs, model, ["doc_id"])
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
