"""Exact removal of repeated word windows behind a count-min prefilter.

A window is k consecutive words of one text. Every word covered by a window that
also starts earlier (smaller doc_id; then earlier in the text) is removed.

1. Sketch: each batch sends the cells its windows hit in both rows of a count-min
   sketch, a compressed sorted list for each stretch of the row; the stretches are
   merged by key. Counters stop at two, which is all that is asked of them, and
   never fall below the true count. The sketch widens with the input, so nothing
   of it is broadcast, and each stretch has a fixed size.
2. Each chunk of texts gets back its own cells that reached two. Windows hot in
   both rows are the candidates, about 2% of the windows that occur once and all
   others.
3. The first candidate of each word sequence in a chunk goes, with a 128-bit key,
   to an exact grouping; the chunks that lost are told. So a passage that
   stands in a third of all texts sends one entry a chunk, not one a text.
4. Each chunk removes the words.

Windows are the same where two independent 64-bit hashes are, within a chunk as
across chunks. A null text has no words; an empty table gives no rows. Null ids come
before all others; rows with the same id are ordered by the hash of their text.
Repeated rows count as copies, and so do ties: one stays. A chunk holds CHUNK_ROWS
texts of less than LONG_BYTES, and LONGER times fewer of texts up to LONGER times that, so
at most 32 MB or one text. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table

CELLS_PER_WINDOW, STRETCH_BITS, PART_BITS, CHUNK_ROWS, LONG_BYTES, LONGER, TASK_BYTES = 8, 25, 23, 2048, 1 << 14, 8, 64 << 20
SEED_A, SEED_B = 0x51ED270B, 0x3C6EF372


def pack_sorted(v: np.ndarray, universe_bits: int) -> bytes:
    """Elias-Fano code of ascending numbers below 2 ** universe_bits."""
    n = len(v)
    low_bits = max(0, universe_bits - max(n, 1).bit_length())
    high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    unary = np.zeros((1 << (universe_bits - low_bits)) + n, dtype=np.uint8)
    unary[high] = 1
    low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.array([n, low_bits], dtype="<u4").tobytes() + np.packbits(low.reshape(-1)).tobytes() + np.packbits(unary).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, low_bits = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    cut = 8 + (n * low_bits + 7) // 8
    low = np.unpackbits(np.frombuffer(blob, np.uint8)[8:cut], count=n * low_bits).reshape(n, low_bits).astype(np.uint64)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8)[cut:])) - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(low_bits)) | (low << np.arange(low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h if row == 0 else tk.mix(h * np.uint64(0xA0761D6478BD642F))) >> np.uint64(64 - bits)


def _keys(data: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, ...]:
    starts, ends, first = tk.words(data, offsets)
    begin, doc = tk.windows(first, k)
    h = tk.window_hashes(tk.word_hashes(data, starts, ends, seed), k)
    return starts, ends, first, begin, doc, h[begin]


def _runs(v: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal neighbours."""
    if len(v) == 0:
        return []
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])).tolist()
    return list(zip(at, [*at[1:], len(v)], strict=True))


def _stretches(v: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cut ascending numbers at the multiples of 2 ** bits."""
    part = v >> np.uint64(bits)
    for lo, hi in _runs(part):
        yield int(part[lo]), v[lo:hi] & np.uint64((1 << bits) - 1)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(row, part, chunk, cells): cell * 2, plus 1 if hit more than once here."""
    local = min(bits, STRETCH_BITS)
    for batch in batches:
        for chunk, texts in _by_chunk(batch):
            for _, _, data, offsets in tk.slices(texts, 2 * tk.SLICE_BYTES):
                h = _keys(data, offsets, k, SEED_A)[-1]
                out: dict = {"row": [], "part": [], "chunk": [], "cells": []}
                for row in (0, 1):
                    cells, times = np.unique(_cells(h, row, bits), return_counts=True)
                    for part, v in _stretches((cells << np.uint64(1)) | (times > 1).astype(np.uint64), local + 1):
                        out["row"].append(row)
                        out["part"].append(part)
                        out["chunk"].append(chunk)
                        out["cells"].append(pack_sorted(v, local + 1))
                yield pa.RecordBatch.from_arrays([pa.array(out["row"], pa.int32()), pa.array(out["part"], pa.int32()), pa.array(out["chunk"], pa.int64()), pa.array(out["cells"], pa.binary())], names=list(out))


def _by_chunk(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    chunk = np.asarray(batch.column("chunk"))
    order = np.argsort(chunk, kind="stable")
    texts = batch.column("text") if (np.diff(chunk) >= 0).all() else batch.column("text").take(pa.array(order))
    chunk = chunk[order]
    for lo, hi in _runs(chunk):
        yield int(chunk[lo]), texts.slice(lo, hi - lo)


def _merge(t: pa.Table, bits: int) -> pa.Table:
    """The cells of one stretch that reached two, for each chunk that hit them."""
    local = min(bits, STRETCH_BITS)
    seen = np.zeros(1 << local, dtype=np.uint8)
    lists = [unpack_sorted(b.as_buffer()) for b in t.column("cells")]
    for v in lists:
        cell = (v >> np.uint64(1)).astype(np.int64)
        seen[cell] = np.minimum(2, seen[cell] + 1 + (v & np.uint64(1)).astype(np.uint8))
    chunks: dict[int, list[np.ndarray]] = {}
    for chunk, v in zip(t.column("chunk").to_pylist(), lists, strict=True):
        cell = v >> np.uint64(1)
        if len(hot := cell[seen[cell.astype(np.int64)] > 1]):
            chunks.setdefault(chunk, []).append(hot)
    base = np.uint64(t.column("part")[0].as_py() << local)
    row = t.column("row")[0].as_py()
    return pa.table({"chunk": pa.array(list(chunks), pa.int64()), "row": pa.array([row] * len(chunks), pa.int32()), "base": pa.array([int(base)] * len(chunks), pa.int64()), "cells": pa.array([pack_sorted(np.unique(np.concatenate(v)), local) for v in chunks.values()], pa.binary())})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk as one compressed blob: a shuffle moves few large rows."""
    for batch in batches:
        chunk = np.asarray(batch.column("chunk"))
        order = pa.array(np.argsort(chunk, kind="stable"))
        sorted_batch = batch.take(order)
        chunk = np.asarray(sorted_batch.column("chunk"))
        blobs, names = [], []
        for lo, hi in _runs(chunk):
            sink = pa.BufferOutputStream()
            part = sorted_batch.slice(lo, hi - lo).select(["doc_id", "text"])
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(part)
            blobs.append(sink.getvalue().to_pybytes())
            names.append(int(chunk[lo]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "docs"])


def _unpack(t: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Ids of a chunk, their places in the order of all ids as pairs (not null, id), and its texts, in the order in which they count."""
    got = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in t.column("docs")])
    texts = pa.concat_arrays([c.cast(pa.large_string()) for c in got.column("text").chunks])
    ids = got.column("doc_id").combine_chunks()
    rank = np.stack([np.asarray(ids.is_valid()).astype(np.int64), np.asarray(ids.fill_null(0))])
    if len(np.unique(rank, axis=1).T) < len(ids):
        digest = np.array([hashlib.blake2b((x.as_py() or "").encode(), digest_size=8).digest() for x in texts])
        order = np.lexsort((digest, rank[1], rank[0]))
    else:
        order = np.lexsort((rank[1], rank[0]))
    at = pa.array(order)
    return ids.take(at), rank[:, order], texts.take(at)


def _firsts(h: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each entry of two hashes, whether no equal one stands before it."""
    order = np.lexsort((second, h))
    first = np.ones(len(h), dtype=bool)
    first[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    return first


def _candidates(docs: pa.Table, hot: pa.Table, k: int, bits: int, parts: int) -> pa.Table:
    """(part, chunk, keys): 128-bit keys and ids of the first candidate window of each word sequence in this chunk."""
    none = pa.table({"part": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary())})
    if docs.num_rows == 0 or hot.num_rows == 0:
        return none
    cells = [np.zeros(0, np.uint64)] * 2
    for row in (0, 1):
        got = [unpack_sorted(c.as_buffer()) + np.uint64(b.as_py()) for r, b, c in zip(hot.column("row"), hot.column("base"), hot.column("cells"), strict=True) if r.as_py() == row]
        cells[row] = np.sort(np.concatenate(got)) if got else cells[row]
    _, rank, texts = _unpack(docs)
    found = []
    for lo, _, data, offsets in tk.slices(texts):
        *_, doc, h = _keys(data, offsets, k, SEED_A)
        keep = np.ones(len(h), dtype=bool)
        for row in (0, 1):
            keep[keep] = _within(_cells(h[keep], row, bits), cells[row])
        second = _keys(data, offsets, k, SEED_B)[-1][keep]
        found.append((h[keep], second, *rank[:, lo + doc[keep]].view(np.uint64)))
    h, second, real, own = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(h) == 0:
        return none
    first = _firsts(h, second)
    order = np.flatnonzero(first)[np.argsort(h[first], kind="stable")]
    part = ((h[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    runs, chunk = _runs(part), docs.column("chunk")[0].as_py()
    blobs = [np.int64(b - a).tobytes() + pa.compress(np.concatenate([x[order[a:b]] for x in (h, second, real, own)]).tobytes(), codec="zstd", asbytes=True) for a, b in runs]
    return pa.table({"part": pa.array([int(part[a]) for a, _ in runs], pa.int32()), "chunk": pa.array([chunk] * len(runs), pa.int64()), "keys": pa.array(blobs, pa.binary())})


def _within(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if len(among) == 0:
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def _losers(t: pa.Table) -> pa.Table:
    """(chunk, keys): the keys whose first window in that chunk isn't the first of all."""
    parts = []
    for blob, chunk in zip(t.column("keys"), t.column("chunk").to_pylist(), strict=True):
        raw = blob.as_py()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        v = np.frombuffer(pa.decompress(raw[8:], 32 * n, codec="zstd", asbytes=True), np.uint64).reshape(4, n)
        parts.append((v[0], v[1], v[2], v[3].view(np.int64), np.full(n, chunk)))
    h, second, real, own, chunk = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((chunk, own, real, second, h))
    h, second, chunk = h[order], second[order], chunk[order]
    lost = np.zeros(len(h), dtype=bool)
    lost[1:] = (h[1:] == h[:-1]) & (second[1:] == second[:-1])
    keys, chunk = np.stack([h[lost], second[lost]], axis=1), chunk[lost]
    order = np.argsort(chunk, kind="stable")
    keys, chunk = keys[order], chunk[order]
    runs = _runs(chunk)
    return pa.table({"chunk": pa.array([int(chunk[a]) for a, _ in runs], pa.int64()), "keys": pa.array([keys[a:b].tobytes() for a, b in runs], pa.binary())})


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
    length = (ends - starts)[keep]
    last = np.ones(len(doc), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    step = length + ~last
    stop = np.cumsum(step)
    total = int(stop[-1]) if len(stop) else 0
    solid = np.ones(total, dtype=bool)
    solid[(stop - 1)[~last]] = False
    out = np.full(total, 32, dtype=np.uint8)
    out[solid] = data[~tk.WHITESPACE[data]][np.repeat(keep, ends - starts)]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=step, minlength=len(first) - 1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def _remove(docs: pa.Table, lost: pa.Table, k: int) -> pa.Table:
    if docs.num_rows == 0:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
    lists = [np.frombuffer(b.as_py(), np.uint64).reshape(-1, 2) for b in lost.column("keys")]
    keys = np.concatenate([np.zeros((0, 2), np.uint64), *lists])
    ids, _, texts = _unpack(docs)
    pieces = [(*_keys(data, offsets, k, SEED_A), _keys(data, offsets, k, SEED_B)[-1], data) for _, _, data, offsets in tk.slices(texts)]
    h, second = (np.concatenate([p[i] for p in pieces]) for i in (5, 6))
    # the lost keys stand before the windows, so a window of such a key isn't a first
    repeated = ~_firsts(np.concatenate([keys[:, 0], h]), np.concatenate([keys[:, 1], second]))[len(keys) :]
    at, n_words, n_removed, kept = 0, [], [], []
    for starts, ends, first, begin, _, own, _, data in pieces:
        hit = begin[repeated[at : at + len(own)]]
        at += len(own)
        cover = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + k, -1)
        keep = np.cumsum(cover)[:-1] == 0
        n_words.append(np.diff(first))
        gone = np.concatenate([[0], np.cumsum(~keep)])
        n_removed.append(gone[first[1:]] - gone[first[:-1]])
        kept.append(_kept(data, starts, ends, first, keep))
    return pa.table({"doc_id": ids, "n_words": pa.array(np.concatenate(n_words).astype(np.int64)), "n_removed": pa.array(np.concatenate(n_removed).astype(np.int64)), "kept_text": pa.concat_arrays(kept)})


def _by_length(place: Column, rows: int = CHUNK_ROWS) -> list[Column]:
    """What names a chunk, of texts by their place: texts of LONG_BYTES and more lie apart, by how often they are LONGER times that, and so many times fewer in a chunk.

    Few classes, as the sketch sends a list for each chunk and stretch.
    """
    size, step = F.coalesce(F.octet_length("text"), F.lit(0)), LONGER.bit_length() - 1
    times = F.when(size < LONG_BYTES, 0).otherwise(F.floor(F.log2(size / LONG_BYTES) / step).cast("int") + 1)
    return [times, F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(rows) / F.pow(F.lit(float(LONGER)), times))))]


def file_chunks(rows: int = CHUNK_ROWS) -> Column:
    """A chunk of at most about rows rows and rows * LONG_BYTES bytes, or of one text, by their place in the files of a scan."""
    return F.xxhash64(F.col("_metadata.file_path"), *_by_length(F.col("_metadata.row_index"), rows))


def dedup_substrings(docs: DataFrame, k: int = 20, chunk: Column | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row.

    chunk: a stable key that puts some thousand rows together; best one that rows of a scan task share, as file_chunks().
    Without it rows are dealt by the hash of id and text.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    bits = max(10, ((size.b or 0) * CELLS_PER_WINDOW // 6).bit_length())
    parts = 1 << max(0, bits - PART_BITS)
    # a third of TASK_BYTES goes by the sketch, the rest is texts: tasks stay as large while the input grows
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size.b or 0) // TASK_BYTES, 1)
    if chunk is None:
        h = F.xxhash64("doc_id", "text")
        chunk = F.xxhash64(*_by_length(F.pmod(h, F.lit(max(size.n, 1)))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chunk.cast("long").alias("chunk"))
    lists = rows.select("text", "chunk").mapInArrow(lambda it: _sketch(it, k, bits), "row int, part int, chunk long, cells binary")
    hot = lists.groupBy("row", "part").applyInArrow(lambda t: _merge(t, bits), "chunk long, row int, base long, cells binary")
    packed = rows.mapInArrow(_pack, "chunk long, docs binary").repartition(tasks, "chunk")
    found = packed.groupBy("chunk").cogroup(hot.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(lambda a, b: _candidates(a, b, k, bits, parts), "part int, chunk long, keys binary")
    lost = found.groupBy("part").applyInArrow(_losers, "chunk long, keys binary").repartition(tasks, "chunk")
    return packed.groupBy("chunk").cogroup(lost.groupBy("chunk")).applyInArrow(lambda a, b: _remove(a, b, k), "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed and digest of the words kept, for every document."""
    out = dedup_substrings(table(spark, sf_dir, "documents"), 20, file_chunks())
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle(k: int = 20) -> str:
    """The query in DuckDB's SQL: every window's word sequence in whole, grouped without a sketch."""
    sequence = ", ".join(["word", *(f"lead(word, {i}) over w" for i in range(1, k))])
    steps = [
        r"texts as (select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents)",
        "words as (select doc_id, unnest(range(len(ws))) as pos, unnest(ws) as word, len(ws) as n from texts)",
        f"windows as (select doc_id, pos, n, word, concat_ws(' ', {sequence}) as seq from words window w as (partition by doc_id order by pos))",
        f"starts as (select doc_id, pos, row_number() over (partition by seq order by doc_id, pos) > 1 as again from windows where pos + {k} <= n)",
        "marked as (select doc_id, w.pos, word, coalesce(again, false) as again from windows w left join starts s using (doc_id, pos))",
        f"covered as (select doc_id, pos, word, bool_or(again) over (partition by doc_id order by pos rows between {k - 1} preceding and current row) as gone from marked)",
        "kept as (select doc_id, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by pos) filter (where not gone) as kept_text from covered group by doc_id)",
    ]
    return "with " + ", ".join(steps) + " select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept_text, '')) as kept_sha256 from texts left join kept using (doc_id)"
