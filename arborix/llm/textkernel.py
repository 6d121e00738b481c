"""Vectorised text primitives over Arrow string arrays.

All kernels work on the raw UTF-8 bytes of a batch. A word is a maximal run of
bytes other than 0x20 and 0x09-0x0D; words never span two texts. A null text is
an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_M1, _M2 = (np.uint64(x) for x in MIX)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_PAD = np.zeros(16, dtype=np.uint8)
SLICE_BYTES = 4 << 20


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into (first row, last row + 1, bytes, offsets) of about max_bytes; a text is never cut."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, raw_offsets, raw_data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(raw_offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw_data, dtype=np.uint8) if raw_data is not None and raw_data.size else np.zeros(0, np.uint8)
    if texts.null_count:  # a null may cover bytes
        lengths = np.where(np.asarray(texts.is_valid()), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            keep = np.repeat(np.asarray(texts.is_valid()), np.diff(offsets))
            data = data[offsets[0] : offsets[-1]][keep]
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~breaks[data]
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0], before[1:], after[-1], after[:-1] = False, solid[:-1], False, solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _lanes(buffer: np.ndarray, dtype: str) -> np.ndarray:
    """buffer seen as numbers that begin at every byte."""
    size = np.dtype(dtype).itemsize
    return np.ndarray(shape=(len(buffer) - size + 1,), dtype=dtype, buffer=buffer, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each word's bytes; without collisions among words of the same length up to 8 bytes."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    lanes = _lanes(np.concatenate([data, _PAD]), "<u8")
    length = ends - starts
    h = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    h = mix(h ^ (lanes[starts] & _KEEP[np.minimum(length, 8)]))
    at, idx = 8, np.flatnonzero(length > 8)
    while len(idx):
        part = lanes[starts[idx] + at] & _KEEP[np.minimum(length[idx] - at, 8)]
        h[idx] = mix((h[idx] + np.uint64(0x2545F4914F6CDD1D)) ^ part)
        at += 8
        idx = idx[length[idx] > at]
    return h


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries, in log k steps."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n, acc, covered, cur, width = len(h) - k + 1, None, 0, h, 1
    while True:
        if k & width:
            part = cur[covered : covered + n]
            acc = part.copy() if acc is None else mix(acc * np.uint64(0x9FB21C651E98DF25) + part)
            covered += width
        if covered == k:
            return acc
        cur = mix(cur[:-width] * np.uint64(0xD6E8FEB86659FD93) + cur[width:])
        width *= 2


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each k-word window that lies within one text, and that text."""
    counts = np.diff(first)
    fit = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), fit)
    start = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit) + first[:-1][doc]
    return start, doc


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    buffer = np.concatenate([data, _PAD])
    lane8, lane4 = _lanes(buffer, "<u8"), _lanes(buffer, "<u4")
    length, seed64 = ends - starts, np.uint64(seed)
    h = np.full(len(starts), seed64 + _P5)
    at = np.zeros(len(starts), dtype=np.int64)
    if len(big := np.flatnonzero(length >= 32)):
        with np.errstate(over="ignore"):
            v = [np.full(len(big), x) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
        pos, left, live = starts[big].copy(), length[big].copy(), np.arange(len(big))
        while len(live):
            for i in range(4):
                v[i][live] = _round(v[i][live], lane8[pos[live] + 8 * i])
            pos[live] += 32
            left[live] -= 32
            live = live[left[live] >= 32]
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for y in v:
            x = (x ^ _round(np.zeros_like(y), y)) * _P1 + _P4
        h[big] = x
        at[big] = pos - starts[big]
    h += length.astype(np.uint64)
    rest = length - at
    at += starts
    live = np.flatnonzero(rest >= 8)
    while len(live):
        h[live] = _rotl(h[live] ^ _round(np.zeros(len(live), np.uint64), lane8[at[live]]), 27) * _P1 + _P4
        at[live] += 8
        rest[live] -= 8
        live = live[rest[live] >= 8]
    if len(live := np.flatnonzero(rest >= 4)):
        h[live] = _rotl(h[live] ^ (lane4[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[live] += 4
        rest[live] -= 4
    live = np.flatnonzero(rest > 0)
    while len(live):
        h[live] = _rotl(h[live] ^ (buffer[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
        rest[live] -= 1
        live = live[rest[live] > 0]
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def single_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z in lower case and words one space apart: the bytes, each word's start and end in them, and words() first."""
    starts, ends, first = words(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint8), starts, ends, first
    length = ends - starts
    new = np.concatenate([[0], np.cumsum(length + 1)])
    keep = ~WHITESPACE[data]
    out = np.full(new[-1], 32, dtype=np.uint8)
    solid = np.ones(new[-1], dtype=bool)
    solid[new[1:] - 1] = False
    out[solid] = LOWER[data[keep]]
    return out, new[:-1], new[1:] - 1, first


_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def majority_bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes, the 64-bit number whose bit is 1 if set in over half of them."""
    out = np.zeros(len(counts), dtype=np.uint64)
    live = np.flatnonzero(counts)
    if len(live) == 0:
        return out
    counts = counts[live]
    chunks = -(-counts // 255)  # eight counters of a byte each fit in one addition
    chunk_doc = np.repeat(np.arange(len(live)), chunks)
    within = np.arange(len(chunk_doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = (np.cumsum(counts) - counts)[chunk_doc] + 255 * within
    doc_begin = np.cumsum(chunks) - chunks
    got = np.zeros(len(live), dtype=np.uint64)
    cells = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[cells[:, byte]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(sums, doc_begin, axis=0)
        for bit in range(8):
            got |= (2 * total[:, bit] > counts).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[live] = got
    return out
