"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other
values keeps its template. Windows of template tokens are hash-joined with the
windows of the benchmark items. A window's key holds its template and its slot
pattern - for each slot, how far back in the window the same value stands - so
equal keys mean that the slot values of one map one to one to those of the other:
a re-parameterised question matches, a window in which one value became two or
two became one does not, and takes no other window with it.

A text and an item are matched in three forms, and any of them is enough. In the
first, a name is a capitalised word (not one in capitals throughout) that doesn't
begin a sentence; in the second, every capitalised word is one, so where sentences
begin makes no difference. Windows of these forms need least_plain words that are
no slots, or as many as they have tokens. The third form is the words themselves
without placeholders, so a verbatim copy of any item is found in any case, however
short it is or full of numbers.

Tokens are words without punctuation, in lower case (ASCII and Latin-1). A number
starts with a digit; a unit is a listed word after a number; neighbouring names
are one. An item shorter than the window is one window.

Windows of documents first pass a Bloom filter of the benchmark's keys, whose size
is bounded (FILTER_BYTES); what passes is joined by 128-bit keys, so the filter
decides nothing but how much is shuffled. No item and no document goes to the
driver, and the join deals each hot window over SALTS tasks.

Null texts have no tokens; null ids of documents are kept as null; repeated rows
give repeated matches; repeated or null item ids are items of their own rows; an
empty table matches nothing. A very long text is read in one piece, in memory in
proportion to it. Columns of any name may stand beside those used; only those of
keep are carried. Of equally long matches in several forms the longest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import drop_written, table, with_columns, written

WINDOW, LEAST_PLAIN, SALTS = 10, 6, 8
FILTER_BYTES, BITS_PER_WINDOW, PROBES = 32 << 20, 32, 4
UNITS = ["g", "h", "m", "s", "l", "kg", "mg", "km", "cm", "mm", "ml", "ft", "mi", "lb", "oz", "min", "sec", "hr", "mph", "kmh", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "years", "year", "meters", "metres", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "liters", "litres", "grams", "kilograms", "kilometers", "kilometres"]
_SEED = 0x7A3D
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x11, 0x22, 0x33))

_B = np.arange(256)
_ALNUM = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_DROPPED = ~_ALNUM & ~tk.WHITESPACE
_STOPS = np.isin(_B, [ord(c) for c in ".!?:\n"])


class View(NamedTuple):
    """One form of the texts of a slice: hash of each token, its value and whether it is a slot, and the first token of each text."""

    token: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    first: np.ndarray


class Tokens:
    """Template tokens of a slice: class or hash, value hash of the slot, first token of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        place = np.flatnonzero(~_DROPPED[data])
        raw = data[place]
        cuts = np.searchsorted(place, offsets)
        low = tk.LOWER[raw]
        if len(raw) > 1:  # À to Þ, but for ×
            lead = np.zeros(len(raw), dtype=bool)
            lead[1:] = raw[:-1] == 0xC3
            wide = lead & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
            low = np.where(wide, raw + 0x20, low).astype(np.uint8)
        else:
            wide = np.zeros(len(raw), dtype=bool)
        starts, ends, first = tk.words(low, cuts)
        h = tk.word_hashes(low, starts, ends, _SEED)
        n = len(starts)
        head = raw[starts] if n else raw[:0]
        number = (head >= 48) & (head <= 57)
        capital = (head >= 65) & (head <= 90)
        second = np.minimum(starts + 1, max(len(raw) - 1, 0))
        capital |= (head == 0xC3) & (wide[second] if n else wide[:0])
        then = starts + np.where(head == 0xC3, 2, 1)  # a word in capitals is none
        follower = raw[np.minimum(then, max(len(raw) - 1, 0))]
        large = ((follower >= 65) & (follower <= 90)) | ((follower == 0xC3) & wide[np.minimum(then + 1, max(len(raw) - 1, 0))]) if n else wide[:0]
        capital &= (then < ends) & ~large
        stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
        begins = np.ones(n, dtype=bool)
        if n > 1:
            begins[1:] = stops[place[starts[1:]]] > stops[place[ends[:-1] - 1] + 1]
        begins[first[:-1][first[:-1] < n]] = True
        after = np.zeros(n, dtype=bool)
        after[1:] = number[:-1]
        after[first[:-1][first[:-1] < n]] = False
        unit = after & ~number & np.isin(h, _unit_hashes())
        self.words = View(h, h, np.zeros(n, dtype=bool), first)
        self.number, self.unit, self.capital = number, unit, capital & ~unit
        self.token, self.value, self.slot, self.first = self._template(self.capital & ~begins)

    def _template(self, name: np.ndarray) -> View:
        """The words with placeholders, given which of them are names."""
        h, first, n = self.words.token, self.words.first, len(name)
        again = np.zeros(n, dtype=bool)
        again[1:] = name[:-1] & name[1:]
        again[first[:-1][first[:-1] < n]] = False
        slot = self.number | self.unit | name
        token = np.where(self.number, _NUMBER, np.where(self.unit, _UNIT, np.where(name, _NAME, h)))
        keep = ~again
        kept = np.concatenate([[0], np.cumsum(keep)])
        value = h[keep]
        if again.any():  # a run of names is one slot
            group = np.cumsum(keep) - 1
            whole = np.zeros(len(value), dtype=np.uint64)
            np.add.at(whole, group, h * np.uint64(0x9E3779B97F4A7C15))
            merged = np.bincount(group, minlength=len(value)) > 1
            value = np.where(merged, whole, value)
        return View(token[keep], value, slot[keep], kept[first])

    def views(self) -> list[View]:
        """The template, that with sentence openings as names too, and the words as they are but for case."""
        return [View(self.token, self.value, self.slot, self.first), self._template(self.capital), self.words]


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        starts, ends, _ = tk.words(data, np.array([0, len(data)]))
        _units.append(tk.word_hashes(data, starts, ends, _SEED))
    return _units[0]


def _pattern(t: View, n: int) -> np.ndarray:
    """For each first token of a window of n, a number that tells which of its slots hold equal values; 0 where all differ."""
    out = np.zeros(len(t.token) + 1, dtype=np.uint64)
    slots = np.flatnonzero(t.slot)
    if len(slots) < 2:
        return out
    doc = np.searchsorted(t.first, slots, side="right")
    order = np.lexsort((slots, t.value[slots], doc))
    at, value, doc = slots[order], t.value[slots][order], doc[order]
    near = np.flatnonzero((value[1:] == value[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] - at[:-1] < n))
    second, back = at[near + 1], at[near + 1] - at[near]
    begin = np.maximum(second - n + 1, 0)
    times = second - back - begin + 1  # the windows that hold both
    place = np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    offset = np.repeat(second, times) - place
    np.add.at(out, place, tk.mix((offset * 64 + np.repeat(back, times)).astype(np.uint64)))
    return out


class Keys(NamedTuple):
    """Windows of a slice: 128-bit key, first token, number of tokens, text and form."""

    key: np.ndarray
    second: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    form: np.ndarray


class Filter:
    """A Bloom filter of 64-bit keys in a bit map whose size is a power of two."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def probe(key: np.ndarray, i: int, size: int) -> np.ndarray:
        """The i-th bit of each key in a map of size bytes."""
        return tk.mix(key + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(8 * size - 1)

    def holds(self, key: np.ndarray) -> np.ndarray:
        """The places of the keys that may be in it."""
        live = np.arange(len(key))
        for i in range(PROBES):
            at = self.probe(key[live], i, len(self.bits))
            live = live[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return live


def window_keys(t: View, form: int, n: int, least_plain: int, short: bool = False, only: Filter | None = None) -> Keys:
    """The windows of n tokens with enough plain words; with short, those texts that have n tokens and no more. only: keep those that pass it."""
    begin, doc = tk.windows(t.first, n)
    key = tk.window_hashes(t.token, n)[begin]
    pattern = _pattern(t, n)[begin]
    key = tk.mix(key ^ tk.mix(pattern + np.uint64(64 * form + n + 1)))
    some = np.arange(len(key)) if only is None else only.holds(key)
    plain = np.concatenate([[0], np.cumsum(~t.slot)])
    some = some[plain[begin[some] + n] - plain[begin[some]] >= min(least_plain, n)]
    if short:
        some = some[np.diff(t.first)[doc[some]] == n]
    second = np.full(len(some), np.uint64(n))
    for i in range(n):
        second = tk.mix(second * np.uint64(0xD6E8FEB86659FD93) + t.token[begin[some] + i])
    second = tk.mix(second ^ tk.mix(pattern[some]))
    return Keys(key[some], second, begin[some], np.full(len(some), n), doc[some], np.full(len(some), form))


def _all(parts: list[Keys]) -> Keys:
    return Keys(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def text_keys(data: np.ndarray, offsets: np.ndarray, k: int, least_plain: int, lengths: list[int], only: Filter | None = None) -> Keys:
    """All windows of k tokens, or of one of the lengths, in every form."""
    views = Tokens(data, offsets).views()
    return _all([window_keys(v, form, n, 1 if form == 2 else least_plain, only=only) for form, v in enumerate(views) for n in sorted({k, *lengths})])


def item_keys(data: np.ndarray, offsets: np.ndarray, k: int, least_plain: int) -> Keys:
    """The windows of items: of k tokens, or the whole of a shorter item; templates of items that are too short to have enough plain words are left out."""
    parts = []
    for form, v in enumerate(Tokens(data, offsets).views()):
        least = 1 if form == 2 else least_plain
        parts.append(window_keys(v, form, k, least))
        for n in sorted(set(np.diff(v.first).tolist()) & set(range(min(least, k) if form < 2 else 1, k))):
            parts.append(window_keys(v, form, n, least, short=True))
    return _all(parts)


def _item_windows(benchmark: DataFrame, k: int, least_plain: int) -> DataFrame:
    """item (a number of its own for each row), item_id, form, n, key and key2 of each distinct window of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in tk.slices(batch.column(2)):
                w = item_keys(data, offsets, k, least_plain)
                at = pa.array(w.doc + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(w.form.astype(np.int32)), pa.array(w.length.astype(np.int32)), pa.array(w.key.view(np.int64)), pa.array(w.second.view(np.int64))], names=["item", "item_id", "form", "n", "key", "key2"])

    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return written(items.mapInArrow(compute, "item long, item_id long, form int, n int, key long, key2 long").distinct(), "benchmark-windows")


def _filter(windows: DataFrame, n: int, filter_bytes: int) -> Filter:
    """The filter of all keys: built in pieces by key, at most filter_bytes in all."""
    size = min(max(n * BITS_PER_WINDOW // 8, 1 << 10), filter_bytes)
    size = 1 << (size.bit_length() - 1)
    piece = min(size, 1 << 20)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            key = np.asarray(batch.column(0)).view(np.uint64)
            at = np.unique(np.concatenate([Filter.probe(key, i, size) for i in range(PROBES)])).astype(np.int64)
            for part in np.unique(at // (8 * piece)):
                got = at[at // (8 * piece) == part] - part * 8 * piece
                np.bitwise_or.at(bits.setdefault(int(part), np.zeros(piece, np.uint8)), got >> 3, (1 << (got & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([b.tobytes() for b in bits.values()], pa.binary())], names=["part", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce(np.stack([np.frombuffer(b.as_py(), np.uint8) for b in t.column("bits")]))
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    parts = windows.select("key").repartition(max(1, n >> 20), "key").mapInArrow(build, "part long, bits binary")
    for r in parts.groupBy("part").applyInArrow(merge, "part long, bits binary").collect():  # filter_bytes at most
        out[r.part * piece : (r.part + 1) * piece] = np.frombuffer(r.bits, np.uint8)
    return Filter(out)


def _candidates(rows: DataFrame, windows: DataFrame, k: int, least_plain: int, filter_bytes: int) -> DataFrame:
    """The columns of rows but for __text, __row, form, n, key, key2 and p of each window that passes the filter of the benchmark's."""
    n = windows.count()
    lengths = [r.n for r in windows.where(F.col("n") < k).select("n").distinct().collect()]  # fewer than k
    shared = rows.sparkSession.sparkContext.broadcast(_filter(windows, n, filter_bytes))  # filter_bytes at most
    names, kinds = rows.columns[:-1], rows.schema.fields[:-1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in tk.slices(batch.column(len(names))):
                w = text_keys(data, offsets, k, least_plain, lengths, shared.value)
                at = pa.array(w.doc + lo)
                numbers = [w.form.astype(np.int32), w.length.astype(np.int32), w.key.view(np.int64), w.second.view(np.int64), w.begin]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(names))), *map(pa.array, numbers)], names=[*names, "form", "n", "key", "key2", "p"])

    schema = with_columns(kinds, "form int, n int, key long, key2 long, p long")
    return rows.mapInArrow(search, schema)


def _meetings(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidates joined with the items that have their window; a hot window is dealt over SALTS tasks."""
    on = ["key", "key2", "form", "n"]
    dealt = found.withColumn("__salt", F.pmod(F.xxhash64("__row", "p"), F.lit(SALTS)).cast("int"))
    spread = windows.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(spread, [*on, "__salt"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, k: int = WINDOW, least_plain: int = LEAST_PLAIN, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The columns of keep (doc_id by default), item_id, n_tokens (covered by matched windows) and n_windows for each row and item that match."""
    keep = keep or ["doc_id"]
    rows = docs.select(F.struct(*keep).alias("__keep"), F.monotonically_increasing_id().alias("__row"), F.col("text").alias("__text"))
    windows = _item_windows(benchmark, k, least_plain)
    met = _meetings(_candidates(rows, windows, k, least_plain, filter_bytes), windows)
    of = ["__row", "item", "form"]
    fresh = F.least("n", F.coalesce(F.col("p") - F.lag("p").over(W.partitionBy(*of).orderBy("p")), "n"))
    forms = met.withColumn("__new", fresh).groupBy(*of).agg(F.first("__keep").alias("__keep"), F.first("item_id").alias("item_id"), F.sum("__new").alias("t"), F.count("*").alias("w"))
    out = forms.groupBy("__row", "item").agg(F.first("__keep").alias("__keep"), F.first("item_id").alias("item_id"), F.max("t").cast("long").alias("n_tokens"), F.max("w").alias("n_windows"))
    return out.select("__keep.*", "item_id", "n_tokens", "n_windows")


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, least_plain: int = LEAST_PLAIN, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of docs that match no item, with the columns of docs."""
    keys = {"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64("text", "doc_id", F.lit(1))}  # rows of one id and text match alike
    rows = docs.select(F.struct(*docs.columns).alias("__all"), "doc_id", "text").withColumns(keys)
    windows = _item_windows(benchmark, k, least_plain)
    found = _candidates(rows.select("__k1", "__k2", F.monotonically_increasing_id().alias("__row"), "text"), windows, k, least_plain, filter_bytes)
    leaked = written(_meetings(found, windows).select("__k1", "__k2").distinct(), "leaked")
    drop_written(windows)
    return rows.join(leaked, ["__k1", "__k2"], "left_anti").select("__all.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that repeats a benchmark item, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
