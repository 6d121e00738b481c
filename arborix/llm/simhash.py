"""SimHash near-duplicates by a binary trie self-join.

The fingerprints form a binary trie. Pairs of its nodes are walked together from
the root; each level adds the bits in which the two paths differ, and a pair is
dropped as soon as that exceeds the budget. To spread the walk over a cluster,
the bits are cut into budget + 2 parts: two fingerprints within the budget agree
on two parts at least, so for each pair of parts a trie is built whose paths begin
with these, and the two meet below the same subtrie of one of them. With a budget
of 4 a subtrie's key has 21 bits or more, so subtries stay small as the input
grows; one that holds too many fingerprints is cut into blocks, and each pair of
blocks is its own key. Keys reach a task in order and are walked as they come, so
a task holds some keys and not a whole partition. Within a key only a spanning
forest of the links is kept.

Null texts have no words; texts without words have fingerprint zero; equal
fingerprints are one node, so copies are never paired with each other and repeated
rows only repeat in the result. An empty table gives no rows. Of equal least ids
any is the same id. A very long text is hashed in one piece, in memory in
proportion to it. Columns other than doc_id and text are not read. A fingerprint
or a component that a third of all rows share is joined by broadcast (split_join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import split_join, table, written
from .components import components

LEAF_PAIRS, FRONTIER, HELD, PARTITION_ROWS = 16, 1 << 16, 1 << 17, 1 << 21


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp, the SimHash (a signed long) of every whole text over its word shingles, repeats included."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in tk.slices(batch.column(1)):
                norm, starts, ends, first = tk.single_spaced(data, offsets)
                begin, doc = tk.windows(first, shingle)
                counts = np.diff(first)
                short = np.flatnonzero((counts > 0) & (counts < shingle))
                h = np.concatenate([tk.xxh64(norm, starts[begin], ends[begin + shingle - 1]), tk.xxh64(norm, starts[first[short]], ends[first[short] + counts[short] - 1])])
                doc = np.concatenate([doc, short])
                order = np.argsort(doc, kind="stable")
                h, doc = h[order], doc[order]
                out.append(tk.majority_bits(h, np.bincount(doc, minlength=len(counts))).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compute, "doc_id long, fp long")


def _expand(lo: np.ndarray, hi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each two ranges."""
    na, nb = hi - lo, bhi - blo
    size = na * nb
    rep = np.repeat(np.arange(len(lo)), size)
    off = np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size)
    return lo[rep] + off // nb[rep], blo[rep] + off % nb[rep]


def trie_links(values: np.ndarray, roots: list[np.ndarray], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of values that differ in budget bits at most, for each pair of subtries in roots.

    roots: the arrays (lo, hi, lo2, hi2) of index ranges; values ascend in each range. Where the ranges are the same, a pair comes once.
    """
    pending = [(0, *(x.astype(np.int64) for x in roots), np.zeros(len(roots[0]), dtype=np.int64))]
    while pending:
        level, *arrays = pending.pop()
        if len(arrays[0]) > FRONTIER:
            pending += [(level, *(x[i : i + FRONTIER] for x in arrays)) for i in range(0, len(arrays[0]), FRONTIER)]
            continue
        lo, hi, blo, bhi, err = arrays
        leaf = ((hi - lo) * (bhi - blo) <= LEAF_PAIRS) | (level == 64)
        if leaf.any():
            i, j = _expand(lo[leaf], hi[leaf], blo[leaf], bhi[leaf])
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            yield i[near], j[near]
            lo, hi, blo, bhi, err = (x[~leaf] for x in arrays)
        if len(lo) == 0:
            continue
        bit = np.uint64(1 << (63 - level))
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
        mid = _split(values, lo, hi, bit, above)
        bmid = _split(values, blo, bhi, bit, above)
        same = lo == blo
        kids = [(lo, mid, blo, bmid, err), (mid, hi, bmid, bhi, err), (lo, mid, bmid, bhi, err + 1)]
        kids.append(tuple(x[~same] for x in (mid, hi, blo, bmid, err + 1)))
        joined = [np.concatenate(x) for x in zip(*kids, strict=True)]
        live = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= budget)
        pending.append((level + 1, *(x[live] for x in joined)))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64, above: np.uint64) -> np.ndarray:
    """First index of each range whose value has the bit, by a binary search in all ranges at once."""
    target = (values[lo] & above) | bit
    a, b = lo.copy(), hi.copy()
    while len(live := np.flatnonzero(a < b)):
        m = (a[live] + b[live]) >> 1
        less = values[m] < target[live]
        a[live[less]] = m[less] + 1
        b[live[~less]] = m[~less]
    return a


class Forest:
    """Union-find over 0..n-1 that takes links by the array."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _parts(budget: int) -> list[tuple[int, int]]:
    """The 64 bits in budget + 2 parts: lowest bit and width of each."""
    cuts = [round(64 * i / (budget + 2)) for i in range(budget + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _turned(fp: np.ndarray, kind: np.ndarray, parts: list[tuple[int, int]], pairs: list[tuple[int, int]]) -> np.ndarray:
    """Each fingerprint with the bits of its kind's two parts moved to the top; distances stay."""
    out = np.zeros_like(fp)
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        v = fp[mine]
        order = [*pairs[k], *(i for i in range(len(parts)) if i not in pairs[k])]
        value = np.zeros_like(v)
        for i in order:
            low, width = parts[i]
            value = (value << np.uint64(width)) | ((v >> np.uint64(low)) & np.uint64((1 << width) - 1))
        out[mine] = value
    return out


def near_links(fps: DataFrame, budget: int = 4, block: int = 1 << 16) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp within the budget, as a spanning forest of each subtrie.

    block: fingerprints of one subtrie that meet in one task; larger subtries are cut into such blocks and all pairs of blocks are walked.
    """
    spark = fps.sparkSession
    parts = _parts(budget)
    pairs = [(i, j) for i in range(len(parts)) for j in range(i)]
    bits = lambda i: F.shiftrightunsigned("fp", parts[i][0]).bitwiseAND((1 << parts[i][1]) - 1)
    tops = [F.shiftleft(bits(i), parts[j][1]).bitwiseOR(bits(j)).bitwiseOR(F.lit(k << 48)) for k, (i, j) in enumerate(pairs)]
    keyed = fps.select("fp", F.explode(F.array(*tops)).alias("top"))
    n = fps.count()
    if n > block:
        # at most n / block rows a kind
        large = F.broadcast(keyed.groupBy("top").count().where(F.col("count") > block).select("top", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
        cut = keyed.join(large, "top", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        cut = keyed.withColumn("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = cut.select("fp", "top", mine.alias("mine"), meets)
    dealt = dealt.select("fp", "top", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(pairs) * n // PARTITION_ROWS, 1)
    spread = dealt.repartition(tasks, "top", "x", "y").sortWithinPartitions("top", "x", "y")

    def link(t: pa.Table) -> pa.RecordBatch:
        fp, top, x, y, second = (t.column(c).to_numpy() for c in ("fp", "top", "x", "y", "second"))
        fp = fp.view(np.uint64)
        value = _turned(fp, top >> 48, parts, pairs)
        order = np.lexsort((value, second, y, x, top))
        fp, top, x, y, second, value = (v[order] for v in (fp, top, x, y, second, value))
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (top[1:] != top[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(fp))
        firsts = lo + np.add.reduceat((~second).astype(np.int64), lo)
        self_join = x[lo] == y[lo]
        roots = [lo, np.where(self_join, hi, firsts), np.where(self_join, lo, firsts), hi]
        some = (roots[1] > roots[0]) & (roots[3] > roots[2]) & (hi - lo > 1)
        forest = Forest(len(fp))
        for i, j in trie_links(value, [r[some] for r in roots], budget):
            forest.add(i, j)
        moved = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[forest.root[moved]].view(np.int64))], names=["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_keys(batches, ["top", "x", "y"], HELD):
            yield link(group)

    return spread.mapInArrow(walk, "a long, b long")


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of about `rows` rows, cut only between keys: what is held at once is that and the largest key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        new = np.zeros(n, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        if (cut := int(np.flatnonzero(new)[-1]) if new.any() else 0):
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links) of every row of docs.

    A null doc_id never is a component_id unless the component has no other; repeated rows are kept.
    """
    return with_components(written(fingerprints(docs, shingle), "fp"), budget)


def with_components(fps: DataFrame, budget: int = 4) -> DataFrame:
    """fps (doc_id, fp) and component_id, by the trie walk over its distinct fingerprints. fps is read more than once."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fp-nodes")
    roots = components(near_links(nodes.select("fp"), budget)).withColumnRenamed("node", "fp")
    linked = written(nodes.join(roots, "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "fp-roots")
    size = linked.agg(F.count("*").alias("fps"), F.sum("n").alias("rows")).first()
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    placed = written(split_join(linked.select("fp", "n", "root"), least, "root", "members", size.fps).select("fp", "n", "component_id"), "fp-components")
    return split_join(fps, placed, "fp", "n", size.rows or 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
