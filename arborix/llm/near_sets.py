"""SimHash near-duplicates, held to the set rule: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Each set has a SimHash fingerprint, and the trie walk of simhash.py joins those
that differ in BUDGET bits at most; its components are candidates. At 0.8 a
fingerprint differs in some 10 bits, further than a walk in proportion to the
input can go, so what the budget cuts off comes from min-wise hashes: texts that
agree on all ROWS minima of one of BANDS bands. Two texts of similarity s agree on
a minimum with probability s whatever the kind of edit, so at 0.8 the bands miss
one in 300,000 pairs, and fewer above; of those the walk has its share. A band's
texts are joined to the least of them, and the components of these stars and of
the walk are the candidate groups. In a group every pair is compared by its whole
sets, save those that other links join already; groups of much text are cut into
blocks, and each pair of blocks is a task of its own. Only pairs of the similarity
asked for are links.

Shingles are compared by 64-bit hash. A text of fewer words than a shingle is one
shingle; a null text has no words, and texts without words are all alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import split_join, written
from .components import components
from .simhash import Forest, with_components

SHINGLE, SIMILARITY, BUDGET, BANDS, ROWS, BLOCK_BYTES = 5, 0.8, 6, 32, 5, 16 << 20
_FACTORS = np.random.default_rng(0x5E7).integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending in each, and how many each text has."""
    norm, starts, ends, first = tk.single_spaced(data, offsets)
    begin, doc = tk.windows(first, shingle)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    h = np.concatenate([tk.xxh64(norm, starts[begin], ends[begin + shingle - 1]), tk.xxh64(norm, starts[first[short]], ends[first[short] + counts[short] - 1])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def _digests(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each set, and its band keys, a row a set; sets without shingles have name 0 and keys of their own."""
    live = np.flatnonzero(counts)
    name, keys = np.zeros(len(counts), np.uint64), np.zeros((len(counts), BANDS), np.uint64)
    if len(live):
        at = (np.cumsum(counts) - counts)[live]
        name[live] = tk.mix(np.add.reduceat(tk.mix(h), at) + counts[live].astype(np.uint64))
        part = (h >> np.uint64(32)).astype(np.uint32)
        for b in range(BANDS):
            key = np.full(len(live), b + 1, np.uint64)
            for factor in _FACTORS[b * ROWS : (b + 1) * ROWS]:
                key = tk.mix(key * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(part * factor, at))
            keys[live, b] = key
    return name, keys


def _named_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, __k1, __k2, set (the name of the text's set), fp (the SimHash of the set), size (bytes of text) and bands."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, fps, keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros((0, BANDS), np.uint64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in tk.slices(batch.column(3)):
                h, counts = shingle_sets(data, offsets, shingle)
                name, key = _digests(h, counts)
                names.append(name), fps.append(tk.majority_bits(h, counts)), keys.append(key), sizes.append(np.diff(offsets))
            flat = np.concatenate(keys).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * BANDS), pa.array(flat.ravel()))
            named = [pa.array(np.concatenate(x).view(np.int64)) for x in (names, fps)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *named, pa.array(np.concatenate(sizes)), bands], names=["doc_id", "__k1", "__k2", "set", "fp", "size", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__k1", "__k2", "text").mapInArrow(compute, "doc_id long, __k1 long, __k2 long, set long, fp long, size long, bands array<long>")


def similar_pairs(h: np.ndarray, counts: np.ndarray, second: np.ndarray, both: bool, similarity: float) -> Forest:
    """A forest of the sets (as shingle_sets gives them) joined by pairs of the similarity; with both, only pairs of one set of second and one not."""
    n, forest = len(counts), Forest(len(counts))
    starts, owner = np.cumsum(counts) - counts, np.repeat(np.arange(n), counts)
    _, dense = np.unique(h, return_inverse=True)
    flag = np.zeros(len(dense), dtype=bool)
    for i in range(n):
        if not counts[i]:
            continue
        fits = (np.minimum(counts, counts[i]) >= similarity * np.maximum(counts, counts[i])) & (forest.root != forest.root[i])
        fits[: i + 1] = False
        if both:
            fits &= second != second[i]
        if not fits.any():
            continue
        mine = dense[starts[i] : starts[i] + counts[i]]
        flag[mine] = True
        common = np.bincount(owner[flag[dense]], minlength=n)
        flag[mine] = False
        near = np.flatnonzero(fits & (common >= similarity * (counts + counts[i] - common) * (1 - 1e-12)))
        forest.add(np.full(len(near), i), near)
    return forest


def walked_stars(sets: DataFrame, budget: int) -> DataFrame:
    """(a, b): each set joined to the least of those that links between fingerprints of the budget or less reach."""
    reached = with_components(sets.where("set <> 0").select(F.col("set").alias("doc_id"), "fp"), budget)
    return reached.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))


def band_stars(sets: DataFrame) -> DataFrame:
    """(a, b): each set joined to the least of those that share a band with it."""
    keyed = sets.where("set <> 0").select("set", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("set").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return split_join(keyed, hubs, "band", "n", sets.count() * BANDS).where("set <> hub").select(F.col("set").alias("a"), F.col("hub").alias("b"))


def similar_links(docs: DataFrame, sets: DataFrame, shingle: int, similarity: float, block_bytes: int) -> DataFrame:
    """(a, b): links between names of sets, which join the sets of similarity or more.

    docs: __k1, __k2 and text; sets: one row for each set, with __k1 and __k2 of a text that has it, fp, size and bands.
    """
    spark = docs.sparkSession
    found = components(walked_stars(sets, BUDGET).union(band_stars(sets)))
    members = found.union(found.select("root", "root").distinct()).toDF("set", "root")
    held = written(sets.select("set", "__k1", "__k2", "size").join(members, "set"), "candidates")
    blocks = held.groupBy("root").agg(F.ceil(F.sum("size") / block_bytes).cast("int").alias("blocks"), F.count("*").alias("n"))
    cut = split_join(held, blocks, "root", "n", held.count()).withColumn("blocks", F.greatest("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    whole = cut.select("set", "__k1", "__k2", "root", "blocks", mine.alias("mine")).join(docs.select("__k1", "__k2", "text"), ["__k1", "__k2"])
    dealt = whole.select("set", "root", "mine", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("set", "root", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"), "text")
    spread = dealt.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "root", "x", "y").sortWithinPartitions("root", "x", "y", "set")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: pa.Table) -> pa.RecordBatch:
            names, at = np.unique(group.column("set").to_numpy(), return_index=True)
            group = group.take(at)
            got = [shingle_sets(data, offsets, shingle) for *_, data, offsets in tk.slices(pa.concat_arrays(group.column("text").cast(pa.large_string()).chunks))]
            h, counts = (np.concatenate(x) for x in zip(*got, strict=True))
            both = group.column("x")[0].as_py() != group.column("y")[0].as_py()
            root = similar_pairs(h, counts, group.column("second").to_numpy(), both, similarity).root
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["a", "b"])

        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            root, x, y = (batch.column(c).to_numpy() for c in ("root", "x", "y"))
            new = np.flatnonzero((root[1:] != root[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for lo, hi in zip([0, *new], [*new, batch.num_rows], strict=True):
                key = (root[lo], x[lo], y[lo])
                if held and key != last:
                    yield linked(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
                last = key
        if held:
            yield linked(pa.concat_tables(held))

    return spread.mapInArrow(confirm, "a long, b long")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of least doc_id stays, and then of least hash.

    Texts are linked where their sets of shingles have the Jaccard similarity or more. A null doc_id stays only where a
    component has no other. Of identical rows one stays. block_bytes: text of one candidate group that meets in one task.
    """
    keys = {"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64("text", "doc_id", F.lit(1)), "__all": F.xxhash64(*docs.columns)}
    named = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", *(c.alias(n) for n, c in keys.items()))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__k1", "__k2")).alias("best")
    rows = written(_named_sets(named, shingle), "set-rows")
    sets = written(rows.groupBy("set").agg(best, F.first("fp").alias("fp"), F.max("size").alias("size"), F.first("bands").alias("bands")), "sets")
    links = similar_links(named, sets.select("set", "best.__k1", "best.__k2", "fp", "size", "bands"), shingle, similarity, block_bytes)
    roots = components(links).withColumnRenamed("node", "set")
    least = sets.join(roots, "set", "left").groupBy(F.coalesce("root", "set")).agg(F.min("best").alias("best"))
    # of rows with one id and text the one of least hash; they meet after each task has kept one
    unique = named.groupBy("__k1", "__k2").agg(F.min_by("__row", "__all").alias("__row"))
    return unique.join(least.select("best.__k1", "best.__k2"), ["__k1", "__k2"], "left_semi").select("__row.*")
