"""Bounded samples of labelled rows, shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVEL = 16  # bits of the hash that one pass looks at


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sampled(df: DataFrame, most: int, *key: str) -> DataFrame:
    """All rows where they are `most` or fewer, else the `most` rows whose hash of the key is least.

    The key should name every column that matters: rows of one key count as alike, and any of them may stand for another,
    so a key that a third of all rows share takes its share of the sample and no more. The hash is cut level by level by
    counts of 2 ** 16 buckets, so the rows are chosen by a filter on the scan; only those of the last bucket that doesn't
    fit whole are sorted. The same rows are chosen however the table is split.
    """
    h = F.xxhash64(*key)
    taken, inside, room = F.lit(False), F.lit(True), most
    for level in range(1, 64 // _LEVEL + 1):
        part = F.shiftrightunsigned(h, 64 - _LEVEL * level).bitwiseAND((1 << _LEVEL) - 1)
        counts = sorted((r.part, r.n) for r in df.where(inside).groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
        if sum(n for _, n in counts) <= room:
            return df.where(taken | inside)
        for at, n in counts:
            if n > room:
                break
            room -= n
        taken, inside = taken | (inside & (part < at)), inside & (part == at)
        if n <= most or not room:
            break
    return df.where(taken).unionByName(df.where(inside).orderBy(h).limit(room)) if room else df.where(taken)


def bounded(df: DataFrame, most: int, *key: str) -> list:
    """The rows of sampled(), in the order of the key's hash."""
    return [r["__row"] for r in sorted(sampled(df, most, *key).select(F.xxhash64(*key).alias("__h"), F.struct(*df.columns).alias("__row")).collect(), key=lambda r: r["__h"])]
