"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, hash of the text); a keyed
Feistel network with cycle walking permutes those numbers, and the permuted
number p gives shard p mod n and slot p div n. Anyone who knows N, the seed and
a row's number can compute its place; counts of the shards differ by one at most.

Null texts count as empty; null ids come first; identical rows get consecutive
numbers and are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written
from .textkernel import MIX, mix

ROUNDS = 6


def _round_key(seed: int, r: int) -> int:
    return (seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)


def feistel(x: np.ndarray, half_bits: int, seed: int) -> np.ndarray:
    """A keyed bijection of the numbers below 2 ** (2 * half_bits)."""
    mask, half = np.uint64((1 << half_bits) - 1), np.uint64(half_bits)
    left, right = x >> half, x & mask
    for r in range(ROUNDS):
        left, right = right, left ^ (mix(right + np.uint64(_round_key(seed, r))) & mask)
    return (left << half) | right


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each index under a keyed permutation of 0..n-1: walks the cycle until it is back below n."""
    half_bits = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    out = feistel(index.astype(np.uint64), half_bits, seed)
    while len(out_of := np.flatnonzero(out >= np.uint64(n))):
        out[out_of] = feistel(out[out_of], half_bits, seed)
    return out.astype(np.int64)


def row_numbers(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, int]:
    """df with a gapless global number __row in the order of keys, and the count of rows.

    One range shuffle; then only the count of each partition goes to the driver, one number a partition.
    """
    inner = df.withColumn("__tie", F.monotonically_increasing_id())
    ordered = inner.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    schema = T.StructType([*ordered.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__part", "__at"])
            at += n

    numbered = written(ordered.mapInArrow(number, schema), name)  # part numbers must not change when a task runs again
    counts = sorted((r[0], r[1]) for r in numbered.groupBy("__part").count().collect())
    total, offsets = 0, []
    for part, n in counts:
        offsets.append((part, total))
        total += n
    if not offsets:
        return numbered.withColumn("__row", F.lit(0).cast("long")).drop("__part", "__at"), 0
    spark = df.sparkSession
    small = F.broadcast(spark.createDataFrame(offsets, "__part int, __off long"))  # one row a partition
    return numbered.join(small, "__part").withColumn("__row", F.col("__at") + F.col("__off")).drop("__part", "__at", "__off"), total


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 7, payload: list[str] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes of text + 1), text_crc32, the columns of payload, row, shard and slot of every row."""
    payload = payload or []
    text = F.coalesce(F.col("text"), F.lit(""))
    cols = [F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("__size"), F.crc32(text.cast("binary")).alias("__crc"), F.xxhash64(text).alias("__hash")]
    narrow = docs.select(*cols, *(F.col(c).alias(f"__p_{c}") for c in payload))
    rows, total = row_numbers(narrow, ["doc_id", "__crc", "__hash"], "shard-rows")
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permuted(np.asarray(batch.column("__row")), max(total, 1), seed)
            columns = [*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "shard", "slot"])

    placed = rows.mapInArrow(place, schema)
    out = [F.col("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), *(F.col(f"__p_{c}").alias(c) for c in payload), F.col("__row").alias("row"), "shard", "slot"]
    return placed.select(*out)


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 16 shards under the law of equal row counts."""
    placed = shard_rows(table(spark, sf_dir, "documents"))
    law = [F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return placed.select("doc_id", "size", "text_crc32", *law)


def oracle(shards: int = 16, seed: int = 7) -> str:
    """The query in DuckDB's SQL: the same network in 128-bit numbers, the walk as a recursion, the checksum byte by byte."""
    low = lambda x: f"({x} & {2**64 - 1}::uhugeint)"

    def mixed(x: str) -> str:
        for shift, factor in ((32, MIX[0]), (29, MIX[1]), (32, None)):
            x = f"[xor(z, z >> {shift}) for z in [{x}]][1]"
            x = low(f"({x} * {factor}::uhugeint)") if factor else x
        return x

    # a number of 2 * half bits: (left << half) | right
    x = "x"
    for r in range(ROUNDS):
        turned = mixed(low(f"((s & mask) + {_round_key(seed, r)}::uhugeint)"))
        x = f"[((s & mask) << half) | xor(s >> half, {turned} & mask) for s in [{x}]][1]"
    bit = "select i, 0 as step, i::ubigint as c from range(256) t(i) union all select i, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from table_bits where step < 8"
    steps = [
        f"recursive table_bits as ({bit})",
        "crc_table as (select list(c order by i) as crcs from table_bits where step = 8)",
        "texts as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id nulls first) - 1 as r from documents)",
        "sums as (select r, xor(list_reduce([('0x' || h)::ubigint for h in regexp_extract_all(hex(encode(t)), '..')], lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255)::bigint + 1]), 4294967295::ubigint), 4294967295::ubigint)::bigint as text_crc32 from texts, crc_table)",
        "bits as (select greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2)::uhugeint as h, count(*)::uhugeint as n from documents)",
        "net as (select h as half, (1::uhugeint << h) - 1::uhugeint as mask, n from bits)",
        f"walk as (select r, half, mask, n, {x} as x from (select r, r::uhugeint as x, half, mask, n from texts, net) union all select r, half, mask, n, {x} from walk where x >= n)",
        f"placed as (select r, (x % {shards}::uhugeint)::int as shard, (x // {shards}::uhugeint)::bigint as slot from walk where x < n)",
    ]
    return "with " + ", ".join(steps) + " select doc_id, octet_length(encode(t))::bigint + 1 as size, text_crc32, 'rows' as law, shard, slot, null::int as grown_shard from texts join sums using (r) join placed using (r)"
