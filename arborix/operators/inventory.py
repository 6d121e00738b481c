"""Inventories - (bundle_id, path, mode, size, digest), many bundles to a table - and what is computed from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digests, paths


def whole_bundles(rows: DataFrame, *order: str) -> DataFrame:
    """rows with each bundle whole in one partition and in order there, whatever lies below.

    Dealt by a hash of the key: a repartition by the key itself is dropped by Spark where a join or sum by that key lies
    below, and that join may then be read in pieces, a bundle in several tasks.
    """
    return rows.repartition(F.xxhash64("bundle_id")).sortWithinPartitions("bundle_id", *order)


def tree_digest(inventory: DataFrame, domain: str = digests.TREE_DOMAIN) -> DataFrame:
    """(bundle_id, n_files, total_size, tree_digest): the digest of the records in path order.

    Records of a bundle meet in one cell; tree_digest_stream() is for bundles of hundreds of MB of paths.
    """
    rec = digests.record_hex(F.col("path"), F.col("mode"), F.col("size"), F.col("digest"))
    grouped = inventory.select("bundle_id", "path", "size", rec.alias("rec")).groupBy("bundle_id")
    out = grouped.agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.expr("listagg(rec, '') within group (order by path)").alias("__all"))
    stream = F.concat(F.lit(domain.encode().hex()), digests.big_endian(F.col("n_files"), 8), F.col("__all"))
    return out.select("bundle_id", "n_files", "total_size", digests.sha256_text(F.unhex(stream)).alias("tree_digest"))


def tree_digest_stream(inventory: DataFrame, domain: str = digests.TREE_DOMAIN) -> DataFrame:
    """(bundle_id, tree_digest) with constant memory: records are sorted by Spark and hashed as they pass."""
    counts = inventory.groupBy("bundle_id").agg(F.count("*").alias("n"))
    rec = F.unhex(digests.record_hex(F.col("path"), F.col("mode"), F.col("size"), F.col("digest")))
    rows = inventory.select("bundle_id", "path", rec.alias("rec")).join(counts, "bundle_id")
    rows = whole_bundles(rows, "path").select("bundle_id", "n", "rec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, state, done = None, None, []
        for batch in batches:
            names, counts, recs = batch.columns
            names = names.to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if state is None or names[lo] != bundle:
                    if state is not None:
                        done.append((bundle, "sha256:" + state.hexdigest()))
                    bundle, state = names[lo], hashlib.sha256(domain.encode() + counts[lo].as_py().to_bytes(8, "big"))
                state.update(b"".join(recs.slice(lo, hi - lo).to_pylist()))  # the records of a run at once
        if state is not None:
            done.append((bundle, "sha256:" + state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["bundle_id", "tree_digest"])

    return rows.mapInArrow(run, "bundle_id string, tree_digest string")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for each path that changed: added, removed, modified (content), mode-changed; content wins over mode."""
    cols = ["mode", "size", "digest"]
    a = left.select("bundle_id", "path", *(F.col(c).alias(f"old_{c}") for c in cols))
    b = right.select("bundle_id", "path", *(F.col(c).alias(f"new_{c}") for c in cols))
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").when(F.col("old_digest") != F.col("new_digest"), "modified").when(F.col("old_mode") != F.col("new_mode"), "mode-changed")
    return a.join(b, ["bundle_id", "path"], "full_outer").withColumn("change", change).where(F.col("change").isNotNull())


def diff_summary(changes: DataFrame) -> DataFrame:
    """Counts of each kind of change by bundle."""
    return changes.groupBy("bundle_id").agg(*(F.count_if(F.col("change") == k).alias(k.replace("-", "_")) for k in ("added", "removed", "modified", "mode-changed")))


def compose(sources: DataFrame) -> DataFrame:
    """Disjoint union of mounted sources: (bundle_id, path, source, source_path, mode, size, digest) from rows with source, mount, path; paths in NFC."""
    return sources.select("bundle_id", paths.nfc(paths.mounted(F.col("mount"), F.col("path"))).alias("path"), "source", F.col("path").alias("source_path"), "mode", "size", "digest")


def findings(df: DataFrame, stage: str, code: str, path: Column, message: Column) -> DataFrame:
    return df.select("bundle_id", F.lit(stage).alias("stage"), F.lit(code).alias("code"), path.alias("path"), message.alias("message"))


def duplicate_paths(composed: DataFrame) -> DataFrame:
    """Paths that more than one row claims, with the sources that do."""
    often = composed.groupBy("bundle_id", "path").agg(F.count("*").alias("n")).where("n > 1").select("bundle_id", "path")
    claimed = composed.select("bundle_id", "path", "source").join(often, ["bundle_id", "path"]).distinct()
    grouped = claimed.groupBy("bundle_id", "path").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))
    return findings(grouped, "compose", "duplicate-path", F.col("path"), F.col("sources"))


def limit_findings(composed: DataFrame, limits: DataFrame) -> DataFrame:
    """Bundles with more files or bytes, and files larger, than their effective limits (bundle_id, bound, value) allow; a bundle without a limit has none."""
    of = lambda bound: limits.where(F.col("bound") == bound).select("bundle_id", F.col("value").alias("most"))
    sums = composed.groupBy("bundle_id").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("decimal(38,0)")).alias("total"))
    over = lambda df, bound, column, path: findings(df.join(of(bound), "bundle_id").where(F.col(column) > F.col("most")), "limits", "limit-exceeded", path, F.lit(bound))
    return over(sums, "maxFiles", "n", F.lit("")).unionByName(over(sums, "maxExpandedBytes", "total", F.lit(""))).unionByName(over(composed, "maxFileBytes", "size", F.col("path")))


def file_directory_clashes(composed: DataFrame) -> DataFrame:
    """Files at a path that another file needs as a directory."""
    needed = composed.select("bundle_id", F.explode(paths.parents(F.col("path"))).alias("path")).distinct()
    return findings(composed.join(needed, ["bundle_id", "path"], "left_semi").select("bundle_id", "path").distinct(), "compose", "file-directory", F.col("path"), F.lit("a file and a directory"))


def fold_clashes(composed: DataFrame) -> DataFrame:
    """Different files or directories that case folding makes one; the least name stands for them."""
    nodes = composed.select("bundle_id", "path").union(composed.select("bundle_id", F.explode(paths.parents(F.col("path"))))).distinct()
    grouped = nodes.groupBy("bundle_id", paths.fold_key("path").alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max("path").alias("other"))
    return findings(grouped.where("n > 1"), "compose", "case-collision", F.col("path"), F.col("other"))


def missing(declared: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """Declared and not delivered; the other way round, what is extra."""
    return declared.join(delivered, keys, "left_anti")


def order_faults(rows: DataFrame, group: list[str], position: str, key: str) -> DataFrame:
    """Rows whose key doesn't exceed the one before it: duplicate or unsorted."""
    before = F.lag(key).over(W.partitionBy(*group).orderBy(position))
    fault = F.when(before == F.col(key), "duplicate").when(before > F.col(key), "unsorted")
    return rows.withColumn("fault", fault).where(F.col("fault").isNotNull())


def resolve_limits(limits: DataFrame) -> DataFrame:
    """From (bundle_id, bound, value, origin, precedence): the least positive value of each bound and where it comes from; on a tie the first origin."""
    least = F.min(F.struct("value", "precedence", "origin"))
    return limits.where("value > 0").groupBy("bundle_id", "bound").agg(least.alias("m")).select("bundle_id", "bound", "m.value", "m.origin")


def over_ratio(sizes: DataFrame, limit: int) -> DataFrame:
    """Rows whose expanded size divided by the compressed one exceeds the limit; none where either isn't positive."""
    return sizes.where("compressed > 0 and expanded > 0").withColumn("ratio", F.expr("expanded div compressed")).where(F.col("ratio") > limit)
