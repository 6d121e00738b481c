"""Directories as inventories: contents read by Spark, modes and kinds by a listing on the executors.

A directory must be on storage that driver and executors share.
"""

from __future__ import annotations

import os
import stat
import unicodedata
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, globs, paths

POINTER = b"version https://git-lfs.github.com/spec/"  # a fixed value of the public format
BATCH_BYTES = 4 << 20
_LISTED = "bundle_id string, root string, path string, kind string, mode int, size long, nfc string"


def _walk(bundle: str, root: str) -> Iterator[tuple]:
    """Entries below root as the system gives them, so that no folder's entries are held; never following a link."""
    todo = [root]
    while todo:
        with os.scandir(todo.pop()) as found:
            for e in found:
                info = e.stat(follow_symlinks=False)
                kind = "file" if stat.S_ISREG(info.st_mode) else "directory" if stat.S_ISDIR(info.st_mode) else "other"
                if kind == "directory":
                    todo.append(e.path)
                else:
                    path = os.path.relpath(e.path, root).replace(os.sep, "/")
                    yield bundle, root, path, kind, stat.S_IMODE(info.st_mode), info.st_size, unicodedata.normalize("NFC", path)


def listing(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(bundle_id, root, path, kind, mode, size, nfc) of what is in each root; kinds are file and other (links, devices, pipes).

    nfc is the normal form of path, made here: made by a function of its own, it takes each task a second Python worker.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _LISTED.split(", ")]
        for frame in frames:
            for bundle, root in zip(frame["bundle_id"], frame["root"], strict=True):
                held = []
                for row in _walk(bundle, root):
                    held.append(row)
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                yield pd.DataFrame(held, columns=columns)

    named = pa.table({"bundle_id": pa.array(roots, pa.string()), "root": pa.array([str(Path(r).resolve()) for r in roots.values()], pa.string())})
    rows = spark.createDataFrame(named)  # a list would be read by Python workers of its own
    return rows.repartition(max(len(roots), 1)).mapInPandas(run, _LISTED)


def read_directories(spark: SparkSession, roots: dict[str, str], include: list[str] | None = None, exclude: list[str] | None = None, max_file_bytes: int = 1 << 30, limits: tuple[int, int, int] = (1024, 255, 64), max_files: int = 1_000_000, max_bytes: int = 64 << 30) -> tuple[DataFrame, DataFrame]:
    """((bundle_id, path, mode, content), findings (bundle_id, path, code)) of directories.

    Patterns are tested before a file is read. Findings: unsafe-path and limit-exceeded of paths, unsupported-file for what is
    no regular file, limit-exceeded for a file that is too long and for a bundle of too many files or bytes (which isn't read at
    all), not-found for an empty selection, source-changed for a file that isn't as long as listed. A file with a finding isn't
    among the files; findings read the files once more, to tell whether they changed.
    """
    found = listing(spark, roots).withColumns({"__name": F.concat_ws("/", "root", "path"), "path": F.col("nfc")})
    chosen = found.where(globs.selected(F.col("path"), include, exclude))
    by_path = paths.path_code(F.col("path"), *limits)
    code = F.when(by_path != "ok", by_path).when(F.col("kind") != "file", "unsupported-file").when(F.col("size") > max_file_bytes, "limit-exceeded")
    judged = chosen.withColumn("code", code)
    sums = judged.where("code is null").groupBy("bundle_id").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    over = sums.where((F.col("n") > max_files) | (F.col("total") > max_bytes)).select("bundle_id")
    spread = judged.where("code is null").join(over, "bundle_id", "left_anti").repartition("bundle_id", "path")
    read = spread.select("bundle_id", "path", paths.normal_mode(F.col("mode")).alias("mode"), F.col("__name").alias("name"), "size").mapInArrow(_contents, "bundle_id string, path string, mode int, content binary, code string")
    bundles = spark.createDataFrame([(b,) for b in roots], "bundle_id string")
    empty = bundles.join(chosen, "bundle_id", "left_anti").select("bundle_id", F.lit("").alias("path"), F.lit("not-found").alias("code"))
    parts = [judged.where("code is not null").select("bundle_id", "path", "code"), empty, over.select("bundle_id", F.lit("").alias("path"), F.lit("limit-exceeded").alias("code")), read.where("code is not null").select("bundle_id", "path", "code")]
    return read.where("code is null").drop("code"), reduce(DataFrame.unionByName, parts)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files named, read to one byte beyond the size listed, in batches of BATCH_BYTES or one file."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bundle_id", "path", "mode", "content", "code"])

    held, size = [], 0
    for names in batches:
        for bundle, path, mode, name, listed in zip(*(c.to_pylist() for c in names.columns), strict=True):
            try:
                with open(name, "rb") as f:
                    data = f.read(listed + 1)
            except OSError:
                data = None
            same = data is not None and len(data) == listed
            held.append((bundle, path, mode, data if same else None, None if same else "source-changed"))
            size += len(data or b"")
            data = None  # what is sent on isn't held twice
            if size >= BATCH_BYTES:
                full, held, size = batch(held), [], 0
                yield full
                del full
    if held:
        yield batch(held)


def is_pointer(content: Column) -> Column:
    """The stand-in that large-file storage leaves for a file: a short text that begins with a fixed line."""
    return (F.octet_length(content) <= 1024) & (F.substring(content, 1, len(POINTER)) == F.lit(POINTER))


def changed(claimed: DataFrame, computed: DataFrame) -> DataFrame:
    """Sources (bundle_id, source, tree_digest) whose recomputed digest isn't the one claimed."""
    got = computed.select("bundle_id", "source", F.col("tree_digest").alias("computed"))
    return claimed.join(got, ["bundle_id", "source"], "left").where(~F.col("tree_digest").eqNullSafe(F.col("computed")) | ~digests.digest_code(F.col("tree_digest")).eqNullSafe("ok"))
