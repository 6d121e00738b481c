"""Semantic validators: functions over single files whose findings and failures become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gives (code, message) pairs for a file's path and content; none: it holds.
Validator = Callable[[str, bytes], list[tuple[str, str]]]
_NAMES = ["bundle_id", "validator", "path", "code", "message"]


def run_validators(files: DataFrame, validators: dict[str, Validator]) -> DataFrame:
    """(bundle_id, validator, path, code, message): every validator sees every file.

    One that raises fails for that file with the code validator-failed, and the others still run. No file waits for another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bundle, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, check in validators.items():
                    try:
                        out += [(bundle, name, path, code, message) for code, message in check(path, content)]
                    except Exception as e:  # noqa: BLE001: whatever a validator raises is its failure
                        out.append((bundle, name, path, "validator-failed", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(5)], names=_NAMES)

    return files.select("bundle_id", "path", "content").mapInArrow(run, ", ".join(f"{n} string" for n in _NAMES))


def statuses(bundles: DataFrame, found: DataFrame, validators: dict[str, Validator]) -> DataFrame:
    """(bundle_id, status): pass or fail, and not-evaluated where there is no validator."""
    bad = found.select("bundle_id").distinct().withColumn("status", F.lit("fail"))
    otherwise = F.lit("pass" if validators else "not-evaluated")
    return bundles.select("bundle_id").distinct().join(bad, "bundle_id", "left").select("bundle_id", F.coalesce("status", otherwise).alias("status"))
