"""Resource limits: defaults, ceilings, and the strictest of what client, policy and request ask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import inventory as inv

MIB, GIB = 1 << 20, 1 << 30
# The default and the ceiling of each bound
BOUNDS = {
    "maxFiles": (100_000, 1_000_000),
    "maxFileBytes": (GIB, 2**33 - 1),
    "maxExpandedBytes": (8 * GIB, 64 * GIB),
    "maxCompressedBytes": (2 * GIB, 16 * GIB),
    "maxCompressionRatio": (200, 1000),
    "maxPathBytes": (1024, 4096),
    "maxPathSegmentBytes": (255, 255),
    "maxPathDepth": (64, 256),
    "maxConfigBytes": (64 * MIB, 256 * MIB),
    "maxManifestBytes": (4 * MIB, 4 * MIB),
    "maxSpecBytes": (MIB, 16 * MIB),
    "maxLockBytes": (16 * MIB, 64 * MIB),
    "maxReferrers": (256, 4096),
    "maxEvidenceBytes": (16 * MIB, 64 * MIB),
    "maxParallelSources": (4, 64),
}


def bounds(df: DataFrame) -> DataFrame:
    """(bound, default, ceiling) in the session of df."""
    return df.sparkSession.createDataFrame([(b, *v) for b, v in BOUNDS.items()], "bound string, default long, ceiling long")


def limit_findings(asked: DataFrame) -> DataFrame:
    """(bundle_id, bound, origin, code) of asked limits that are negative, over the ceiling, or of no known bound."""
    joined = asked.join(F.broadcast(bounds(asked)), "bound", "left")
    code = F.when(F.col("ceiling").isNull(), "unknown-bound").when(F.col("value") < 0, "negative").when(F.col("value") > F.col("ceiling"), "over-ceiling")
    return joined.select("bundle_id", "bound", "origin", code.alias("code")).where("code is not null")


def effective(asked: DataFrame) -> DataFrame:
    """(bundle_id, bound, value, origin) of every bound of each bundle; a policy can tighten and never relax.

    asked: (bundle_id, bound, value, origin, precedence); zero and null are unset. The default takes part and wins ties.
    """
    every = asked.select("bundle_id").distinct().join(F.broadcast(bounds(asked)))  # 15 rows: a bounded broadcast
    defaults = every.select("bundle_id", "bound", F.col("default").alias("value"), F.lit("default").alias("origin"), F.lit(-1).alias("precedence"))
    return inv.resolve_limits(asked.select("bundle_id", "bound", "value", "origin", "precedence").unionByName(defaults))
