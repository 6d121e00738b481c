"""Where artifacts are kept, as what a store must be able to do, and a layout folder as one that does it.

A registry is another such store; it needs a network and credentials, so it is given by who has them.
"""

from __future__ import annotations

from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import layout, sinks


class Transport(Protocol):
    """A store of blobs by digest, of manifests by tag, and of referrers by subject. All take and give tables."""

    def resolve(self, tags: DataFrame) -> DataFrame:
        """(tag, digest, code) of each wanted tag."""

    def fetch(self, descriptors: DataFrame) -> DataFrame:
        """(digest, content, code) of descriptors (digest, size): content only where it is what the digest says."""

    def push(self, blobs: DataFrame, manifests: DataFrame, referrers: DataFrame | None = None) -> DataFrame:
        """(digest, state) of the blobs, after which the manifests and referrers can be found."""

    def referrers(self, subjects: DataFrame, artifact_type: str | None = None) -> DataFrame:
        """Catalogue rows of what is attached to the subjects (digest)."""


class LayoutTransport(NamedTuple):
    """A layout folder that driver and executors share."""

    spark: SparkSession
    root: str

    def _catalog(self) -> DataFrame:
        return sinks.catalog_of(self.spark, self.root)

    def resolve(self, tags: DataFrame) -> DataFrame:
        return layout.find_tags(self._catalog(), tags.select(F.lit(self.root).alias("layout"), "tag")).select("tag", "digest", "code")

    def fetch(self, descriptors: DataFrame) -> DataFrame:
        blobs = layout.read_blobs(self.spark, self.root).withColumn("layout", F.lit(self.root))
        wanted = descriptors.select(F.lit(self.root).alias("layout"), "digest", "size")
        wrong = layout.blob_faults(wanted, blobs).select("digest", "code")
        held = wanted.join(wrong, "digest", "left").join(blobs.select("digest", "content"), "digest", "left")
        return held.select("digest", F.when(F.col("code").isNull(), F.col("content")).alias("content"), F.coalesce("code", F.lit("ok")).alias("code"))

    def push(self, blobs: DataFrame, manifests: DataFrame, referrers: DataFrame | None = None) -> DataFrame:
        return sinks.publish(blobs, manifests, self.root, referrers)

    def referrers(self, subjects: DataFrame, artifact_type: str | None = None) -> DataFrame:
        return layout.referrers_of(self._catalog(), subjects.select(F.lit(self.root).alias("layout"), F.col("digest").alias("subject")), artifact_type)
