"""Catalogues of artifact layouts and the blobs they name, as tables.

A catalogue is (layout, digest, media_type, size, artifact_type, tag, subject);
blobs are (layout, digest, content). A reader may take many layouts at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digests

CATALOG = ["layout", "digest", "media_type", "size", "artifact_type", "tag", "subject"]
TAG_ANNOTATION = "org.opencontainers.image.ref.name"  # a fixed value of the public image specification
_INDEX = "manifests array<struct<mediaType:string, digest:string, size:long, artifactType:string, annotations:map<string,string>, subject:struct<digest:string>>>"
MOST_INDEX_BYTES = 1 << 20


def read_catalog(spark: SparkSession, *paths: str) -> DataFrame:
    """The catalogues of layout directories (patterns allowed); an index of more than 1 MiB gives a row without digest."""
    files = spark.read.format("binaryFile").load([f"{p.rstrip('/')}/index.json" for p in paths])
    text = F.when(F.col("length") <= MOST_INDEX_BYTES, F.col("content").cast("string"))
    rows = files.select(F.regexp_replace("path", r"/index\.json\z", "").alias("layout"), F.from_json(text, _INDEX).alias("index"))
    return rows.select("layout", F.explode_outer("index.manifests").alias("m")).select("layout", "m.digest", F.col("m.mediaType").alias("media_type"), "m.size", F.col("m.artifactType").alias("artifact_type"), F.try_element_at("m.annotations", F.lit(TAG_ANNOTATION)).alias("tag"), F.col("m.subject.digest").alias("subject"))


def read_blobs(spark: SparkSession, *paths: str) -> DataFrame:
    """(layout, digest, size, content) of every blob; content is read only where it is selected."""
    files = spark.read.format("binaryFile").load([f"{p.rstrip('/')}/blobs/sha256/*" for p in paths])
    return files.select(F.regexp_extract("path", r"\A(.*)/blobs/sha256/[^/]*\z", 1).alias("layout"), F.concat(F.lit("sha256:"), F.substring_index("path", "/", -1)).alias("digest"), F.col("length").alias("size"), "content")


def blob_faults(descriptors: DataFrame, blobs: DataFrame) -> DataFrame:
    """(layout, digest, code) of descriptors whose blob is missing, or differs in size, then in content."""
    got = blobs.select("layout", "digest", F.octet_length("content").cast("long").alias("got_size"), digests.sha256_text(F.col("content")).alias("got_digest"))
    code = F.when(F.col("got_size").isNull(), "not-found").when(F.col("got_size") != F.col("size"), "size-mismatch").when(F.col("got_digest") != F.col("digest"), "digest-mismatch")
    return descriptors.join(got, ["layout", "digest"], "left").select("layout", "digest", code.alias("code")).where("code is not null")


def unwritten(blobs: DataFrame, present: DataFrame) -> DataFrame:
    """Blobs that a layout doesn't hold yet, each once; one that is there counts only if it hashes to its name."""
    sound = present.where(digests.sha256_text(F.col("content")) == F.col("digest")).select("layout", "digest")
    return blobs.dropDuplicates(["layout", "digest"]).join(sound, ["layout", "digest"], "left_anti")


def put_manifests(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The catalogue after the rows of new, in order of their column seq: each takes the place of rows with its tag, or its digest and tag."""
    every = catalog.select(*CATALOG, F.lit(-1).cast("long").alias("seq")).unionByName(new.select(*CATALOG, F.col("seq").cast("long")))
    tagged = every.where("tag is not null")
    latest = tagged.withColumn("__n", F.row_number().over(W.partitionBy("layout", "tag").orderBy(F.desc("seq"), "digest"))).where("__n = 1")
    loose = every.where("tag is null").dropDuplicates(["layout", "digest", "subject"])
    return latest.select(*CATALOG).unionByName(loose.select(*CATALOG))


def put_referrers(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Referrers added once for each digest and subject; adding them again changes nothing."""
    fresh = new.select(*CATALOG).dropDuplicates(["layout", "digest", "subject"])
    return catalog.select(*CATALOG).unionByName(fresh.join(catalog.select("layout", "digest", "subject"), ["layout", "digest", "subject"], "left_anti").select(*CATALOG))


def find_tags(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(layout, tag, digest, code) of each wanted (layout, tag): ok, not-found, or invalid-artifact where several manifests claim it."""
    held = catalog.where("tag is not null").groupBy("layout", "tag").agg(F.count("*").alias("n"), F.min("digest").alias("digest"))
    code = F.when(F.col("n").isNull(), "not-found").when(F.col("n") > 1, "invalid-artifact").otherwise("ok")
    return wanted.join(held, ["layout", "tag"], "left").select("layout", "tag", F.when(code == "ok", F.col("digest")).alias("digest"), code.alias("code"))


def referrers_of(catalog: DataFrame, subjects: DataFrame, artifact_type: str | None = None) -> DataFrame:
    """Referrers of the subjects (layout, subject), one row each; of one type, if given."""
    rows = catalog.where("subject is not null")
    rows = rows.where(F.col("artifact_type") == artifact_type) if artifact_type else rows
    return rows.join(subjects.select("layout", "subject").distinct(), ["layout", "subject"], "left_semi").select(*CATALOG)


def copied(catalog: DataFrame, subjects: DataFrame, target: str) -> DataFrame:
    """The rows that a copy of the subjects (layout, digest) to layout target adds: the manifests and all their referrers."""
    chosen = subjects.select("layout", "digest").distinct()
    own = catalog.where("subject is null").join(chosen, ["layout", "digest"], "left_semi")
    attached = referrers_of(catalog, chosen.withColumnRenamed("digest", "subject"))
    return own.select(*CATALOG).unionByName(attached).withColumn("layout", F.lit(target)).select(*CATALOG)
