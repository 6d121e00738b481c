"""A bundle as it lies in a layout, from its manifest to its files: fetched by digests and held against itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..sources import layout
from ..sources.stage import written
from . import archives, evidence
from . import documents as docs


def _fetched(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """wanted (bundle_id, layout, digest, size or null) with content, and the code of what is wrong with the blob."""
    got = blobs.select("layout", "digest", F.octet_length("content").cast("long").alias("got_size"), digests.sha256_text(F.col("content")).alias("got_digest"), "content")
    code = F.when(F.col("got_size").isNull(), "not-found").when(F.col("size").isNotNull() & (F.col("got_size") != F.col("size")), "size-mismatch").when(F.col("got_digest") != F.col("digest"), "digest-mismatch")
    return wanted.join(got, ["layout", "digest"], "left").select("bundle_id", "layout", "digest", "size", code.alias("code"), F.when(code.isNull(), F.col("content")).alias("content"))


def _blob_findings(fetched: DataFrame, step: str) -> DataFrame:
    return fetched.where("code is not null").select("bundle_id", F.lit(step).alias("step"), "code", F.lit("").alias("path"), F.col("digest").alias("message"))


def _steps(found: DataFrame, step: str) -> DataFrame:
    return found.select("bundle_id", F.lit(step).alias("step"), "code", "path", "message")


def manifests_of(subjects: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fetched, parsed) manifests of the subjects (bundle_id, layout, digest)."""
    wanted = subjects.select("bundle_id", "layout", "digest", F.lit(None).cast("long").alias("size"))
    fetched = _fetched(wanted, blobs)
    texts = fetched.where("content is not null").select("bundle_id", F.col("content").cast("string").alias("text"))
    return fetched, docs.parse(texts, docs.MANIFEST)


def _named(parsed: DataFrame, subjects: DataFrame, what: str) -> DataFrame:
    """(bundle_id, layout, digest, size) of the config, or the only layer, that sound manifests name."""
    of = F.col("doc.config") if what == "config" else F.col("doc.layers")[0]
    named = parsed.select("bundle_id", of.alias("d")).select("bundle_id", "d.digest", "d.size")
    return named.join(subjects.select("bundle_id", "layout"), "bundle_id")


def subject_findings(subjects: DataFrame, blobs: DataFrame, kinds: docs.Kinds = docs.Kinds(), domain: str = digests.TREE_DOMAIN, payload: bool = True) -> DataFrame:
    """(bundle_id, step, code, path, message) of everything wrong with the subjects (bundle_id, layout, digest); none: each agrees with itself.

    The steps are manifest, config, layer and files; one that a step before has a finding on isn't taken. Each blob is named
    by the document before it and must hash to that name. Without payload the layer isn't read. Each step's documents are
    written before they are checked, so that a check doesn't fetch and parse them anew.
    """
    fetched, parsed = manifests_of(subjects, blobs)
    parsed = written(parsed, "manifests")
    wrong = written(docs.manifest_findings(parsed, kinds), "manifest-findings")
    sound = parsed.join(wrong.select("bundle_id"), "bundle_id", "left_anti")
    config = written(_fetched(_named(sound, subjects, "config"), blobs), "configs")
    texts = config.where("content is not null").select("bundle_id", F.col("content").cast("string").alias("text"))
    configs = written(docs.parse(texts, docs.CONFIG), "parsed-configs")
    read = configs.where("code = 'ok'")
    heads = read.select("bundle_id", F.col("doc.schemaVersion").alias("schema_version"), F.col("doc.format").alias("format"), F.col("doc.treeDigest").alias("tree_digest"), F.col("doc.fileCount").alias("file_count"), F.col("doc.totalSize").alias("total_size"))
    entries = docs.config_entries(read)
    inconsistent = written(docs.config_findings(heads, entries, kinds, domain), "config-findings")
    unread = configs.where("code <> 'ok'").select("bundle_id", "code", F.lit("").alias("path"), F.lit("not a strict document").alias("message"))
    parts = [_blob_findings(fetched, "manifest"), _steps(wrong, "manifest"), _blob_findings(config, "config"), _steps(unread, "config"), _steps(inconsistent, "config")]
    if payload:
        good = heads.select("bundle_id").join(inconsistent.select("bundle_id").distinct(), "bundle_id", "left_anti")
        wanted = written(_named(sound.join(good, "bundle_id", "left_semi"), subjects, "layer"), "layers-wanted")
        layer = _fetched(wanted, blobs)
        parts.append(_blob_findings(layer, "layer"))
        packed = layer.where("content is not null").select("bundle_id", F.lit(0).alias("part"), F.col("content").alias("data"))
        read_back = written(archives.entries(packed), "entries")
        want = entries.join(read_back.select("bundle_id").distinct(), "bundle_id", "left_semi")
        parts.append(_steps(archives.archive_findings(read_back, want), "files"))
    return reduce(DataFrame.unionByName, parts)


def candidates_of(catalog: DataFrame, blobs: DataFrame, subjects: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejected) of what is attached to the subjects (layout, subject), for evidence.judged().

    A referrer is fetched, parsed and checked, must name the subject it is listed for, and gives its only layer as the
    envelope. Rejected: (subject_digest, digest, reason). most: a subject with more referrers has none looked at, and is
    rejected as a whole.
    """
    found = layout.referrers_of(catalog, subjects)
    counts = found.groupBy("layout", "subject").agg(F.count("*").alias("n"))
    over = counts.where(F.col("n") > (most if most is not None else 1 << 62))
    found = found.join(over, ["layout", "subject"], "left_anti")
    key = F.concat_ws("|", "layout", "subject", "digest")
    wanted = found.select(key.alias("bundle_id"), "layout", "digest", F.col("size").cast("long").alias("size"), "subject", F.col("artifact_type"))
    fetched = written(_fetched(wanted, blobs), "referrers")
    parsed = written(docs.parse(fetched.where("content is not null").select("bundle_id", F.col("content").cast("string").alias("text")), docs.MANIFEST), "parsed-referrers")
    wrong = docs.referrer_findings(parsed)
    about = wanted.select("bundle_id", "layout", "subject", F.col("digest").alias("referrer"), "artifact_type")
    sound = parsed.join(wrong.select("bundle_id"), "bundle_id", "left_anti").join(about, "bundle_id")
    other = sound.where(F.col("doc.subject.digest") != F.col("subject"))
    own = sound.where(F.col("doc.subject.digest") == F.col("subject"))
    layer = written(_fetched(own.select("bundle_id", "layout", F.col("doc.layers")[0]["digest"].alias("digest"), F.col("doc.layers")[0]["size"].alias("size")), blobs), "envelopes")
    reason = lambda df, text: df.join(about, "bundle_id").select(F.col("subject").alias("subject_digest"), F.col("referrer").alias("digest"), text.alias("reason"))
    rejected = [
        reason(fetched.where("code is not null").select("bundle_id", "code"), F.col("code")),
        reason(wrong.select("bundle_id", "message"), F.col("message")),
        reason(other.select("bundle_id"), F.lit("another subject")),
        reason(layer.where("code is not null").select("bundle_id", "code"), F.col("code")),
        over.select(F.col("subject").alias("subject_digest"), F.lit("").alias("digest"), F.lit("limit-exceeded").alias("reason")),
    ]
    kind = own.select("bundle_id", F.col("doc.artifactType").alias("said"))
    got = layer.where("content is not null").select("bundle_id", F.col("content").cast("string").alias("envelope")).join(about, "bundle_id").join(kind, "bundle_id")
    candidates = got.select(F.col("subject").alias("subject_digest"), F.col("referrer").alias("digest"), F.col("said").alias("artifact_type"), "envelope")
    return candidates, reduce(DataFrame.unionByName, rejected)


def envelopes_of(candidates: DataFrame) -> DataFrame:
    """What evidence.verified_keys() takes: the decoded payload and signatures of candidates whose envelope is sound."""
    parsed = docs.parse(candidates.select(F.concat_ws("|", "subject_digest", "digest").alias("bundle_id"), F.col("envelope").alias("text")), docs.ENVELOPE)
    bad = docs.envelope_findings(parsed).select("bundle_id")
    sound = parsed.join(bad, "bundle_id", "left_anti").select("bundle_id", "doc")
    both = candidates.withColumn("bundle_id", F.concat_ws("|", "subject_digest", "digest")).join(sound, "bundle_id")
    decode = lambda c: F.try_to_binary(c, F.lit("base64"))
    return both.select("subject_digest", "digest", F.col("doc.payloadType").alias("payload_type"), decode(F.col("doc.payload")).alias("payload"), F.transform("doc.signatures", lambda s: decode(s["sig"])).alias("signatures"))


def verified_evidence(catalog: DataFrame, blobs: DataFrame, subjects: DataFrame, keys: dict[str, bytes], verify: evidence.Verify, predicate_types: list[str], required_type: str, most: int | None = None) -> DataFrame:
    """(subject_digest, digest, reason, matching, key_ids, predicate_type, predicate): from what is attached to what is verified; reason null: verified."""
    candidates, rejected = candidates_of(catalog, blobs, subjects, most)
    judged = evidence.judged(candidates, evidence.verified_keys(envelopes_of(candidates), keys, verify), predicate_types, required_type)
    early = rejected.select("subject_digest", "digest", "reason", F.lit(False).alias("matching"), F.array().cast("array<string>").alias("key_ids"), F.lit(None).cast("string").alias("predicate_type"), F.lit(None).cast("string").alias("predicate"))
    return judged.unionByName(early)
