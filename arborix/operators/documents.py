"""Documents about bundles - configs, locks, manifests, referrers, statements, envelopes - built and checked as tables.

Checks give rows (bundle_id, code, path, message); none means consistent. A check
over entries lists every fault, a check of a header the first. Names of formats
and media types are parameters (Kinds).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests, references
from ..functions.canonical_json import canonical_json
from . import inventory as inv

MANIFEST_TYPE = "application/vnd.oci.image.manifest.v1+json"  # fixed values of the public image and attestation formats
STATEMENT_TYPE = "https://in-toto.io/Statement/v1"
MODES = (0o644, 0o755)

_DESCRIPTOR = "struct<mediaType:string, digest:string, size:long>"
MANIFEST = f"schemaVersion int, mediaType string, artifactType string, config {_DESCRIPTOR}, layers array<{_DESCRIPTOR}>, subject {_DESCRIPTOR}, annotations map<string,string>"
CONFIG = "schemaVersion int, format string, treeDigest string, fileCount long, totalSize long, files array<struct<path:string, mode:int, size:long, digest:string>>"
LOCK = "apiVersion string, kind string, manifestDigest string, format string, sources array<struct<name:string, type:string, resolver:string, resolverVersion:string, requested:map<string,string>, resolved:map<string,string>, treeDigest:string, mountPath:string, include:array<string>, exclude:array<string>>>, files array<struct<path:string, source:string, sourcePath:string, mode:int, size:long, digest:string>>, treeDigest string"
ENVELOPE = "payloadType string, payload string, signatures array<struct<keyid:string, sig:string>>"


@dataclass(frozen=True)
class Kinds:
    """The names by which a system knows its documents."""

    format: str = "arborix-bundle-v1"
    artifact_type: str = "application/vnd.arborix.bundle.v1"
    config_type: str = "application/vnd.arborix.config.v1+json"
    layer_type: str = "application/vnd.arborix.layer.v1.tar+gzip"
    api_version: str = "arborix/v1"
    lock_kind: str = "BundleLock"


def parse(docs: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """(bundle_id, doc, code): the document as a struct; invalid-input for no JSON object and for names the schema doesn't have."""
    fields = F.from_json(F.col(text), f"struct<{schema}>" if not schema.startswith("struct") else schema, {"mode": "PERMISSIVE"})
    known = [f.split()[0] for f in _top_level(schema)]
    keys = F.json_object_keys(text)
    code = F.when(keys.isNull() | F.exists(keys, lambda k: ~k.isin(known)), "invalid-input").otherwise("ok")
    return docs.select("bundle_id", F.when(code == "ok", fields).alias("doc"), code.alias("code"))


def _top_level(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[at:i].strip())
            at = i + 1
    return out


def first_fault(df: DataFrame, checks: list[tuple[Column, str, str]]) -> DataFrame:
    """The first check of each row whose condition isn't false; a condition that is null counts as a fault."""
    found = F.lit(None).cast("struct<code:string,message:string>")
    for bad, code, message in reversed(checks):
        found = F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))).otherwise(found)
    return df.select("bundle_id", found.alias("f")).where("f is not null").select("bundle_id", "f.code", F.lit("").alias("path"), "f.message")


def _not_digest(c: str | Column) -> Column:
    return digests.digest_code(F.col(c) if isinstance(c, str) else c) != "ok"


def _entry_faults(files: DataFrame) -> list[DataFrame]:
    """Faults of rows (bundle_id, pos, path, mode, size, digest), pos being the place in the document."""
    path = F.coalesce("path", F.lit(""))
    at = lambda bad, message: files.where(F.coalesce(bad, F.lit(True))).select("bundle_id", F.lit("invalid-artifact").alias("code"), path.alias("path"), F.lit(message).alias("message"))
    order = inv.order_faults(files, ["bundle_id"], "pos", "path").select("bundle_id", F.lit("invalid-artifact").alias("code"), path.alias("path"), F.col("fault").alias("message"))
    return [at(path == "", "empty path"), at(~F.col("mode").isin(*MODES), "mode"), at(F.col("size") < 0, "negative size"), at(_not_digest("digest"), "digest"), order]


def config_entries(parsed: DataFrame) -> DataFrame:
    """(bundle_id, pos, path, mode, size, digest) of parsed configs."""
    return parsed.select("bundle_id", F.posexplode("doc.files").alias("pos", "f")).select("bundle_id", "pos", "f.*")


def config_findings(headers: DataFrame, files: DataFrame, kinds: Kinds = Kinds(), domain: str = digests.TREE_DOMAIN) -> DataFrame:
    """Faults of configs: (bundle_id, schema_version, format, tree_digest, file_count, total_size) and their entries.

    The digest of the tree is recomputed. Sums are decimals, so they can't overflow unseen.
    """
    sums = files.groupBy("bundle_id").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("decimal(38,0)")).alias("total"))
    joined = headers.join(sums, "bundle_id", "left").join(inv.tree_digest(files, domain).select("bundle_id", F.col("tree_digest").alias("computed")), "bundle_id", "left")
    total = F.coalesce("total", F.lit(0).cast("decimal(38,0)"))
    empty = F.concat(F.lit("sha256:"), F.sha2(F.lit(domain.encode() + bytes(8)), 256))
    header = first_fault(
        joined,
        [
            (F.col("schema_version") != 1, "unsupported-version", "schema version"),
            (F.col("format") != kinds.format, "unsupported-version", "format"),
            (_not_digest("tree_digest"), "invalid-artifact", "tree digest"),
            (F.col("file_count") != F.coalesce("n", F.lit(0)), "invalid-artifact", "file count"),
            (total > 2**63 - 1, "invalid-artifact", "total overflows"),
            (F.col("total_size") != total, "invalid-artifact", "total size"),
            (F.col("tree_digest") != F.coalesce("computed", empty), "digest-mismatch", "tree digest"),
        ],
    )
    return reduce(DataFrame.unionByName, [header, *_entry_faults(files)])


def encode_configs(inventory: DataFrame, kinds: Kinds = Kinds(), domain: str = digests.TREE_DOMAIN) -> DataFrame:
    """(bundle_id, config, digest, size, tree_digest): the canonical JSON of each bundle's config, from built-in functions alone."""
    rec = digests.record_hex(F.col("path"), F.col("mode"), F.col("size"), F.col("digest"))
    rows = inventory.select("bundle_id", "path", "size", rec.alias("rec"), F.to_json(F.struct("digest", "mode", "path", "size")).alias("file"))
    ordered = lambda c, by: F.expr(f"listagg({c}, '{by}') within group (order by path)")
    g = rows.groupBy("bundle_id").agg(F.count("*").alias("n"), F.sum("size").alias("total"), ordered("rec", "").alias("recs"), ordered("file", ",").alias("files"))
    stream = F.concat(F.lit(domain.encode().hex()), digests.big_endian(F.col("n"), 8), F.col("recs"))
    g = g.withColumn("tree_digest", digests.sha256_text(F.unhex(stream)))
    text = F.format_string('{"fileCount":%d,"files":[%s],"format":"' + kinds.format + '","schemaVersion":1,"totalSize":%d,"treeDigest":"%s"}', "n", "files", "total", "tree_digest")
    return g.select("bundle_id", text.alias("config"), "tree_digest").select("bundle_id", "config", digests.sha256_text(F.col("config")).alias("digest"), F.octet_length("config").cast("long").alias("size"), "tree_digest")


def encode_manifests(configs: DataFrame, layers: DataFrame, kinds: Kinds = Kinds()) -> DataFrame:
    """(bundle_id, manifest, digest) from the descriptors (bundle_id, digest, size) of configs and layers."""
    of = lambda df, p: df.select("bundle_id", F.col("digest").alias(f"{p}_digest"), F.col("size").alias(f"{p}_size"))
    one = lambda p, kind: F.struct(F.col(f"{p}_digest").alias("digest"), F.lit(kind).alias("mediaType"), F.col(f"{p}_size").alias("size"))
    doc = F.struct(F.lit(kinds.artifact_type).alias("artifactType"), one("c", kinds.config_type).alias("config"), F.array(one("l", kinds.layer_type)).alias("layers"), F.lit(MANIFEST_TYPE).alias("mediaType"), F.lit(2).alias("schemaVersion"))
    return of(configs, "c").join(of(layers, "l"), "bundle_id").select("bundle_id", F.to_json(doc).alias("manifest")).withColumn("digest", digests.sha256_text(F.col("manifest")))


def _descriptor(c: str) -> list[tuple[Column, str, str]]:
    return [(_not_digest(f"{c}.digest"), "invalid-artifact", "descriptor digest"), (F.col(f"{c}.size") < 0, "invalid-artifact", "descriptor size"), (F.col(f"{c}.mediaType") == "", "invalid-artifact", "descriptor type")]


def _opened(parsed: DataFrame) -> DataFrame:
    return parsed.select("bundle_id", "code", "doc.*")


def _readable() -> tuple[Column, str, str]:
    return F.col("code") != "ok", "invalid-input", "not a strict document"


def manifest_findings(parsed: DataFrame, kinds: Kinds = Kinds()) -> DataFrame:
    """The first fault of each parsed manifest: version, types, exactly one layer, descriptors."""
    m = _opened(parsed).withColumn("layer", F.try_element_at("layers", F.lit(1)))
    checks = [
        _readable(),
        (F.col("schemaVersion") != 2, "invalid-artifact", "schema version"),
        (F.col("mediaType") != MANIFEST_TYPE, "invalid-artifact", "media type"),
        (F.col("artifactType") != kinds.artifact_type, "unsupported-version", "artifact type"),
        (F.col("config.mediaType") != kinds.config_type, "invalid-artifact", "config type"),
        *_descriptor("config"),
        (F.size("layers") != 1, "invalid-artifact", "number of layers"),
        (F.col("layer.mediaType") != kinds.layer_type, "invalid-artifact", "layer type"),
        *_descriptor("layer"),
    ]
    return first_fault(m, checks)


def referrer_findings(parsed: DataFrame) -> DataFrame:
    """The first fault of each parsed referrer: version, type, a subject, exactly one layer."""
    m = _opened(parsed).withColumn("layer", F.try_element_at("layers", F.lit(1)))
    checks = [
        _readable(),
        (F.col("schemaVersion") != 2, "invalid-artifact", "schema version"),
        (F.col("mediaType") != MANIFEST_TYPE, "invalid-artifact", "media type"),
        (F.col("artifactType") == "", "invalid-artifact", "artifact type"),
        (F.col("subject").isNull(), "invalid-artifact", "no subject"),
        *_descriptor("subject"),
        (F.size("layers") != 1, "invalid-artifact", "number of layers"),
        *_descriptor("layer"),
    ]
    return first_fault(m, checks)


def lock_findings(parsed: DataFrame, kinds: Kinds = Kinds()) -> DataFrame:
    """Faults of parsed locks: header, sources, owners and entries."""
    m = _opened(parsed)
    header = first_fault(
        m,
        [
            _readable(),
            (F.col("apiVersion") != kinds.api_version, "unsupported-version", "api version"),
            (F.col("kind") != kinds.lock_kind, "invalid-input", "kind"),
            (F.col("format") != kinds.format, "unsupported-version", "format"),
            (_not_digest("manifestDigest"), "invalid-input", "manifest digest"),
            (_not_digest("treeDigest"), "invalid-input", "tree digest"),
            (F.coalesce(F.size("sources"), F.lit(0)) < 1, "invalid-input", "no sources"),
            (F.coalesce(F.size("files"), F.lit(0)) < 1, "invalid-input", "no files"),
        ],
    )
    row = lambda df, path, message: df.select("bundle_id", F.lit("invalid-input").alias("code"), path.alias("path"), F.lit(message).alias("message"))
    sources = m.select("bundle_id", F.explode("sources").alias("s")).select("bundle_id", "s.*")
    name = F.coalesce("name", F.lit(""))
    files = m.select("bundle_id", F.posexplode("files").alias("pos", "f")).select("bundle_id", "pos", "f.*")
    owned = files.join(sources.select("bundle_id", F.col("name").alias("source")).distinct(), ["bundle_id", "source"], "left_anti")
    parts = [
        row(sources.where(~references.is_name(name)), name, "source name"),
        row(sources.where(F.coalesce("resolver", F.lit("")) == ""), name, "no resolver"),
        row(sources.where(F.coalesce(_not_digest("treeDigest"), F.lit(True))), name, "source digest"),
        row(sources.groupBy("bundle_id", "name").agg(F.count("*").alias("n")).where("n > 1"), name, "repeated source"),
        row(owned, F.coalesce("path", F.lit("")), "unknown owner"),
        *(f.withColumn("code", F.lit("invalid-input")) for f in _entry_faults(files)),
    ]
    return reduce(DataFrame.unionByName, parts, header)


def stale_locks(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """(bundle_id, source, reason) where the sources declared and those locked (bundle_id, source, tree_digest) differ."""
    both = declared.select("bundle_id", "source", F.col("tree_digest").alias("now"), F.lit(True).alias("d")).join(locked.select("bundle_id", "source", F.col("tree_digest").alias("then"), F.lit(True).alias("l")), ["bundle_id", "source"], "full_outer")
    reason = F.when(F.col("l").isNull(), "not-locked").when(F.col("d").isNull(), "not-declared").when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    return both.select("bundle_id", "source", reason.alias("reason")).where("reason is not null")


def stale_findings(spec_digests: DataFrame, declared: DataFrame, locks: DataFrame, built: DataFrame) -> DataFrame:
    """(bundle_id, code, path, message), all of code stale-lock: why a lock no longer says what a spec and its sources give.

    spec_digests: (bundle_id, digest); declared: sources as stale_locks() takes them; locks: parsed locks; built: the inventory
    that composing the sources gives now. What is compared: the spec, the sources, each source's tree, the final files.
    """
    m = _opened(locks.where("code = 'ok'"))
    row = lambda df, path, message: df.select("bundle_id", F.lit("stale-lock").alias("code"), path.alias("path"), message.alias("message"))
    spec = m.join(spec_digests, "bundle_id", "left").where(~F.col("manifestDigest").eqNullSafe(F.col("digest")))
    locked = m.select("bundle_id", F.explode("sources").alias("s")).select("bundle_id", F.col("s.name").alias("source"), F.col("s.treeDigest").alias("tree_digest"))
    files = m.select("bundle_id", F.explode("files").alias("f")).select("bundle_id", "f.path", "f.mode", "f.size", "f.digest")
    here = m.select("bundle_id").distinct()
    changes = inv.diff(files, built.join(here, "bundle_id", "left_semi"))
    return row(spec, F.lit(""), F.lit("spec")).unionByName(row(stale_locks(declared.join(here, "bundle_id", "left_semi"), locked), F.col("source"), F.col("reason"))).unionByName(row(changes, F.col("path"), F.col("change")))


def equal_locks(left: DataFrame, right: DataFrame) -> DataFrame:
    """(bundle_id, equal): whether two locks (bundle_id, text) are the same in canonical form; false where either is missing or can't be read."""
    one = lambda df, c: df.select("bundle_id", canonical_json("text").alias(c))
    both = one(left, "l").join(one(right, "r"), "bundle_id", "full_outer")
    return both.select("bundle_id", F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("equal"))


def envelope_findings(parsed: DataFrame, payload_type: str = "application/vnd.in-toto+json") -> DataFrame:
    """The first fault of each parsed envelope: type, base64 payload, at least one signature, and base64 in each."""
    m = _opened(parsed).withColumns({"bytes": F.try_to_binary("payload", F.lit("base64")), "n": F.coalesce(F.size("signatures"), F.lit(0))})
    bad_signature = F.exists("signatures", lambda s: F.coalesce(s["sig"], F.lit("")) == "") | F.exists("signatures", lambda s: F.try_to_binary(s["sig"], F.lit("base64")).isNull())
    checks = [
        _readable(),
        (F.col("payloadType") != payload_type, "invalid-evidence", "payload type"),
        (F.coalesce(F.octet_length("bytes"), F.lit(0)) == 0, "invalid-evidence", "payload"),
        (F.col("n") < 1, "invalid-evidence", "no signature"),
        (bad_signature, "invalid-evidence", "signature"),
    ]
    return first_fault(m, checks)


def statement_findings(statements: DataFrame, predicate_types: list[str]) -> DataFrame:
    """The first fault of each statement (bundle_id, type, subjects array of maps from algorithm to hex, predicate_type)."""
    sha = F.try_element_at(F.try_element_at("subjects", F.lit(1)), F.lit("sha256"))
    checks = [
        (F.col("type") != STATEMENT_TYPE, "invalid-evidence", "type"),
        (F.coalesce(F.size("subjects"), F.lit(0)) != 1, "invalid-evidence", "number of subjects"),
        (~sha.rlike(r"\A[0-9a-f]{64}\z"), "invalid-evidence", "subject digest"),
        (~F.col("predicate_type").isin(predicate_types), "invalid-evidence", "predicate type"),
    ]
    return first_fault(statements, checks)
