"""Queries of checks, references, layouts, evidence and whole operations over faults planted by a rule of doc_id; importing this registers them.

The SQL says which document has which fault, and shares no expression with the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical_json, digests, durations, faults, globs, paths, references
from ..operators import archives as ar
from ..operators import conformance, evidence, limits, operations, policies, specs, subjects, validators
from ..operators import documents as docs
from ..operators import evaluation as ev
from ..operators import inventory as inv
from ..sources import directory, layout, resolvers, sinks, stage
from ..sources.stage import written
from .artifacts import KINDS, ORACLE_SQL, QUERIES, document_files
from .queries import EVALUATED_AT, OTHER, TREE, altered_tree, document_tree, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]

ID = "doc_id || ''"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bundle a document: bundle_id, doc_id, text, lang, source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.withColumn("bundle_id", F.col("doc_id").cast("string"))


def lone_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of bundles of one file each."""
    t = F.coalesce("text", F.lit(""))
    return numbered(spark, sf_dir).select("bundle_id", "doc_id", F.concat("doc_id", F.lit(".txt")).alias("path"), F.lit(420).alias("mode"), F.octet_length(t).cast("long").alias("size"), digests.sha256_text(t).alias("digest"))


def planted(text: str, modulus: int, cases: dict[int, tuple[str, str]]) -> Column:
    """The text with what each remainder of bundle_id replaces."""
    out, n = F.col(text), F.col("bundle_id").cast("long") % modulus
    for k, (old, new) in cases.items():
        out = F.when(n == k, F.replace(F.col(text), F.lit(old), F.lit(new))).otherwise(out)
    return out


def expected(modulus: int, cases: list[tuple]) -> str:
    """SQL of findings: (remainder, code, message, path as SQL)."""
    return " union all ".join(f"select {ID} as bundle_id, '{code}' as code, {path[0] if path else chr(39) * 2} as path, '{message}' as message from documents where doc_id % {modulus} = {k}" for k, code, message, *path in cases)


def unread(parsed: DataFrame) -> DataFrame:
    return parsed.where("code <> 'ok'").select("bundle_id", "code", F.lit("").alias("path"), F.lit("not a strict document").alias("message"))


FILE = f"{ID} || '.txt'"


@query(expected(8, [(1, "unsupported-version", "schema version"), (2, "invalid-artifact", "file count"), (3, "invalid-artifact", "mode", FILE), (3, "digest-mismatch", "tree digest"), (4, "unsupported-version", "format"), (5, "invalid-input", "not a strict document"), (6, "invalid-input", "not a strict document"), (7, "invalid-artifact", "tree digest")]))
def config_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = docs.encode_configs(lone_tree(spark, sf_dir)).select("bundle_id", F.col("config").alias("text"))
    faulty = planted("text", 8, {1: ('"schemaVersion":1', '"schemaVersion":2'), 2: ('"fileCount":1', '"fileCount":2'), 3: ('"mode":420', '"mode":421'), 4: ('"format":"', '"format":"x'), 5: ('{"fileCount"', '{"extra":1,"fileCount"'), 6: ('{"fileCount"', '"fileCount"'), 7: ('"treeDigest":"sha256:', '"treeDigest":"sha256:0')})
    parsed = docs.parse(texts.withColumn("text", faulty), docs.CONFIG)
    read = parsed.where("code = 'ok'")
    heads = read.select("bundle_id", F.col("doc.schemaVersion").alias("schema_version"), F.col("doc.format").alias("format"), F.col("doc.treeDigest").alias("tree_digest"), F.col("doc.fileCount").alias("file_count"), F.col("doc.totalSize").alias("total_size"))
    return docs.config_findings(heads, docs.config_entries(read)).unionByName(unread(parsed))


def lone_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lock of one source, s, for each document: (bundle_id, text)."""
    tree, none = lone_tree(spark, sf_dir), F.array().cast("array<string>")
    sources = tree.select("bundle_id", F.lit("s").alias("name"), F.lit("path").alias("type"), F.lit("path").alias("resolver"), F.lit("").alias("resolver_version"), F.create_map(F.lit("path"), "path").alias("requested"), F.create_map().cast("map<string,string>").alias("resolved"), F.col("digest").alias("tree_digest"), F.lit("").alias("mount"), none.alias("include"), none.alias("exclude"))
    files = tree.withColumns({"source": F.lit("s"), "source_path": F.col("path")})
    return specs.encode_locks(tree.select("bundle_id", "digest"), sources, files).select("bundle_id", F.col("lock").alias("text"))


@query(expected(8, [(1, "unsupported-version", "api version"), (2, "invalid-input", "kind"), (3, "invalid-input", "unknown owner", FILE), (4, "invalid-input", "no resolver", "'s'"), (5, "invalid-input", "mode", FILE), (6, "invalid-input", "manifest digest"), (7, "invalid-input", "not a strict document")]))
def lock_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    faulty = planted("text", 8, {1: ('"apiVersion":"', '"apiVersion":"x'), 2: ('"kind":"', '"kind":"x'), 3: ('"source":"s"', '"source":"t"'), 4: ('"resolver":"path"', '"resolver":""'), 5: ('"mode":420', '"mode":384'), 6: ('"manifestDigest":"sha256:', '"manifestDigest":"sha512:'), 7: ('{"apiVersion"', '{"x":1,"apiVersion"')})
    return docs.lock_findings(docs.parse(lone_locks(spark, sf_dir).withColumn("text", faulty), docs.LOCK))


@query("select doc_id || '' as bundle_id, 'lock' as kind, 1 as n_sources, 1 as n_files, 'sha256:' || sha256(coalesce(text, '')) as manifest_digest, 'resolved' as confidence from documents where doc_id % 2 = 0")
def lock_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspection shows of locks; every other one can't be read."""
    cut = lone_locks(spark, sf_dir).withColumn("text", planted("text", 2, {1: ("{", "")}))
    return specs.inspect_locks(docs.parse(cut, docs.LOCK)).select("bundle_id", "kind", "n_sources", "n_files", "manifest_digest", "confidence")


@query("select doc_id || '' as bundle_id, doc_id % 4 in (0, 1) as equal from documents")
def locks_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks against themselves, spaced out, changed, and cut."""
    locks = lone_locks(spark, sf_dir)
    other = locks.withColumn("text", planted("text", 4, {1: (",", " ,\n "), 2: ('"mode":420', '"mode":493'), 3: ("{", "")}))
    return docs.equal_locks(locks, other)


@query(f"select {ID} as bundle_id, 'stale-lock' as code, '' as path, 'spec' as message from documents where doc_id % 5 = 1 union all select {ID}, 'stale-lock', 's', 'changed' from documents where doc_id % 5 = 2 union all select {ID}, 'stale-lock', 'extra', 'not-locked' from documents where doc_id % 5 = 3 union all select {ID}, 'stale-lock', {FILE}, 'mode-changed' from documents where doc_id % 5 = 4")
def lock_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks whose spec, source, sources or files have changed since."""
    tree, n = lone_tree(spark, sf_dir), F.col("doc_id") % 5
    spec = tree.select("bundle_id", F.when(n == 1, digests.sha256_text(F.lit("x"))).otherwise(F.col("digest")).alias("digest"))
    declared = tree.select("bundle_id", F.lit("s").alias("source"), F.when(n == 2, digests.sha256_text(F.lit("x"))).otherwise(F.col("digest")).alias("tree_digest"))
    extra = tree.where(n == 3).select("bundle_id", F.lit("extra").alias("source"), F.col("digest").alias("tree_digest"))
    built = tree.withColumn("mode", F.when(n == 4, 493).otherwise(F.col("mode")))
    return docs.stale_findings(spec, declared.unionByName(extra), docs.parse(lone_locks(spark, sf_dir), docs.LOCK), built)


def lone_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lone_tree(spark, sf_dir).select("bundle_id", "digest", "size")
    return docs.encode_manifests(d, d).select("bundle_id", F.col("manifest").alias("text"))


TWO_LAYERS = ('"layers":[', '"layers":[{"digest":"sha256:0","mediaType":"m","size":1},')


@query(expected(8, [(1, "invalid-artifact", "schema version"), (2, "unsupported-version", "artifact type"), (3, "invalid-artifact", "config type"), (4, "invalid-artifact", "layer type"), (5, "invalid-artifact", "number of layers"), (6, "invalid-artifact", "descriptor digest"), (7, "invalid-input", "not a strict document")]))
def manifest_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    faulty = planted("text", 8, {1: ('"schemaVersion":2', '"schemaVersion":3'), 2: ('"artifactType":"', '"artifactType":"x'), 3: (f'"{KINDS.config_type}"', '"x"'), 4: (f'"{KINDS.layer_type}"', '"x"'), 5: TWO_LAYERS, 6: ('"config":{"digest":"sha256:', '"config":{"digest":"sha512:'), 7: ('{"artifactType"', '{"x":0,"artifactType"')})
    return docs.manifest_findings(docs.parse(lone_manifests(spark, sf_dir).withColumn("text", faulty), docs.MANIFEST))


SUBJECT_OF = '"schemaVersion":2,"subject":{"digest":"sha256:' + "a" * 64 + '","mediaType":"m","size":%d}}'


@query(expected(6, [(1, "invalid-artifact", "no subject"), (2, "invalid-artifact", "artifact type"), (3, "invalid-artifact", "descriptor size"), (4, "invalid-artifact", "number of layers"), (5, "invalid-artifact", "media type")]))
def referrer_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = lone_manifests(spark, sf_dir).withColumn("text", F.when(F.col("bundle_id").cast("long") % 6 == 1, F.col("text")).otherwise(F.replace("text", F.lit('"schemaVersion":2}'), F.lit(SUBJECT_OF % 1))))
    faulty = planted("text", 6, {2: (f'"artifactType":"{KINDS.artifact_type}"', '"artifactType":""'), 3: (SUBJECT_OF % 1, SUBJECT_OF % -1), 4: TWO_LAYERS, 5: (docs.MANIFEST_TYPE, "x")})
    return docs.referrer_findings(docs.parse(texts.withColumn("text", faulty), docs.MANIFEST))


@query(expected(10, [(1, "unsupported-version", "api version"), (2, "invalid-input", "kind"), (3, "invalid-input", "name"), (4, "invalid-input", "no sources"), (5, "invalid-input", "source name"), (6, "unsupported-source", "source type"), (7, "invalid-input", "mount path"), (8, "invalid-input", "pattern"), (9, "invalid-input", "not a strict document")]))
def spec_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = '{"name":"s","type":"path","mountPath":"m","config":{"path":"x"},"include":["**"]}'
    whole = F.format_string('{"apiVersion":"' + KINDS.api_version + '","kind":"' + specs.SPEC_KIND + '","metadata":{"name":"n%d"},"spec":{"sources":[' + source + "]}}", "doc_id")
    faulty = planted("text", 10, {1: ('"apiVersion":"', '"apiVersion":"x'), 2: ('"kind":"', '"kind":"x'), 3: ('"name":"n', '"name":"N'), 4: (source, ""), 5: ('"name":"s"', '"name":"-s"'), 6: ('"type":"path"', '"type":"ftp"'), 7: ('"mountPath":"m"', '"mountPath":"/m"'), 8: ('"**"', '"a//b"'), 9: ('{"apiVersion"', '{"x":1,"apiVersion"')})
    return specs.spec_findings(specs.parse_specs(numbered(spark, sf_dir).select("bundle_id", whole.alias("text")).withColumn("text", faulty)))


@query("select doc_id || '' as bundle_id, 'ok' as code, 'n' || doc_id as name, 1 as n_sources, 'd' || doc_id as path from documents")
def spec_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specs made for single directories, read back."""
    none = F.array().cast("array<string>")
    rows = numbered(spark, sf_dir).select("bundle_id", F.concat(F.lit("n"), "doc_id").alias("name"), F.concat(F.lit("/home/d"), "doc_id", F.lit("/")).alias("path"), F.lit("").alias("mount"), none.alias("include"), none.alias("exclude"))
    parsed = specs.parse_specs(specs.direct_specs(rows))
    declared = specs.declared_sources(parsed).select("bundle_id", F.get_json_object("config", "$.path").alias("path"))
    return parsed.join(declared, "bundle_id").select("bundle_id", "code", F.col("doc.metadata.name").alias("name"), F.size("doc.spec.sources").alias("n_sources"), F.regexp_replace("path", "/", "").alias("path"))


@query("select doc_id || '' as bundle_id, case when doc_id % 3 = 0 then 'lock' else 'manifest' end as kind from documents")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, '{"kind":"' + KINDS.lock_kind + '"}').when(F.col("doc_id") % 3 == 1, "kind: Bundle").otherwise('{"kind":1}')
    return numbered(spark, sf_dir).select("bundle_id", specs.document_kind(text).alias("kind"))


@query(expected(6, [(1, "invalid-evidence", "payload type"), (2, "invalid-evidence", "payload"), (3, "invalid-evidence", "no signature"), (4, "invalid-evidence", "signature"), (5, "invalid-evidence", "payload")]))
def envelope_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.format_string('{"payloadType":"application/vnd.in-toto+json","payload":"p%s","signatures":[{"keyid":"k","sig":"YQ=="}]}', F.base64(F.col("bundle_id").cast("binary")))
    texts = numbered(spark, sf_dir).select("bundle_id", F.replace(whole, F.lit('"payload":"p'), F.lit('"payload":"')).alias("text"))
    faulty = planted("text", 6, {1: ("in-toto", "other"), 3: ('{"keyid":"k","sig":"YQ=="}', ""), 4: ("YQ==", ""), 5: ('"payload":"', '"payload":"!!')})
    emptied = F.when(F.col("bundle_id").cast("long") % 6 == 2, F.regexp_replace("text", '"payload":"[^"]*"', '"payload":""')).otherwise(F.col("text"))
    return docs.envelope_findings(docs.parse(texts.withColumn("text", faulty).withColumn("text", emptied), docs.ENVELOPE))


@query(expected(5, [(1, "invalid-evidence", "type"), (2, "invalid-evidence", "number of subjects"), (3, "invalid-evidence", "subject digest"), (4, "invalid-evidence", "predicate type")]))
def statement_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, sha = F.col("doc_id") % 5, F.sha2(F.col("bundle_id"), 256)
    one = F.create_map(F.lit("sha256"), F.when(n == 3, F.upper(sha)).otherwise(sha))
    rows = numbered(spark, sf_dir).select("bundle_id", F.when(n == 1, "x").otherwise(docs.STATEMENT_TYPE).alias("type"), F.when(n == 2, F.array(one, one)).otherwise(F.array(one)).alias("subjects"), F.when(n == 4, "q").otherwise("p").alias("predicate_type"))
    return docs.statement_findings(rows, ["p", "r"])


def document_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layout, digest, size, content, doc_id): documents as blobs of the layout of their language."""
    t = F.coalesce("text", F.lit(""))
    return numbered(spark, sf_dir).select(F.coalesce("lang", F.lit("none")).alias("layout"), digests.sha256_text(F.concat("doc_id", F.lit("|"), t)).alias("digest"), (F.octet_length(t) + F.length("bundle_id") + 1).cast("long").alias("size"), F.concat("doc_id", F.lit("|"), t).cast("binary").alias("content"), "doc_id")


BLOB = "'sha256:' || sha256(doc_id || '|' || coalesce(text, ''))"


@query(f"select coalesce(lang, 'none') as layout, {BLOB} as digest, case doc_id % 4 when 1 then 'size-mismatch' when 2 then 'digest-mismatch' else 'not-found' end as code from documents where doc_id % 4 > 0")
def blob_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors against blobs of another size, other content, and none."""
    b, n = document_blobs(spark, sf_dir), F.col("doc_id") % 4
    held = b.where(n != 3).withColumn("content", F.when(n == 1, F.concat("content", F.lit(b"!"))).when(n == 2, F.concat(F.lit(b"!"), F.expr("substring(content, 2)"))).otherwise(F.col("content")))
    return layout.blob_faults(b, held)


@query(f"select coalesce(lang, 'none') as layout, {BLOB} as digest from documents where doc_id % 3 <> 0")
def blobs_unwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to write where a third is there and another third is there but broken; each blob is given twice."""
    b = document_blobs(spark, sf_dir)
    present = b.where("doc_id % 3 < 2").withColumn("content", F.when(F.col("doc_id") % 3 == 1, F.lit(b"x")).otherwise(F.col("content")))
    return layout.unwritten(b.unionByName(b), present).select("layout", "digest")


def document_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows: documents whose number ends in 0 are manifests, and every other one is attached to the last of these before it."""
    d, none = table(spark, sf_dir, "documents").select("doc_id"), F.lit(None).cast("string")
    own = F.col("doc_id") % 10 == 0
    s = lambda c: c.cast("string")
    return d.select(F.lit("l").alias("layout"), s(F.col("doc_id")).alias("digest"), F.lit("m").alias("media_type"), F.col("doc_id").alias("size"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("artifact_type"), F.when(own, F.concat(F.lit("v"), "doc_id")).alias("tag"), F.when(own, none).otherwise(s(F.col("doc_id") - F.col("doc_id") % 10)).alias("subject"))


@query("select doc_id || '' as digest, (doc_id - doc_id % 10) || '' as subject from documents where doc_id % 10 > 0 and doc_id % 2 = 1 and (doc_id // 10) % 2 = 0")
def referrers_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The referrers of one type of every other subject."""
    c = document_referrers(spark, sf_dir)
    wanted = c.where("subject is null and size div 10 % 2 = 0").select("layout", F.col("digest").alias("subject"))
    return layout.referrers_of(c, wanted, "odd").select("digest", "subject")


@query("select count(*) as n, count(distinct doc_id) as n_digests from documents where doc_id % 10 > 0")
def referrers_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referrers attached twice to a catalogue that has a third of them."""
    r = document_referrers(spark, sf_dir).where("subject is not null")
    once = layout.put_referrers(r.where("size % 3 = 0"), r)
    return layout.put_referrers(once, r).agg(F.count("*").alias("n"), F.countDistinct("digest").alias("n_digests"))


@query("select 'copy' as layout, doc_id || '' as digest, case when doc_id % 10 > 0 then (doc_id - doc_id % 10) || '' end as subject from documents where (doc_id // 10) % 3 = 0")
def subjects_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_referrers(spark, sf_dir)
    return layout.copied(c, c.where("subject is null and size div 10 % 3 = 0").select("layout", "digest"), "copy").select("layout", "digest", "subject")


RULES = ev.Rules(max_age_seconds=86_400, provenance_required=True, require_lock_digest=True, builders=["b0", "b1"], source_types=["en", "fr"], source_hosts=["h0.org"], require_immutable=True, reject_invalid_matching=True)


def document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of 50 subjects, signed by 4 keys (and by none), with statements of one source each."""
    d, n, none = numbered(spark, sf_dir), F.col("doc_id"), F.lit(None).cast("string")
    own = (n % 50).cast("string")
    source = F.struct(F.lit("s").alias("name"), F.col("lang").alias("type"), F.when(n % 4 == 3, "file:///x").otherwise(F.concat(F.lit("https://u@h"), n % 4, F.lit(".org/r"))).alias("url"), F.when(n % 7 > 0, digests.sha256_text(F.col("bundle_id"))).alias("tree_digest"))
    statement = F.struct(F.lit("p").alias("predicate_type"), F.when(n % 11 == 0, "other").otherwise(own).alias("subject_digest"), none.alias("tree_digest"), none.alias("format"), F.when(n % 2 == 0, digests.sha256_text(F.col("bundle_id"))).alias("lock_digest"), F.concat(F.lit("b"), n % 3).alias("builder"), F.array(source).alias("sources"))
    signer = F.struct(F.when(n % 5 > 0, F.concat(F.lit("k"), n % 5)).otherwise("").alias("key_id"), none.alias("issuer"), none.alias("subject"))
    return d.select(own.alias("subject_digest"), F.col("bundle_id").alias("digest"), F.array(signer).alias("identities"), F.lit(True).alias("log_verified"), F.lit(False).alias("via_fallback"), F.when(n % 13 > 0, F.lit(EVALUATED_AT).cast("timestamp") - F.make_dt_interval(hours=n % 48)).alias("signed_at"), statement.alias("statement"))


def evidence_subjects(e: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return e.select("subject_digest").distinct().select("subject_digest", F.lit(True).alias("by_digest"), none.alias("format"), F.lit(1).alias("n_files"), F.lit(1).alias("total_size"), none.alias("tree_digest"))


@query(
    "with d as (select *, doc_id % 5 > 0 as accepted, doc_id % 11 > 0 as bound from documents), f as (select doc_id, 'evidence-expired' as code from d where accepted and (doc_id % 13 = 0 or doc_id % 48 > 24) union all select doc_id, 'subject-mismatch' from d where accepted and not bound union all select doc_id, 'lock-digest-required' from d where accepted and bound and doc_id % 2 = 1 union all select doc_id, 'builder-not-allowed' from d where accepted and bound and doc_id % 3 = 2 "
    "union all select doc_id, 'source-type-not-allowed' from d where accepted and bound and coalesce(lang, '') not in ('en', 'fr') union all select doc_id, 'source-host-not-allowed' from d where accepted and bound and doc_id % 4 > 0 union all select doc_id, 'immutable-resolution' from d where accepted and bound and doc_id % 7 = 0) "
    "select (doc_id % 50) || '' as subject_digest, doc_id || '' as about, code from f union all select (k || ''), (k || ''), 'provenance-required' from (select doc_id % 50 as k from d group by 1 having not bool_or(accepted))"
)
def provenance_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements and their sources break of a policy, item by item."""
    e = document_evidence(spark, sf_dir)
    return ev.evaluate(RULES, evidence_subjects(e), e, F.lit(EVALUATED_AT).cast("timestamp")).select("subject_digest", "about", "code")


@query("select k || '' as subject_digest, list_transform(list_sort(list_distinct(list(doc_id % 5))), lambda x: 'k' || x) as identities from (select doc_id, doc_id % 50 as k from documents where doc_id % 5 > 0) group by k")
def identities_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose evidence counts for each subject; here a subject's items all have one key."""
    return ev.accepted_identities(ev.accepted(ev.Rules(), document_evidence(spark, sf_dir)))


@query("select doc_id % 50 || '' as subject_digest, doc_id || '' as about, case when doc_id % 2 = 0 then 'matching-evidence-invalid' else 'ignored-evidence' end as code, case when doc_id % 2 = 0 then 'error' else 'warning' end as severity from documents where doc_id % 3 = 0")
def evidence_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = numbered(spark, sf_dir).where(n % 3 == 0).select((n % 50).cast("string").alias("subject_digest"), F.col("bundle_id").alias("digest"), (n % 2 == 0).alias("matching"), F.lit("x").alias("reason"))
    return ev.rejected_findings(RULES, rows).select("subject_digest", "about", "code", "severity")


@query("select doc_id || '' as subject_digest, case when doc_id % 4 = 1 then 'fail' else 'pass' end as trust, case when doc_id % 5 = 1 then 'fail' else 'pass' end as integrity, case doc_id % 3 when 0 then 'pass' when 1 then 'fail' else 'not-evaluated' end as semantics from documents where doc_id % 4 <> 1 and doc_id % 5 <> 1 and doc_id % 3 <> 1")
def reports_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three statuses of each subject, and only those subjects that may be written."""
    s, n = numbered(spark, sf_dir).withColumnRenamed("bundle_id", "subject_digest"), F.col("doc_id")
    found = s.select("subject_digest", F.when(n % 4 == 1, "error").otherwise("warning").alias("severity"))
    report = ev.reports(s, found, s.where(n % 5 == 1), s.where(n % 3 < 2).select("subject_digest", (n % 3 == 1).alias("failed")))
    return ev.gated(report, report).select("subject_digest", "trust", "integrity", "semantics")


@query("with a as (select coalesce(source, '') as b, count(*) as n, max(doc_id) as m from documents group by 1) select b as bundle_id, 'maxFiles' as bound, least(100000, n) as value, case when n < 100000 then 'policy' else 'default' end as origin from a union all select b, 'maxFileBytes', least(1073741824, m + 1), case when m + 1 < 1073741824 then 'client' else 'default' end from a union all select b, 'maxReferrers', 256, 'default' from a")
def limits_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, and what client and policy ask of them: to relax a bound is no use."""
    a = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("bundle_id")).agg(F.count("*").alias("n"), F.max("doc_id").alias("m"))
    row = lambda bound, value, origin, k: a.select("bundle_id", F.lit(bound).alias("bound"), value.cast("long").alias("value"), F.lit(origin).alias("origin"), F.lit(k).alias("precedence"))
    asked = row("maxFiles", F.col("n"), "policy", 2).unionByName(row("maxFileBytes", F.col("m") + 1, "client", 1)).unionByName(row("maxReferrers", F.lit(4000), "policy", 2)).unionByName(row("maxFiles", F.lit(0), "request", 3))
    return limits.effective(asked).where("bound in ('maxFiles', 'maxFileBytes', 'maxReferrers')")


@query("select doc_id || '' as bundle_id, case when doc_id % 4 = 3 then 'maxWhatever' else 'maxFiles' end as bound, case doc_id % 4 when 1 then 'negative' when 2 then 'over-ceiling' else 'unknown-bound' end as code from documents where doc_id % 4 > 0")
def limits_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 4
    asked = numbered(spark, sf_dir).select("bundle_id", F.when(n == 3, "maxWhatever").otherwise("maxFiles").alias("bound"), F.when(n == 1, -1).when(n == 2, 10**6 + 1).otherwise(10**6).cast("long").alias("value"), F.lit("client").alias("origin"), F.lit(1).alias("precedence"))
    return limits.limit_findings(asked).select("bundle_id", "bound", "code")


@query("with d as (select coalesce(source, '') as b, strlen(coalesce(text, '')) as n from documents) select b as bundle_id, case when bool_or(n % 7 = 0 or n < 40) then 'fail' else 'pass' end as status, count(*) filter (where n % 7 = 0) as odd, count(*) filter (where n < 40) as raised from d group by 1")
def validator_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two validators over every document, of which one raises for short ones; a bundle passes if neither found anything."""

    def short(path: str, content: bytes) -> list:
        if len(content) < 40:
            raise RuntimeError("short")
        return []

    checks = {"sevens": lambda path, content: [("odd", path)] if len(content) % 7 == 0 else [], "short": short}
    files = document_files(spark, sf_dir)
    found = validators.run_validators(files, checks)
    counts = found.groupBy("bundle_id").agg(F.count_if(F.col("validator") == "sevens").alias("odd"), F.count_if(F.col("code") == "validator-failed").alias("raised"))
    return validators.statuses(files, found, checks).join(counts, "bundle_id", "left").fillna(0, ["odd", "raised"])


@query(
    f"with d as (select {ID} as b, doc_id % 6 as k from documents) select b as bundle_id, 'd' as name, 'missing-parent' as deviation, 'error' as severity from d where k = 1 union all select b, 'd/f', 'repeated', 'error' from d where k = 2 union all select b, 'e', 'needless-directory', 'note' from d where k = 3 union all select b, 'd/a', 'order', 'note' from d where k = 4 union all select b, 'd/f', 'mode', 'note' from d where k = 5 "
    "union all select b, 'd/f', 'order', 'note' from d where k = 2"
)
def archive_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of archives with one departure each from the canonical encoding."""
    k = F.col("doc_id") % 6
    entry = lambda name, kind, mode: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(mode).alias("mode"))
    d, f = entry("d", "directory", 493), entry("d/f", "file", 420)
    listed = F.when(k == 1, F.array(f)).when(k == 2, F.array(d, f, f)).when(k == 3, F.array(d, entry("e", "directory", 493), f)).when(k == 4, F.array(d, f, entry("d/a", "file", 420))).when(k == 5, F.array(d, entry("d/f", "file", 384))).otherwise(F.array(d, f))
    rows = numbered(spark, sf_dir).select("bundle_id", F.posexplode(listed).alias("entry_no", "e")).select("bundle_id", "entry_no", "e.*", F.lit(1).cast("long").alias("size"), F.lit("x").alias("digest"))
    return ar.deviations(rows)


@query(f"select {ID} as bundle_id, case when doc_id % 4 = 1 then 'digest-mismatch' else 'invalid-artifact' end as code, case doc_id % 4 when 1 then 'the packed bytes differ' when 2 then 'truncated' else 'bytes after the end' end as message from documents where doc_id % 4 > 0")
def layer_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that aren't the ones declared, end early, or go on after their end."""
    files = numbered(spark, sf_dir).select("bundle_id", F.lit("f").alias("path"), F.lit(420).alias("mode"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    parts, n = ar.pack(files), F.col("bundle_id").cast("long") % 4
    want = ar.descriptors(parts).withColumn("digest", F.when(n == 1, digests.sha256_text(F.lit("x"))).otherwise(F.col("digest")))
    broken = parts.withColumn("data", F.when(n == 2, F.expr("substring(data, 1, length(data) - 12)")).when(n == 3, F.concat("data", F.lit(b"more"))).otherwise(F.col("data")))
    found = ar.archive_findings(ar.entries(broken), ar.inventory_of(files), want).where("message <> 'declared, not delivered'")
    return found.select("bundle_id", "code", F.when(F.col("message").contains("runcated"), "truncated").when(F.col("message").contains("packed"), F.col("message")).otherwise("bytes after the end").alias("message"))


@query(f"with {TREE} select bundle_id, 'limit-exceeded' as code, '' as path, 'too many entries' as message from tree group by 1 having count(*) + count(distinct split_part(path, '/', 1)) > 55")
def node_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of more files and directories than allowed."""
    files = document_files(spark, sf_dir)
    return ar.archive_findings(ar.entries(ar.pack(files)), ar.inventory_of(files), max_files=55)


@query("select doc_id || '' as bundle_id, 'duplicate-path' as code, 'caf' || chr(233) || doc_id as path from documents where doc_id % 3 = 0")
def collision_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of one name, of which one is made of two characters, in a third of the bundles."""
    d, n = numbered(spark, sf_dir), F.col("doc_id")
    row = lambda path: d.select("bundle_id", F.col("bundle_id").alias("source"), F.lit("").alias("mount"), path.alias("path"), F.lit(420).alias("mode"), F.lit(0).alias("size"), F.lit("x").alias("digest"))
    both = row(F.concat(F.lit("café"), n)).unionByName(row(F.concat(F.when(n % 3 == 0, "café").otherwise("cafe"), n)))
    return inv.duplicate_paths(inv.compose(both)).select("bundle_id", "code", "path")


@query("select doc_id, doc_id % 6 < 2 as is_tag, doc_id % 6 in (0, 5) as is_name, doc_id % 6 in (3, 4) as is_source_type, doc_id % 6 = 2 as is_reference, case doc_id % 6 when 2 then null when 3 then 'x.org/t' when 4 then 'git' when 0 then 'v' || doc_id when 1 then 'V_' || doc_id || '.x' when 5 then 'n-' || doc_id || 'a' end as mount from documents where doc_id % 6 <> 4")
def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, names, types of sources, locations and mounts, told apart."""
    n = F.col("doc_id") % 6
    w = F.when(n == 0, F.concat(F.lit("v"), "doc_id")).when(n == 1, F.concat(F.lit("V_"), "doc_id", F.lit(".x"))).when(n == 2, "oci://h//x").when(n == 3, "x.org/t").when(n == 4, "git").otherwise(F.concat(F.lit("n-"), "doc_id", F.lit("a")))
    tag = references.is_tag(w) & ~n.isin(4, 5)
    return numbered(spark, sf_dir).where(n != 4).select("doc_id", tag.alias("is_tag"), references.is_name(w).alias("is_name"), references.is_source_type(w).alias("is_source_type"), references.is_reference(w).alias("is_reference"), references.mount_path(w).alias("mount"))


@query("select doc_id, 'sha256-' || sha256(doc_id || '') || '.evidence' as tag, sha256(coalesce(text, '')) as key_id from documents")
def evidence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where evidence is looked for without a list of referrers, and ids of keys."""
    return numbered(spark, sf_dir).select("doc_id", references.fallback_tag(digests.sha256_text(F.col("bundle_id"))).alias("tag"), evidence.key_id(F.coalesce("text", F.lit("")).cast("binary")).alias("key_id"))


@query("select doc_id || '' as digest, case doc_id % 4 when 0 then ['k0'] when 1 then ['k0', 'k1'] when 2 then ['k1'] else [] end as key_ids from documents")
def signatures_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which trusted keys signed each envelope; here a signature is the key and a hash of what is signed."""
    n, payload = F.col("doc_id") % 4, F.coalesce("text", F.lit("")).cast("binary")
    form = F.sha2(references.pre_authentication(F.lit("t"), payload), 256)
    sig = lambda k: F.concat(F.lit(f"{k}|"), form).cast("binary")
    given = F.when(n == 0, F.array(sig("a"), sig("a"))).when(n == 1, F.array(sig("b"), sig("a"), F.lit(b"junk"))).when(n == 2, F.array(sig("b"))).otherwise(F.array(sig("c")))
    envelopes = numbered(spark, sf_dir).select(F.lit("s").alias("subject_digest"), F.col("bundle_id").alias("digest"), F.lit("t").alias("payload_type"), payload.alias("payload"), given.alias("signatures"))
    return evidence.verified_keys(envelopes, {"k0": b"a", "k1": b"b"}, _signed).select("digest", "key_ids")


def _signed(key: bytes, form: bytes, signature: bytes) -> bool:
    import hashlib

    return signature == key + b"|" + hashlib.sha256(form).hexdigest().encode()


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalogue, blobs, subjects) of a layout in which each tenth document is a subject and the next nine are attached to it as evidence.

    What is wrong goes by the number's last digit: 2 has a broken blob, 3 names another subject, 4 an envelope that is none,
    5 no trusted signature, 6 another predicate type, 7 is of another type, 8 states another subject, 9 isn't there.
    """
    d = numbered(spark, sf_dir).withColumn("k", F.col("doc_id") % 10)
    k = F.col("k")
    own = digests.sha256_text(F.concat(F.lit("subject "), (F.col("doc_id") - k).cast("string")))
    stated = F.when(k == 8, F.lit("b" * 64)).otherwise(F.substr(own, F.lit(8)))
    statement = F.format_string('{"_type":"' + docs.STATEMENT_TYPE + '","subject":[{"digest":{"sha256":"%s"}}],"predicateType":"%s","predicate":{"n":%d}}', stated, F.when(k == 6, "q").otherwise("p"), "doc_id")
    form = F.sha2(references.pre_authentication(F.lit("application/vnd.in-toto+json"), statement), 256)
    sig = F.concat(F.when(k == 5, "z").otherwise("a"), F.lit("|"), form)
    envelope = F.format_string('{"payloadType":"application/vnd.in-toto+json","payload":"%s","signatures":[{"keyid":"","sig":"%s"}]}', F.regexp_replace(F.base64(statement.cast("binary")), "\\s", ""), F.regexp_replace(F.base64(sig.cast("binary")), "\\s", ""))
    envelope = F.when(k == 4, "[]").otherwise(envelope)
    kind = F.when(k == 7, "other").otherwise("evidence")
    named = F.when(k == 3, digests.sha256_text(F.lit("x"))).otherwise(own)
    e = d.where("k > 0").select("k", own.alias("subject"), kind.alias("kind"), envelope.alias("envelope"), named.alias("named"))
    manifest = F.format_string('{"schemaVersion":2,"mediaType":"' + docs.MANIFEST_TYPE + '","artifactType":"%s","config":{"mediaType":"c","digest":"' + digests_of("") + '","size":0},"layers":[{"mediaType":"l","digest":"%s","size":%d}],"subject":{"mediaType":"m","digest":"%s","size":1}}', "kind", digests.sha256_text(F.col("envelope")), F.octet_length("envelope"), "named")
    e = e.withColumn("manifest", manifest)
    at, content = F.lit("l").alias("layout"), lambda c: F.col(c).cast("binary").alias("content")
    e = written(e, "evidence")
    catalog = e.select(at, digests.sha256_text(F.col("manifest")).alias("digest"), F.lit("m").alias("media_type"), F.octet_length("manifest").cast("long").alias("size"), F.col("kind").alias("artifact_type"), F.lit(None).cast("string").alias("tag"), "subject", "k")
    layers = e.where("k <> 9").select(at, digests.sha256_text(F.col("envelope")).alias("digest"), F.when(F.col("k") == 2, F.lit(b"broken")).otherwise(F.col("envelope").cast("binary")).alias("content"))
    blobs = layers.unionByName(e.select(at, digests.sha256_text(F.col("manifest")).alias("digest"), content("manifest"))).dropDuplicates(["digest"])
    return catalog, blobs, catalog.select("layout", "subject").distinct()


def digests_of(text: str) -> str:
    import hashlib

    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


SUBJECT_DIGEST = "'sha256:' || sha256('subject ' || (doc_id - doc_id % 10))"


@query(f"select {SUBJECT_DIGEST} as subject_digest, case doc_id % 10 when 2 then 'size-mismatch' when 3 then 'another subject' when 4 then 'not an envelope' when 5 then 'no trusted signature' when 6 then 'predicate type' when 7 then 'another type' when 8 then 'another subject' when 9 then 'not-found' else 'verified' end as reason, count(*) as n from documents where doc_id % 10 > 0 group by 1, 2")
def evidence_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From what is attached to what is verified: the first thing wrong with each candidate."""
    catalog, blobs, wanted = _layout(spark, sf_dir)
    got = subjects.verified_evidence(catalog, blobs, wanted, {"k": b"a"}, _signed, ["p"], "evidence")
    return got.groupBy("subject_digest", F.coalesce("reason", F.lit("verified")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"select {SUBJECT_DIGEST} as subject_digest, case when count(*) > 8 then 'limit-exceeded' else 'looked at' end as reason from documents where doc_id % 10 > 0 and doc_id % 20 <> 1 group by 1")
def referrer_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject with more referrers than allowed is refused as a whole, and not looked at in part."""
    catalog, blobs, wanted = _layout(spark, sf_dir)
    some = catalog.join(document_numbers(spark, sf_dir), "digest", "left_anti")
    candidates, rejected = subjects.candidates_of(some, blobs, wanted, 8)
    over = rejected.where("reason = 'limit-exceeded'").select("subject_digest", "reason")
    return over.unionByName(candidates.select("subject_digest").distinct().withColumn("reason", F.lit("looked at")))


def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the referrers that referrer_limit leaves out: those of numbers that are 1 more than a multiple of 20."""
    catalog, _, _ = _layout(spark, sf_dir)
    own = table(spark, sf_dir, "documents").where("doc_id % 20 = 1").select(digests.sha256_text(F.concat(F.lit("subject "), (F.col("doc_id") - 1).cast("string"))).alias("subject"))
    return catalog.where("k = 1").join(own, "subject", "left_semi").select("digest")


@query("select doc_id || '' as bundle_id, case when doc_id % 9 in (3, 7) then '{\"a\":[true,null,0],\"b\\u0007\":\"<\\u0001>&/\",\"z\":' || doc_id || '}' end as canonical, case when doc_id % 9 in (3, 7) then doc_id % 9 = 3 else false end as was from documents where doc_id % 9 in (1, 2, 3, 4, 5, 6, 7)")
def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in canonical form, spaced out and unordered, and what has no canonical form; and what a second reader says of the form given."""
    n = F.col("doc_id") % 9
    clean = F.format_string('{"a":[true,null,0],"b\\u0007":"<\\u0001>&/","z":%d}', "doc_id")
    loose = F.format_string(' {"z" : %d, "b\\u0007":"\\u003c\\u0001>&\\/", "a":[true ,null,-0]}', "doc_id")
    text = F.when(n == 3, clean).when(n == 7, loose).when(n == 1, "1.5").when(n == 2, "{} {}").when(n == 4, "").when(n == 5, '{"a":1e3}').otherwise("99999999999999999999999")
    was = F.udf(lambda t: conformance.is_canonical(t), "boolean")
    return numbered(spark, sf_dir).where(n.between(1, 7)).select("bundle_id", canonical_json.canonical_json(text).alias("canonical"), (was(text) & n.isin(3, 7)).alias("was"))


@query("select event_id, replace(props, ' ', '') as canonical, 'sha256:' || sha256(replace(props, ' ', '')) as digest from events")
def json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", canonical_json.canonical_json("props").alias("canonical"))
    return e.withColumn("digest", digests.sha256_text(F.col("canonical")))


@query("select coalesce(source, '') as bundle_id, coalesce(lang, 'none') || '/' || doc_id || '.txt' as path from documents where (coalesce(lang, 'none') = 'en' or doc_id % 5 = 0) and not starts_with(doc_id || '', '1') and not (coalesce(lang, 'none') = 'fr' and strlen(doc_id || '') >= 2 and substr(doc_id || '', 2, 1) in ('0', '1', '2', '3', '4'))")
def glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = document_tree(table(spark, sf_dir, "documents"))
    return tree.where(globs.selected(F.col("path"), ["en/**", "**/*[05].txt"], ["**/1*.txt", "fr/?[0-4]*"])).select("bundle_id", "path")


def _bundles(spark: SparkSession, sf_dir: str) -> operations.Built:
    """Bundles of documents by source: the first has a path twice, the second an unsafe path, the third too many files."""
    d = document_files(spark, sf_dir).withColumns({"source": F.split("path", "/")[0], "mount": F.split("path", "/")[0], "path": F.split("path", "/")[1]})
    rows = d.select("bundle_id", "source", "mount", "path", "mode", "content")
    extra = lambda b, mount, path: spark.createDataFrame([(b, "extra", mount, path, 420, b"x")], rows.schema)
    twice = rows.where("bundle_id = 'src0'").select("bundle_id", F.lit("extra").alias("source"), "mount", "path", "mode", "content")
    asked = spark.createDataFrame([("src2", "maxFiles", 3, "policy", 2)], "bundle_id string, bound string, value long, origin string, precedence int")
    return operations.build(rows.unionByName(twice).unionByName(extra("src1", "m", "../x")), asked=asked)


@query(f"with {TREE} select bundle_id, 'duplicate-path' as code, path from tree where bundle_id = 'src0' union all select 'src1', 'unsafe-path', 'm/../x' union all select 'src2', 'limit-exceeded', ''")
def build_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why bundles can't be built."""
    return _bundles(spark, sf_dir).findings.where("code <> 'file-directory'").select("bundle_id", "code", "path")


@query(f"with {TREE} select bundle_id, 'sha256:' || sha256(unhex('{digests.TREE_DOMAIN.encode().hex()}' || lpad(hex(count(*)), 16, '0') || string_agg(lpad(hex(strlen(path)), 8, '0') || hex(path) || lpad(hex(mode), 8, '0') || lpad(hex(size), 16, '0') || upper(substr(digest, 8)), '' order by path))) as tree_digest, true as same_manifest from tree where bundle_id not in ('src0', 'src1', 'src2') group by bundle_id")
def build_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles built: their trees, and that their manifests name the config and the layer that were made."""
    built = _bundles(spark, sf_dir)
    built = built._replace(parts=written(built.parts, "parts"), configs=written(built.configs, "configs"))
    named = docs.parse(built.manifests.select("bundle_id", F.col("manifest").alias("text")), docs.MANIFEST).select("bundle_id", "doc")
    layers = ar.descriptors(built.parts).select("bundle_id", F.col("digest").alias("layer"))
    joined = built.configs.join(named, "bundle_id").join(layers, "bundle_id")
    return joined.select("bundle_id", "tree_digest", ((F.col("doc.config.digest") == F.col("digest")) & (F.col("doc.layers")[0]["digest"] == F.col("layer"))).alias("same_manifest"))


def lone_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of one file: (bundle_id, manifest, config, layer) as bytes."""
    files = numbered(spark, sf_dir).select("bundle_id", F.concat(F.lit("d/"), "doc_id").alias("path"), F.lit(420).alias("mode"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    parts = ar.pack(files, 1 << 30)  # one part each
    configs = docs.encode_configs(ar.inventory_of(files))
    manifests = docs.encode_manifests(configs, ar.descriptors(parts))
    return manifests.select("bundle_id", F.col("manifest").cast("binary").alias("manifest")).join(configs.select("bundle_id", F.col("config").cast("binary").alias("config")), "bundle_id").join(parts.select("bundle_id", F.col("data").alias("layer")), "bundle_id")


@query("select 'broken manifest' as what, doc_id || '' as bundle_id, 'manifest' as step, 'digest-mismatch' as code from documents where doc_id % 6 = 1 union all select 'no config', doc_id || '', 'config', 'not-found' from documents where doc_id % 6 = 2 union all select 'broken layer', doc_id || '', 'layer', 'size-mismatch' from documents where doc_id % 6 = 3 union all select 'no manifest', doc_id || '', 'manifest', 'not-found' from documents where doc_id % 6 = 4")
def subject_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects fetched from a layout by digests, from manifest to files, with blobs that are broken or not there."""
    b = written(lone_bundles(spark, sf_dir), "bundles").withColumn("n", F.col("bundle_id").cast("long") % 6)
    n, at = F.col("n"), F.lit("l").alias("layout")
    blob = lambda c, broken, gone: b.where(n != gone).select(at, digests.sha256_text(F.col(c)).alias("digest"), F.when(n == broken, F.concat(F.lit(b" "), F.expr(f"substring({c}, 2)")) if c == "manifest" else F.concat(F.lit(b" "), c)).otherwise(F.col(c)).alias("content"))
    blobs = blob("manifest", 1, 4).unionByName(blob("config", -1, 2)).unionByName(blob("layer", 3, -1)).dropDuplicates(["digest"])
    wanted = b.select("bundle_id", at, digests.sha256_text(F.col("manifest")).alias("digest"))
    what = F.when(F.col("bundle_id").cast("long") % 6 == 1, "broken manifest").when(F.col("bundle_id").cast("long") % 6 == 2, "no config").when(F.col("bundle_id").cast("long") % 6 == 3, "broken layer").otherwise("no manifest")
    return subjects.subject_findings(wanted, blobs).select(what.alias("what"), "bundle_id", "step", "code")


@query("select doc_id || '' as bundle_id, 'config: not canonical JSON' as deviation, 'note' as severity from documents where doc_id % 4 = 1 union all select doc_id || '', 'config: another blob than named', 'error' from documents where doc_id % 4 = 1 union all select doc_id || '', 'layer: another blob than named', 'error' from documents where doc_id % 4 = 2 union all select doc_id || '', 'layer: EOFError', 'error' from documents where doc_id % 4 = 2 union all select doc_id || '', 'manifest: version, type or layers', 'error' from documents where doc_id % 4 = 3")
def conformance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second reader says of sound bundles (nothing), and of a spaced-out config, a cut layer and another type."""
    n = F.col("bundle_id").cast("long") % 4
    text = lambda c, old, new: F.replace(F.col(c).cast("string"), F.lit(old), F.lit(new)).cast("binary")
    b = lone_bundles(spark, sf_dir).withColumns({"config": F.when(n == 1, text("config", ",", ", ")).otherwise(F.col("config")), "layer": F.when(n == 2, F.expr("substring(layer, 1, length(layer) - 9)")).otherwise(F.col("layer")), "manifest": F.when(n == 3, text("manifest", KINDS.artifact_type, "x")).otherwise(F.col("manifest"))})
    return conformance.conformance(b)


@query(f"with {TREE}, {OTHER} select * from (select bundle_id, path, 'only declared' as what from (select bundle_id, path, mode, size, digest from tree except select * from other) union all select bundle_id, path, 'only delivered' from (select * from other except select bundle_id, path, mode, size, digest from tree) union all select bundle_id, '' as path, case when a <> b then 'count' else 'total' end from (select bundle_id, sum(a) as a, sum(b) as b, sum(sa) as sa, sum(sb) as sb from (select bundle_id, 1 as a, 0 as b, size as sa, 0 as sb from tree union all select bundle_id, 0, 1, 0, size from other) group by 1) where a <> b or sa <> sb)")
def inventory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inventories matched over all columns, without a join."""
    return conformance.match_inventory(document_tree(table(spark, sf_dir, "documents")), altered_tree(spark, sf_dir))


@query("select doc_id || '' as bundle_id, 'sha256:' || sha256(coalesce(text, '')) as lock_digest, sha256(doc_id || '') as subject, 'x' || doc_id as name from documents")
def provenance_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements made of locks, read back."""
    locks = docs.parse(lone_locks(spark, sf_dir).withColumn("text", F.replace("text", F.lit('"name":"s"'), F.concat(F.lit('"name":"x'), "bundle_id", F.lit('"')))), docs.LOCK)
    d = numbered(spark, sf_dir).select("bundle_id", digests.sha256_text(F.coalesce("text", F.lit(""))).alias("lock_digest"), digests.sha256_text(F.col("bundle_id")).alias("subject_digest"))
    made = specs.provenance(locks.select("bundle_id", "doc").join(d.select("bundle_id", "lock_digest"), "bundle_id"), d, "p", "t", "me", "1")
    at = lambda p: F.get_json_object("statement", p)
    return made.select("bundle_id", at("$.predicate.bundle.lockDigest").alias("lock_digest"), at("$.subject[0].digest.sha256").alias("subject"), at("$.predicate.bundle.sources[0].name").alias("name"))


@query("select doc_id, case doc_id % 7 when 0 then 0 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 5 when 5 then 10 else 6 end as status, case doc_id % 5 when 0 then 'digest-mismatch' when 1 then 'invalid-artifact' when 2 then 'authentication' when 3 then 'authorization' else 'transport' end as registry, case doc_id % 4 when 0 then 'authentication' when 1 then 'source-resolution' when 2 then 'transport' else 'source-resolution' end as clone, case doc_id % 3 when 0 then 'authentication' when 1 then 'transport' else 'evidence-invalid' end as signing, doc_id % 5 = 4 as again from documents")
def fault_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit statuses of codes, and codes of failures by status and message."""
    n = F.col("doc_id")
    pick = lambda m, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (n % m + 1).cast("int"))
    code = pick(7, None, "invalid-input", "stale-lock", "invalid-artifact", "policy-failed", "whatever", "timeout")
    registry = faults.registry_code(pick(5, 404, 404, 401, 403, 500), pick(5, "a digest mismatch", "x", "x", "x", "x"))
    clone = faults.clone_code(pick(4, "authentication required", "repository not found", "dial: connection refused", "what"))
    signing = faults.signing_code(pick(3, "no identity token", "i/o timeout", "bad chain"))
    return numbered(spark, sf_dir).select("doc_id", faults.exit_code(code).alias("status"), registry.alias("registry"), clone.alias("clone"), signing.alias("signing"), faults.is_temporary(registry).alias("again"))


@query("select doc_id, case doc_id % 6 when 0 then 'a/' || doc_id when 1 then chr(233) || '/' || doc_id end as path, case when doc_id % 6 < 2 then 'ok' when doc_id % 6 = 5 then 'limit-exceeded' else 'unsafe-path' end as code, case doc_id % 6 when 2 then 'empty: ' when 3 then 'not UTF-8: a' || chr(65533) || doc_id when 4 then 'not allowed: a//' || doc_id when 5 then 'too long or too deep: ' || repeat('x', 128) end as message from documents")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as bytes: made NFC, or refused with a message that can be printed."""
    n, i = F.col("doc_id") % 6, F.col("bundle_id").cast("binary")
    raw = F.when(n == 0, F.concat(F.lit(b"a/"), i)).when(n == 1, F.concat(F.lit("é/".encode()), i)).when(n == 2, F.lit(b"")).when(n == 3, F.concat(F.lit(b"a\xff"), i)).when(n == 4, F.concat(F.lit(b"a//"), i)).otherwise(F.concat(F.lit(b"x" * 300), i))
    return numbered(spark, sf_dir).select("doc_id", paths.normalized(raw).alias("p")).select("doc_id", "p.*")


@query("select doc_id, case doc_id % 5 when 0 then doc_id * 3600000000 + 30 * 60000000 when 1 then -1500 * doc_id when 2 then doc_id // 1000 when 3 then doc_id * 1000000 + 250000 end as micros from documents")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.when(n % 5 == 0, F.concat(n, F.lit("h30m"))).when(n % 5 == 1, F.concat(F.lit("-"), n, F.lit("ms"), n * 500, F.lit("us"))).when(n % 5 == 2, F.concat(n, F.lit("ns"))).when(n % 5 == 3, F.concat(n, F.lit(".25s"))).otherwise(F.concat(n, F.lit("d")))
    return numbered(spark, sf_dir).select("doc_id", durations.micros_of(text).alias("micros"))


@query(expected(9, [(1, "unsupported-version", "apiVersion"), (2, "invalid-input", "kind"), (3, "invalid-input", "unknown field extra in spec.subject"), (4, "invalid-input", "threshold exceeds the number of identities"), (5, "invalid-input", "an identity names a key or an issuer, and not both"), (6, "invalid-input", "bounds can''t be negative"), (7, "invalid-input", "evidence.maxAge is not positive"), (8, "invalid-input", "an identity with a subject names its issuer")]))
def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies as documents, and why some are refused."""
    whole = F.format_string('{"apiVersion":"' + KINDS.api_version + '","kind":"' + policies.POLICY_KIND + '","metadata":{"name":"p%d"},"spec":{"subject":{"maxFiles":5},"signatures":{"threshold":1,"identities":[{"keyId":"k"}]},"evidence":{"maxAge":"720h"}}}', "doc_id")
    faulty = planted("text", 9, {1: ('"apiVersion":"', '"apiVersion":"x'), 2: ('"kind":"', '"kind":"x'), 3: ('"maxFiles":5', '"maxFiles":5,"extra":1'), 4: ('"threshold":1', '"threshold":2'), 5: ('"keyId":"k"', '"keyId":"k","issuer":"i"'), 6: ('"maxFiles":5', '"maxFiles":-5'), 7: ('"720h"', '"-720h"'), 8: ('"keyId":"k"', '"subject":"s"')})
    return policies.policy_findings(numbered(spark, sf_dir).select("bundle_id", whole.alias("text")).withColumn("text", faulty))


@query("select doc_id, case doc_id % 9 when 1 then 'no url' when 2 then 'not https' when 3 then 'credentials in the url' when 4 then 'a query in the url' when 5 then 'a fragment in the url' when 6 then 'no host' when 7 then 'no ref' when 8 then 'sub-path' end as refusal from documents")
def git_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 9
    url = F.when(n == 1, "").when(n == 2, "ssh://h.org/r").when(n == 3, "https://u:p@h.org/r").when(n == 4, "https://h.org/r?x=1").when(n == 5, "https://h.org/r#x").when(n == 6, "https:///r").otherwise(F.concat(F.lit("https://h.org/r"), "doc_id"))
    return numbered(spark, sf_dir).select("doc_id", resolvers.git_refusal(url, F.when(n == 7, "").otherwise("main"), F.when(n == 8, "../x").otherwise("a/b")).alias("refusal"))


@query("select doc_id || '' as bundle_id, case when doc_id % 6 = 1 then 493 else 420 end as mode, null as finding from documents where doc_id % 6 < 2 union all select doc_id || '', null, case doc_id % 6 when 2 then 'a symbolic link' when 3 then 'a submodule' else 'a stand-in of a large file' end from documents where doc_id % 6 in (2, 3, 4)")
def git_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree, and what in it is none."""
    n = F.col("doc_id") % 6
    mode = F.when(n == 1, "100755").when(n == 2, "120000").when(n == 3, "160000").when(n == 5, "040000").otherwise("100644")
    content = F.when(n == 4, F.concat(F.lit(directory.POINTER), F.lit(b"v1\n"))).otherwise(F.coalesce("text", F.lit("")).cast("binary"))
    tree = numbered(spark, sf_dir).select("bundle_id", F.lit("s").alias("source"), F.lit("f").alias("path"), mode.alias("git_mode"), content.alias("content"))
    files, found = resolvers.tree_files(tree)
    return files.select("bundle_id", "mode", F.lit(None).cast("string").alias("finding")).unionByName(found.select("bundle_id", F.lit(None).cast("int").alias("mode"), F.col("message").alias("finding")))


@query("select 'corpus' as bundle_id, doc_id || '.txt' as path, case when doc_id % 2 = 0 then source end as source, case when doc_id % 2 = 0 then doc_id || '.txt' end as source_path from documents")
def path_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source a final path came from; every other one came from none."""
    d = numbered(spark, sf_dir).select(F.lit("corpus").alias("bundle_id"), "doc_id", "source", F.concat("doc_id", F.lit(".txt")).alias("path"))
    composed = d.where("doc_id % 2 = 0").select("bundle_id", "path", "source", F.col("path").alias("source_path"))
    return resolvers.owners(composed, d.select("bundle_id", "path"))


@query("select doc_id || '' as bundle_id, 'bundle' as kind, 1::bigint as n_files, strlen(coalesce(text, ''))::bigint as total_size, 'digest-verified' as confidence from documents")
def bundle_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspection shows of bundles, from manifest and config alone."""
    b = lone_bundles(spark, sf_dir)
    text = lambda c: b.select("bundle_id", F.col(c).cast("string").alias("text"))
    return specs.inspect_bundles(docs.parse(text("manifest"), docs.MANIFEST), docs.parse(text("config"), docs.CONFIG)).select("bundle_id", "kind", "n_files", "total_size", "confidence")


@query("select (doc_id % 50) || '' as bundle_id, 'fail' as integrity, 'pass' as trust, false as ok from documents where doc_id % 50 in (3, 4) group by 1 union all select (doc_id % 50) || '', 'pass', 'pass', true from documents where doc_id % 50 not in (3, 4) group by 1")
def verify_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole verification of 50 bundles, of which one has another file than declared and one lacks one."""
    d = numbered(spark, sf_dir).select((F.col("doc_id") % 50).cast("string").alias("bundle_id"), F.concat("doc_id", F.lit(".txt")).alias("path"), F.lit(420).alias("mode"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    want = ar.inventory_of(d)
    sent = d.withColumn("content", F.when(F.col("bundle_id") == "3", F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))).where("bundle_id <> '4' or path <> '4.txt'")
    none = F.lit(None).cast("string")
    wanted = d.select("bundle_id").distinct().select("bundle_id", F.col("bundle_id").alias("subject_digest"), F.lit(True).alias("by_digest"), none.alias("format"), F.lit(1).alias("n_files"), F.lit(1).alias("total_size"), none.alias("tree_digest"))
    e = document_evidence(spark, sf_dir).limit(0)
    report = operations.verify(ar.pack(sent), want, wanted, ev.Rules(), e, F.lit(EVALUATED_AT).cast("timestamp"))
    return report.select(F.col("subject_digest").alias("bundle_id"), "integrity", "trust", "ok")


@query("select doc_id, case when doc_id % 3 = 0 then 'a' else 'b' end || repeat(chr(233), 60 + doc_id % 3) as name from documents")
def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of more bytes than a header has, packed and read back."""
    n = F.col("doc_id")
    name = F.concat(F.when(n % 3 == 0, "a").otherwise("b"), F.repeat(F.lit("é"), (60 + n % 3).cast("int")))
    files = numbered(spark, sf_dir).select("bundle_id", name.alias("path"), F.lit(420).alias("mode"), F.lit(b"x").alias("content"))
    return ar.entries(ar.pack(files)).where("kind = 'file'").select(F.col("bundle_id").cast("long").alias("doc_id"), "name")


def _place(spark: SparkSession) -> str:
    import uuid

    return f"{stage.folder(spark)}/arborix-steps/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@query("select 'v' || (doc_id % 20) as tag, doc_id || '' as document, 'ok' as state from documents where doc_id >= 20 and doc_id < 40 union all select null, doc_id || '', 'ok' from documents where doc_id < 40 and doc_id % 20 = 0 and doc_id < 20")
def publish_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published under tags, others under the same tags, and one attached to another: what the layout's readers find."""
    root = _place(spark)
    b = numbered(spark, sf_dir).where("doc_id < 40").withColumn("content", F.concat("bundle_id", F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary")).withColumn("digest", digests.sha256_text(F.col("content")))
    row = b.select(F.lit(root).alias("layout"), "digest", F.lit("m").alias("media_type"), F.octet_length("content").cast("long").alias("size"), F.lit("a").alias("artifact_type"), F.concat(F.lit("v"), F.col("doc_id") % 20).alias("tag"), F.lit(None).cast("string").alias("subject"), F.col("doc_id").alias("seq"), "doc_id")
    sinks.publish(b.where("doc_id < 20"), row.where("doc_id < 20").drop("doc_id"), root)
    attached = row.where("doc_id = 0").withColumns({"tag": F.lit(None).cast("string"), "subject": F.lit("sha256:" + "0" * 64)}).drop("doc_id")
    sinks.publish(b.where("doc_id >= 20 or doc_id = 0"), row.where("doc_id >= 20").drop("doc_id"), root, attached)
    catalog, held = layout.read_catalog(spark, root), layout.read_blobs(spark, root)
    wrong = layout.blob_faults(catalog, held).select("digest", "code")
    named = catalog.join(held.select("digest", F.substring_index(F.col("content").cast("string"), "|", 1).alias("document")), "digest")
    return named.join(wrong, "digest", "left").select("tag", "document", F.coalesce("code", F.lit("ok")).alias("state"))


@query(f"with {TREE} select bundle_id, path, mode, digest from tree")
def expand_to_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bundle packed, expanded, written as a tree of files, and read back as a directory."""
    files = document_files(spark, sf_dir)
    parts, want = written(ar.pack(files), "parts"), ar.inventory_of(files)
    faults_found = written(ar.archive_findings(written(ar.entries(parts), "entries"), want, max_files=1 << 40), "findings")
    root = _place(spark)
    done = sinks.write_trees(ar.expand(parts, want, faults_found), root)
    local = root.removeprefix("file://")
    read, _ = directory.read_directories(spark, {b: f"{local}/{b}" for b, state in done.items() if state == "ok"})
    return ar.inventory_of(read).select("bundle_id", "path", "mode", "digest")
