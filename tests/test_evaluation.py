import hashlib
import json

import pytest
from pyspark.sql import functions as F

from arborix.functions import digests, references
from arborix.operators import documents as docs
from arborix.operators import evaluation as ev
from arborix.operators.evaluation import Identity

from arborix.sources import directory, layout
from tests.test_inventory import records, some_files, tree

H = {c: "sha256:" + c * 64 for c in "0123456789abcdef"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("oci://registry.example.com:5000/team/config", ("oci", "registry.example.com:5000", "team/config", "", "", "", "ok")),
        ("registry.example.com:5000/team/config:v1", ("oci", "registry.example.com:5000", "team/config", "", "v1", "", "ok")),
        ("localhost/c@" + H["a"], ("oci", "localhost", "c", "", "", H["a"], "ok")),
        ("oci-layout://C:\\Temp\\layout:v1", ("oci-layout", "", "", "C:\\Temp\\layout", "v1", "", "ok")),
        ("oci-layout:///data/a:b/c", ("oci-layout", "", "", "/data/a:b/c", "", "", "ok")),
        *((bad, ("", "", "", "", "", "", "invalid-input")) for bad in ["", "team/config:v1", "s3://x/y", "oci-layout://", "localhost/c:v1@" + H["a"], "oci-layout:///l:v1@" + H["a"], "localhost/c@sha256:00", "oci-layout:///l@" + H["a"] + "@x", "localhost/UP"]),
    ],
)
def test_references(spark, raw, want):
    assert tuple(spark.range(1).select(references.parse_reference(F.lit(raw))).first()[0]) == want


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(references.is_name(F.lit(n))) for n in ("a", "a-b", "-a", "a-", "A", "a" * 64, "a\n")] == [True, True, False, False, False, False, False]
    assert [one(references.is_source_type(F.lit(n))) for n in ("git", "x.org/y", "x/y", "x.org/", "ftp")] == [True, True, False, False, False]
    assert [one(references.mount_path(F.lit(n))) for n in ("", ".", "a/b", "/a", "a//b", "../a")] == ["", "", "a/b", None, None, None]
    assert one(references.redacted(F.lit("https://u:p@h.org/x?y#z"))) == "https://h.org/x"
    assert bytes(one(references.pre_authentication(F.lit("http://t"), F.lit("héllo")))) == b"DSSEv1 8 http://t 6 h\xc3\xa9llo"


def test_configs(spark):
    domain, rows = some_files()
    kinds = docs.Kinds(format="a-format")
    got = docs.encode_configs(tree(spark, rows), kinds, domain)
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    files = [{"path": p, "mode": m, "size": len(c), "digest": sha(c)} for p, m, c in sorted(rows, key=lambda r: r[0].encode())]
    want = {"schemaVersion": 1, "format": "a-format", "fileCount": len(rows), "totalSize": sum(f["size"] for f in files), "treeDigest": sha(records(domain, rows)), "files": files}
    text = json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert got.select("config", "digest", "size").first()[:] == (text, sha(text.encode()), len(text.encode()))
    parsed = docs.parse(got.select("bundle_id", F.col("config").alias("text")), docs.CONFIG)
    head = parsed.select("bundle_id", F.col("doc.schemaVersion").alias("schema_version"), "doc.format", F.col("doc.treeDigest").alias("tree_digest"), F.col("doc.fileCount").alias("file_count"), F.col("doc.totalSize").alias("total_size"))
    files = docs.config_entries(parsed)
    assert docs.config_findings(head, files, kinds, domain).collect() == []
    find = lambda h=head, f=files: {(r.code, r.message) for r in docs.config_findings(h, f, kinds, domain).collect()}
    assert ("invalid-artifact", "file count") in find(head.withColumn("file_count", F.lit(8)))
    assert ("unsupported-version", "format") in find(head.withColumn("format", F.lit("x")))
    assert ("digest-mismatch", "tree digest") in find(head.withColumn("tree_digest", F.lit(H["1"])))
    assert ("invalid-artifact", "unsorted") in find(f=files.withColumn("pos", -F.col("pos")))
    assert ("invalid-artifact", "mode") in find(f=files.withColumn("mode", F.lit(0o600)))
    assert ("invalid-artifact", "digest") in find(f=files.withColumn("digest", F.lit("x")))


def text_rows(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "bundle_id string, text string")


def messages(found):
    return {r.bundle_id: r.message for r in found.collect()}


def test_manifests_and_strict_documents(spark):
    k = docs.Kinds()
    d = spark.createDataFrame([("0", H["1"], 5)], "bundle_id string, digest string, size long")
    good = docs.encode_manifests(d, d).first().manifest
    assert list(good) and good.startswith('{"artifactType":')
    bad = [good.replace('"schemaVersion":2', '"schemaVersion":3'), good.replace('"layers":[', '"layers":[{},'), good[:-1] + ',"extra":1}', "no", good.replace(k.layer_type, "x"), good.replace("1" * 64, "1" * 63, 1)]
    found = messages(docs.manifest_findings(docs.parse(text_rows(spark, good, *bad), docs.MANIFEST)))
    assert found == {"1": "schema version", "2": "number of layers", "3": "not a strict document", "4": "not a strict document", "5": "layer type", "6": "descriptor digest"}
    assert messages(docs.referrer_findings(docs.parse(text_rows(spark, good), docs.MANIFEST))) == {"0": "no subject"}


def test_locks(spark):
    k = docs.Kinds()
    lock = f'{{"apiVersion":"{k.api_version}","kind":"{k.lock_kind}","manifestDigest":"{H["1"]}","format":"{k.format}","sources":[{{"name":"s","resolver":"r","treeDigest":"{H["2"]}"}}],"files":[{{"path":"a","source":"s","mode":420,"size":1,"digest":"{H["3"]}"}}],"treeDigest":"{H["4"]}"}}'
    bad = [lock.replace(k.lock_kind, "Bundle"), lock.replace('"source":"s"', '"source":"t"'), lock.replace('"resolver":"r"', '"resolver":""'), lock.replace("420", "384"), lock.replace('"name":"s"', '"name":"S"').replace('"source":"s"', '"source":"S"'), "{}"]
    found = messages(docs.lock_findings(docs.parse(text_rows(spark, lock, *bad), docs.LOCK)))
    assert found == {"1": "kind", "2": "unknown owner", "3": "no resolver", "4": "mode", "5": "source name", "6": "api version"}
    rows = lambda *r: spark.createDataFrame([("b", *x) for x in r], "bundle_id string, source string, tree_digest string")
    got = docs.stale_locks(rows(("a", "1"), ("b", "1"), ("c", "1")), rows(("a", "1"), ("b", "2"), ("d", "1")))
    assert {(r.source, r.reason) for r in got.collect()} == {("b", "changed"), ("c", "not-locked"), ("d", "not-declared")}


def test_envelopes_and_statements(spark):
    good = '{"payloadType":"application/vnd.in-toto+json","payload":"e30=","signatures":[{"keyid":"k","sig":"YQ=="}]}'
    bad = [good.replace("in-toto", "x"), good.replace("e30=", "###"), good.replace('[{"keyid":"k","sig":"YQ=="}]', "[]"), good.replace("YQ==", "")]
    assert messages(docs.envelope_findings(docs.parse(text_rows(spark, good, *bad), docs.ENVELOPE))) == {"1": "payload type", "2": "payload", "3": "no signature", "4": "signature"}
    rows = [("0", docs.STATEMENT_TYPE, [{"sha256": "a" * 64}], "p"), ("1", "x", [{"sha256": "a" * 64}], "p"), ("2", docs.STATEMENT_TYPE, [], "p"), ("3", docs.STATEMENT_TYPE, [{"md5": "a"}], "p"), ("4", docs.STATEMENT_TYPE, [{"sha256": "a" * 64}], "q")]
    st = spark.createDataFrame(rows, "bundle_id string, type string, subjects array<map<string,string>>, predicate_type string")
    assert messages(docs.statement_findings(st, ["p"])) == {"1": "type", "2": "number of subjects", "3": "subject digest", "4": "predicate type"}


def evaluation(spark, rules, statement=None, identities=(("k", None, None),), signed="2026-03-01 11:00:00", log=True, fallback=False, rejected=None, n_items=1):
    st = {"predicate_type": "p", "subject_digest": H["1"], "tree_digest": H["2"], "format": "f", "lock_digest": H["5"], "builder": "b", "sources": [("s", "path", "https://git.example.com/x", H["2"])]} | (statement or {})
    subjects = spark.createDataFrame([(H["1"], False, "f", 7, 40, H["2"])], "subject_digest string, by_digest boolean, format string, n_files long, total_size long, tree_digest string")
    schema = "subject_digest string, digest string, identities array<struct<key_id:string,issuer:string,subject:string>>, log_verified boolean, via_fallback boolean, signed_at string, statement struct<predicate_type:string,subject_digest:string,tree_digest:string,format:string,lock_digest:string,builder:string,sources:array<struct<name:string,type:string,url:string,tree_digest:string>>>"
    items = [(H["1"], f"e{i}", list(identities), log, fallback, signed, tuple(st[c] for c in ("predicate_type", "subject_digest", "tree_digest", "format", "lock_digest", "builder", "sources"))) for i in range(n_items)]
    e = spark.createDataFrame(items, schema).withColumn("signed_at", F.col("signed_at").cast("timestamp"))
    r = spark.createDataFrame(rejected, "subject_digest string, digest string, matching boolean, reason string") if rejected else None
    found = ev.evaluate(rules, subjects, e, F.lit("2026-03-01 12:00:00").cast("timestamp"), r)
    return sorted(x.code for x in found.collect()), ev.reports(subjects, found).first().trust


KEY = Identity(key_id="K")
CASES = [
    (ev.Rules(), {}, []),
    (ev.Rules([KEY], 1), {}, []),
    (ev.Rules([Identity(key_id="z")], 1), {}, ["signature-threshold"]),
    (ev.Rules([KEY, Identity(issuer="i")], 2), {"n_items": 2}, ["signature-threshold"]),
    (ev.Rules([KEY, Identity(issuer="i", subject_pattern="a+")], 2), {"identities": (("k", None, None), (None, "i", "aa"))}, []),
    (ev.Rules(provenance_required=True), {"n_items": 0}, ["provenance-required", "signature-threshold"]),
    (ev.Rules([KEY], 1, require_log=True), {"log": False}, ["transparency-proof"]),
    (ev.Rules([KEY], 1, require_log=True), {"n_items": 0}, ["signature-threshold", "transparency-proof"]),
    (ev.Rules(require_log=True), {"log": False}, []),
    (ev.Rules(max_age_seconds=86_400), {}, []),
    (ev.Rules(max_age_seconds=60), {}, ["evidence-expired"]),
    (ev.Rules(max_age_seconds=86_400), {"signed": None}, ["evidence-expired"]),
    (ev.Rules(require_digest_reference=True, formats=["g"], max_files=6, max_bytes=39), {}, ["digest-reference-required", "format-not-allowed", "resource-limit", "resource-limit"]),
    (ev.Rules(predicate_types=["q"], builders=["c"], require_lock_digest=True), {"statement": {"lock_digest": "yes"}}, ["builder-not-allowed", "lock-digest-required", "predicate-not-allowed"]),
    (ev.Rules(builders=["c"]), {"statement": {"subject_digest": H["3"]}}, ["subject-mismatch"]),
    (ev.Rules(provenance_required=True), {"statement": {"tree_digest": H["3"], "format": "g"}}, ["provenance-inconsistent", "provenance-inconsistent"]),
    (ev.Rules(source_hosts=["git.example.com"]), {}, []),
    (ev.Rules(source_hosts=["git.example.com"]), {"statement": {"sources": []}}, ["provenance-inconsistent"]),
    (ev.Rules(source_hosts=["git.example.com"]), {"statement": {"sources": [("s", "path", None, None), ("t", "path", "file:///etc/passwd", None), ("u", "path", "", None)]}}, ["source-host-not-allowed"] * 3),
    (ev.Rules(source_types=["git"], require_immutable=True), {"statement": {"sources": [("s", "path", None, "main")]}}, ["immutable-resolution", "source-type-not-allowed"]),
    (ev.Rules(), {"fallback": True}, ["tag-fallback-not-allowed"]),
    (ev.Rules(allow_fallback=True), {"fallback": True}, []),
]


@pytest.mark.parametrize(("rules", "facts", "want"), CASES)
def test_rules(spark, rules, facts, want):
    assert evaluation(spark, rules, **facts) == (want, "fail" if want else "pass")


def test_rejected_candidates_warn_or_fail(spark):
    bad = [(H["1"], "r", True, "x"), (H["1"], "t", False, "x")]
    assert evaluation(spark, ev.Rules(), rejected=bad) == (["ignored-evidence"] * 2, "pass")
    assert evaluation(spark, ev.Rules(reject_invalid_matching=True), rejected=bad) == (["ignored-evidence", "matching-evidence-invalid"], "fail")


def test_reports_and_gate(spark):
    subjects = spark.createDataFrame([("a",), ("b",), ("c",)], "subject_digest string")
    findings = spark.createDataFrame([("b", "error"), ("a", "warning")], "subject_digest string, severity string")
    checks = spark.createDataFrame([("a", False), ("c", False), ("c", True)], "subject_digest string, failed boolean")
    got = ev.reports(subjects, findings, integrity=subjects.limit(0), semantics=checks)
    assert {r.subject_digest: (r.trust, r.integrity, r.semantics, r.ok) for r in got.collect()} == {"a": ("pass", "pass", "pass", True), "b": ("fail", "pass", "not-evaluated", False), "c": ("pass", "pass", "fail", False)}
    assert [r[0] for r in ev.gated(subjects, got).collect()] == ["a"]


def test_layout(spark, tmp_path):
    (tmp_path / "blobs/sha256").mkdir(parents=True)
    name = hashlib.sha256(b"x").hexdigest()
    (tmp_path / "blobs/sha256" / name).write_bytes(b"x")
    (tmp_path / "index.json").write_text('{"manifests":[{"mediaType":"m","digest":"sha256:%s","size":1,"annotations":{"%s":"v1"}}]}' % (name, layout.TAG_ANNOTATION))
    catalog, blobs = layout.read_catalog(spark, str(tmp_path)), layout.read_blobs(spark, str(tmp_path))
    assert layout.blob_faults(catalog, blobs).collect() == []
    assert [r.code for r in layout.blob_faults(catalog.withColumn("size", F.lit(2)), blobs).collect()] == ["size-mismatch"]
    assert [r.code for r in layout.blob_faults(catalog.withColumn("digest", F.lit(H["1"])), blobs).collect()] == ["not-found"]
    assert layout.unwritten(blobs, blobs).count() == 0 and layout.unwritten(blobs, blobs.withColumn("content", F.lit(b"y"))).count() == 1
    rows = lambda *r: spark.createDataFrame(r, "layout string, digest string, media_type string, size long, artifact_type string, tag string, subject string, seq long")
    moved = layout.put_manifests(rows(("l", "1", "m", 1, "a", "v1", None, 0)), rows(("l", "2", "m", 1, "a", "v1", None, 1), ("l", "3", "m", 1, "a", "v2", None, 2)))
    assert {(r.tag, r.digest) for r in moved.collect()} == {("v1", "2"), ("v2", "3")}
    ref = rows(("l", "9", "m", 1, "e", None, "2", 0), ("l", "9", "m", 1, "e", None, "2", 0))
    once = layout.put_referrers(moved, ref)
    assert layout.put_referrers(once, ref).count() == 3
    wanted = spark.createDataFrame([("l", "v1"), ("l", "v9")], "layout string, tag string")
    assert {(r.tag, r.digest, r.code) for r in layout.find_tags(moved, wanted).collect()} == {("v1", "2", "ok"), ("v9", None, "not-found")}
    assert layout.find_tags(moved.union(moved), wanted.limit(1)).first().code == "invalid-artifact"
    subject = spark.createDataFrame([("l", "2")], "layout string, digest string")
    assert sorted((r.layout, r.digest) for r in layout.copied(once, subject, "to").collect()) == [("to", "2"), ("to", "9")]


def test_directories(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.txt").write_bytes(b"1")
    (tmp_path / "a/run").write_bytes(b"22")
    (tmp_path / "a/run").chmod(0o711)
    (tmp_path / "a/CON").write_bytes(b"")
    (tmp_path / "a/big").write_bytes(bytes(50))
    (tmp_path / "a/no.tmp").write_bytes(b"")
    (tmp_path / "a/link").symlink_to("run")
    (tmp_path / "none").mkdir()
    files, found = directory.read_directories(spark, {"a": str(tmp_path / "a"), "n": str(tmp_path / "none")}, exclude=["**/*.tmp"], max_file_bytes=20)
    assert sorted((r.bundle_id, r.path, r.mode, bytes(r.content)) for r in files.collect()) == [("a", "b/x.txt", 420, b"1"), ("a", "run", 493, b"22")]
    assert {(r.bundle_id, r.path, r.code) for r in found.collect()} == {("a", "CON", "unsafe-path"), ("a", "big", "limit-exceeded"), ("a", "link", "unsupported-file"), ("n", "", "not-found")}
    one = spark.createDataFrame([(directory.POINTER + b"v1\n",), (b"version",)], "c binary")
    assert [r[0] for r in one.select(directory.is_pointer(F.col("c"))).collect()] == [True, False]
    claims = spark.createDataFrame([("b", "s", H["1"]), ("b", "t", H["2"])], "bundle_id string, source string, tree_digest string")
    assert [r.source for r in directory.changed(claims, claims.withColumn("tree_digest", F.lit(H["1"]))).collect()] == ["t"]
