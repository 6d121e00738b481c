import base64
import json

from pyspark.sql import functions as F

from arborix.functions import references
from arborix.operators import archives as ar
from arborix.operators import documents as docs
from arborix.operators import evaluation as ev
from arborix.operators import evidence, limits, operations, validators
from arborix.operators import inventory as inv

S = "sha256:" + "1" * 64


def test_limits(spark):
    rows = [("b", "maxFiles", 500, "client", 1), ("b", "maxFiles", 100, "policy", 2), ("b", "maxPathDepth", 64, "policy", 2), ("b", "maxFileBytes", 1 << 40, "request", 3), ("b", "x", 1, "request", 3), ("b", "maxReferrers", -1, "request", 3)]
    asked = spark.createDataFrame(rows, "bundle_id string, bound string, value long, origin string, precedence int")
    got = {r.bound: (r.value, r.origin) for r in limits.effective(asked).collect()}
    assert (got["maxFiles"], got["maxPathDepth"], got["maxFileBytes"]) == ((100, "policy"), (64, "default"), (1 << 30, "default"))
    assert {(r.bound, r.code) for r in limits.limit_findings(asked).collect()} == {("maxFileBytes", "over-ceiling"), ("x", "unknown-bound"), ("maxReferrers", "negative")}


def test_validators_fail_alone(spark):
    files = spark.createDataFrame([("a", "x.json", b"{}"), ("b", "x.json", b"{"), ("c", "y", b"1")], "bundle_id string, path string, content binary")
    checks = {"json": lambda p, c: [] if not p.endswith(".json") else json.loads(c) and [] or [], "short": lambda p, c: [("too-short", p)] if c == b"1" else []}
    found = validators.run_validators(files, checks)
    assert {(r.bundle_id, r.validator, r.code) for r in found.collect()} == {("b", "json", "validator-failed"), ("c", "short", "too-short")}
    assert {r.bundle_id: r.status for r in validators.statuses(files, found, checks).collect()} == {"a": "pass", "b": "fail", "c": "fail"}
    assert {r.status for r in validators.statuses(files, found.limit(0), {}).collect()} == {"not-evaluated"}


def test_evidence_is_rejected_for_the_first_reason(spark):
    said = json.dumps({"_type": docs.STATEMENT_TYPE, "predicate": {"builder": "me"}, "predicateType": "p", "subject": [{"digest": {"sha256": "1" * 64}}]}, separators=(",", ":"))
    wrap = lambda text, sigs=1: json.dumps({"payloadType": "t", "payload": base64.b64encode(text.encode()).decode(), "signatures": [{"keyid": "", "sig": "YQ=="}] * sigs})
    rows = [("ok", "e", wrap(said)), ("type", "x", wrap(said)), ("junk", "e", "no"), ("unsigned", "e", wrap(said, 0)), ("untrusted", "e", wrap(said)), ("predicate", "e", wrap(said.replace('"p"', '"q"'))), ("bound", "e", wrap(said.replace("1" * 64, "2" * 64)))]
    c = spark.createDataFrame([(S, *r) for r in rows], "subject_digest string, digest string, artifact_type string, envelope string")
    e = c.where("digest <> 'junk'").select("subject_digest", "digest", F.lit("t").alias("payload_type"), F.unbase64(F.get_json_object("envelope", "$.payload")).alias("payload"), F.when(F.col("digest") == "untrusted", F.array(F.lit(b"z"))).otherwise(F.array(F.lit(b"a"), F.lit(b"a"))).alias("signatures"))
    form = bytes(spark.range(1).select(references.pre_authentication(F.lit("t"), F.lit(said))).first()[0])
    signers = evidence.verified_keys(e, {"k": b"a"}, lambda key, signed, sig: sig == key and signed.startswith(form[:10]))
    assert signers.where("digest = 'ok'").first().key_ids == ["k"]
    got = {r.digest: (r.reason, r.matching) for r in evidence.judged(c, signers, ["p"], "e").collect()}
    assert got == {"ok": (None, True), "type": ("another type", False), "junk": ("not an envelope", True), "unsigned": ("no signature", True), "untrusted": ("no trusted signature", True), "predicate": ("predicate type", True), "bound": ("another subject", True)}


def test_build_verify_and_gate(spark):
    rows = [("a", "s", ".", "x", 0o640, b"1"), ("a", "t", "m", "y", 0o711, b"2"), ("b", "s", "", "X", 420, b"1"), ("b", "t", "", "x", 420, b"1"), ("c", "s", "m", "../x", 420, b"1")]
    sources = spark.createDataFrame(rows, "bundle_id string, source string, mount string, path string, mode int, content binary")
    built = operations.build(sources)
    assert {(r.bundle_id, r.code) for r in built.findings.collect()} == {("b", "case-collision"), ("c", "unsafe-path")}
    assert sorted((r.bundle_id, r.path, r.mode) for r in built.files.collect()) == [("a", "m/y", 493), ("a", "x", 420)]
    assert built.configs.first().tree_digest == inv.tree_digest(ar.inventory_of(built.files)).first().tree_digest
    assert [r.bundle_id for r in built.manifests.collect()] == ["a"]
    subjects = built.manifests.select("bundle_id", F.col("digest").alias("subject_digest"), F.lit(True).alias("by_digest"), F.lit("f").alias("format"), F.lit(2).alias("n_files"), F.lit(2).alias("total_size"), F.lit("").alias("tree_digest"))
    none = spark.createDataFrame([], "subject_digest string, digest string, identities array<struct<key_id:string,issuer:string,subject:string>>, log_verified boolean, via_fallback boolean, signed_at timestamp, statement struct<predicate_type:string,subject_digest:string,tree_digest:string,format:string,lock_digest:string,builder:string,sources:array<struct<name:string,type:string,url:string,tree_digest:string>>>")
    at = F.lit("2026-03-01").cast("timestamp")
    report = lambda want, rules: operations.verify(built.parts, want, subjects, rules, none, at).first()
    want = ar.inventory_of(built.files)
    good = report(want, ev.Rules())
    assert (good.trust, good.integrity, good.semantics, good.ok) == ("pass", "pass", "not-evaluated", True)
    assert report(want.withColumn("size", F.lit(9)), ev.Rules()).integrity == "fail"
    assert not report(want, ev.Rules(provenance_required=True)).ok
