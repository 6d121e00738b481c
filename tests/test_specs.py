import hashlib
import json

import pytest

from arborix.functions import faults, globs
from arborix.operators import documents as docs
from arborix.operators import specs

K = docs.Kinds()
GOOD = {"apiVersion": K.api_version, "kind": "Bundle", "metadata": {"name": "b"}, "spec": {"sources": [{"name": "z", "type": "git", "mountPath": ".", "include": ["b", "a", "b"], "config": {"url": "https://h/x", "depth": 1}}, {"name": "a", "type": "path"}]}}
YAML = f"""
kind: Bundle   # comments and order don't count
apiVersion: {K.api_version}
metadata: {{name: b}}
spec:
  sources:
    - {{type: path, name: a}}
    - name: z
      type: git
      include: [a, b]
      config: {{depth: 1, url: "https://h/x"}}
"""


def changed(path, value):
    out = json.loads(json.dumps(GOOD))
    at = out
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return json.dumps(out)


def parsed(spark, *texts):
    return specs.parse_specs(spark.createDataFrame(list(enumerate(texts)), "bundle_id long, text string"))


def test_spelling_does_not_change_the_digest(spark):
    pytest.importorskip("yaml")
    rows = parsed(spark, json.dumps(GOOD), YAML).collect()
    want = '{"apiVersion":"%s","kind":"Bundle","metadata":{"name":"b"},"spec":{"sources":[{"name":"a","type":"path"},{"config":{"depth":1,"url":"https://h/x"},"include":["a","b"],"name":"z","type":"git"}]}}' % K.api_version
    assert [r.normal for r in rows] == [want] * 2
    assert {r.digest for r in rows} == {"sha256:" + hashlib.sha256(want.encode()).hexdigest()}


def test_faults_of_specs(spark):
    source = ["spec", "sources", 0]
    cases = {
        "not a strict document": [None, "", "[]", "kind: a\nkind: b", "{}\n---\n{}", changed(["extra"], 1), changed([*source, "colour"], 1), changed([*source, "config"], "x"), changed([*source, "include"], [1])],
        "api version": ["{}", changed(["apiVersion"], "v0")],
        "kind": [changed(["kind"], "Lock")],
        "name": [changed(["metadata"], {}), changed(["metadata", "name"], "A")],
        "no sources": [changed(["spec"], {}), changed(["spec", "sources"], [])],
        "source name": [changed([*source, "name"], "-"), changed(source, {})],
        "no source type": [changed([*source, "type"], "")],
        "source type": [changed([*source, "type"], "svn")],
        "mount path": [changed([*source, "mountPath"], "/a"), changed([*source, "mountPath"], "a/../b")],
        "pattern": [changed([*source, "exclude"], ["a[b"])],
        "repeated source": [changed([*source, "name"], "a")],
    }
    texts = [(t, m) for m, ts in cases.items() for t in ts] + [(json.dumps(GOOD), None)]
    found = {r.bundle_id: r.message for r in specs.spec_findings(parsed(spark, *(t for t, _ in texts))).collect()}
    assert [found.get(i) for i in range(len(texts))] == [m for _, m in texts]


def test_patterns_agree_with_the_compiler(spark):
    patterns = ["a", "**", "a/**/b", "a**", "", "/a", "a/", ".", "a/..", "...", ".a", "[a]", "[]a]", "[^a]", "[a", "a\\", "\\*", "\\*\\*", "*?", "[a/b]", "[", "[]", "[\\]]", "a]", "é/[é-ü]", "a//b", "*/**/*", "x\ny"]

    def ok(p):
        try:
            globs.to_regex(p)
        except globs.PatternError:
            return False
        return True

    got = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", specs.is_pattern(specs.F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in got} == {p: ok(p) for p in patterns}


def test_locks_provenance_and_inspection(spark):
    d = {i: "sha256:" + i * 64 for i in "123"}
    direct = specs.direct_specs(spark.createDataFrame([("x", "b", "/tmp/in/", ".", ["*"], None)], "bundle_id string, name string, path string, mount string, include array<string>, exclude array<string>"))
    spec = specs.parse_specs(direct)
    assert specs.spec_findings(spec).count() == 0
    row = specs.declared_sources(spec).first()
    assert (row.source, row.type, row.mount, row.include, row.config) == ("b", "path", "", ["*"], '{"path":"in"}')
    sources = spark.createDataFrame([("x", "b", "git", "r", "", {"url": "https://h", "a": "1"}, {}, d["1"], "", ["b", "a"], [])], "bundle_id string, name string, type string, resolver string, resolver_version string, requested map<string,string>, resolved map<string,string>, tree_digest string, mount string, include array<string>, exclude array<string>")
    files = spark.createDataFrame([("x", "p/é", "b", "é", 420, 1, d["2"]), ("x", "a", "b", "a", 493, 2, d["3"])], "bundle_id string, path string, source string, source_path string, mode int, size long, digest string")
    lock = specs.encode_locks(spec, sources, files).first()
    body = json.loads(lock.lock)
    assert json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == lock.lock
    assert [f["path"] for f in body["files"]] == ["a", "p/é"] and body["sources"][0]["include"] == ["a", "b"] and "mountPath" not in body["sources"][0]
    read = docs.parse(spark.createDataFrame([("x", lock.lock)], "bundle_id string, text string"), docs.LOCK)
    assert docs.lock_findings(read).count() == 0
    seen = specs.inspect_locks(read).first()
    assert (seen.n_sources, seen.n_files, seen.tree_digest, seen.confidence) == (1, 2, body["treeDigest"], "resolved")
    assert specs.inspect_specs(spec).first().confidence == "authored"
    said = specs.provenance(read.withColumn("lock_digest", specs.F.lit(lock.digest)), spark.createDataFrame([("x", d["3"])], "bundle_id string, subject_digest string"), "p", "t", "me", "1").first().statement
    said = json.loads(said)
    assert said["subject"] == [{"digest": {"sha256": "3" * 64}}] and said["predicate"]["bundle"]["lockDigest"] == lock.digest
    assert said["predicate"]["buildDefinition"]["resolvedDependencies"] == [{"digest": {"sha256": "1" * 64}, "name": "b", "uri": "https://h"}]
    kinds = spark.createDataFrame([(lock.lock,), ("kind: x",), ("{}",)], "t string").select(specs.document_kind(specs.F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["lock", "manifest", "manifest"]


def test_exit_codes(spark):
    codes = [("a", None), ("b", "stale-lock"), ("b", "policy-failed"), ("c", "canceled"), ("d", "new")]
    got = faults.worst_exits(spark.createDataFrame(codes, "bundle_id string, code string")).collect()
    assert {r.bundle_id: r.exit_code for r in got} == {"a": 0, "b": 5, "c": 6, "d": 10}
