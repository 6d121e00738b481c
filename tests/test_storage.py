import hashlib
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from arborix.functions import durations, paths
from arborix.operators import archives as ar
from arborix.operators import conformance, operations, policies, specs
from arborix.operators import documents as docs
from arborix.operators import inventory as inv
from arborix.sources import directory, layout, resolvers, sinks, stage, transport


def sha(data):
    return "sha256:" + hashlib.sha256(data).hexdigest()


def blobs(spark, *contents):
    return spark.createDataFrame([(sha(c), c) for c in contents], "digest string, content binary")


def rows(spark, *manifests, subject=None):
    return spark.createDataFrame([("", sha(c), "m", len(c), "a", tag, subject, i) for i, (c, tag) in enumerate(manifests)], "layout string, digest string, media_type string, size long, artifact_type string, tag string, subject string, seq long")


def tags(spark, root):
    return {(r.tag, r.digest) for r in sinks.catalog_of(spark, root).where("tag is not null").collect()}


def test_publish_names_data_last(spark, tmp_path):
    root = f"file://{tmp_path}/layout"
    states = sinks.publish(blobs(spark, b"one", b"two"), rows(spark, (b"one", "v1")), root, rows(spark, (b"two", None), subject=sha(b"one")))
    assert {r.state for r in states.collect()} == {"written"}
    assert tags(spark, root) == {("v1", sha(b"one"))}
    assert layout.blob_faults(layout.read_catalog(spark, root), layout.read_blobs(spark, root)).count() == 0
    assert {r.digest: r.subject for r in layout.read_catalog(spark, root).collect()} == {sha(b"one"): None, sha(b"two"): sha(b"one")}
    # again: nothing changes; another manifest takes the tag
    assert {r.state for r in sinks.publish(blobs(spark, b"one"), rows(spark, (b"one", "v1")), root).collect()} == {"present"}
    sinks.publish(blobs(spark, b"three"), rows(spark, (b"three", "v1")), root)
    assert tags(spark, root) == {("v1", sha(b"three"))} and sinks.catalog_of(spark, root).count() == 2


def test_publish_that_dies_or_is_refused_leaves_the_index(spark, tmp_path):
    root = f"file://{tmp_path}/layout"
    sinks.publish(blobs(spark, b"one"), rows(spark, (b"one", "v1")), root)

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sinks.publish(blobs(spark, b"two"), rows(spark, (b"two", "v1")), root, before_index=die)
    assert tags(spark, root) == {("v1", sha(b"one"))}
    assert {r.state for r in sinks.publish(blobs(spark, b"two"), rows(spark, (b"two", "v1")), root).collect()} == {"present"}
    assert tags(spark, root) == {("v1", sha(b"two"))}
    with pytest.raises(sinks.NotPublished):
        sinks.publish(spark.createDataFrame([(sha(b"x"), b"y")], "digest string, content binary"), rows(spark, (b"x", "v1")), root)
    with pytest.raises(sinks.NotPublished):
        sinks.publish(blobs(spark, b"z"), rows(spark, (b"not there", "v2")), root)
    assert tags(spark, root) == {("v1", sha(b"two"))}


def test_a_broken_blob_is_repaired(spark, tmp_path):
    place = tmp_path / "l" / "blobs" / "sha256" / sha(b"one")[7:]
    place.parent.mkdir(parents=True)
    place.write_bytes(b"torn")
    assert sinks.write_blobs(blobs(spark, b"one"), str(tmp_path / "l")).first().state == "repaired" and place.read_bytes() == b"one"
    assert not [f for f in os.listdir(place.parent) if f.startswith(".")]


def test_copy_takes_all_referrers(spark, tmp_path):
    a, b = (f"file://{tmp_path}/{n}" for n in "ab")
    data = blobs(spark, b"one", b"two", b"ev")
    sinks.publish(data, rows(spark, (b"one", "v1"), (b"two", "v2")), a, rows(spark, (b"ev", None), subject=sha(b"one")))
    sinks.copy_subjects(spark, a, b, [sha(b"one")], blobs(spark, b"one", b"ev"), {sha(b"one"): "copy"})
    assert {(r.tag, r.digest, r.subject) for r in sinks.catalog_of(spark, b).collect()} == {("copy", sha(b"one"), None), (None, sha(b"ev"), sha(b"one"))}
    assert sorted(r.content for r in layout.read_blobs(spark, b).collect()) == [b"ev", b"one"]


def test_documents_are_whole_and_never_overwritten(tmp_path):
    place = str(tmp_path / "x.lock")
    sinks.write_document("one", place)
    with pytest.raises(sinks.DestinationExists):
        sinks.write_document("two", place)
    assert open(place).read() == "one" and os.listdir(tmp_path) == ["x.lock"]
    sinks.write_document("two", place, replace=True)
    assert open(place).read() == "two" and os.stat(place).st_mode & 0o777 == 0o644
    os.mkdir(f"{tmp_path}/y.lock.lock")
    with pytest.raises(sinks.DestinationExists):
        sinks.write_document("x", str(tmp_path / "y.lock"))


def test_trees_are_written_whole(spark, tmp_path):
    files = spark.createDataFrame([("a", "d/x", 0o755, b"1"), ("a", "y", 0o644, None), ("b", "x", 0o644, b"2"), ("c", "../x", 0o644, b"3"), ("d", "x", 0o644, b"4"), ("d", "x", 0o644, b"4")], "bundle_id string, path string, mode int, content binary")
    root = tmp_path / "out"
    (root / "b").mkdir(parents=True)
    assert sinks.write_trees(files, str(root)) == {"a": "ok", "b": "destination-exists", "c": "unsafe-path", "d": "incomplete"}
    assert (root / "a/d/x").read_bytes() == b"1" and (root / "a/y").read_bytes() == b"" and os.stat(root / "a/d/x").st_mode & 0o777 == 0o755
    assert sorted(os.listdir(root)) == ["a", "b"] and os.listdir(root / "b") == []

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sinks.write_trees(files.where("bundle_id = 'd'").dropDuplicates(), str(root), before_rename=die)
    assert "d" not in os.listdir(root)
    assert sinks.write_trees(files.where("bundle_id = 'd'").dropDuplicates(), str(root)) == {"d": "ok"}


def test_resolvers(spark, tmp_path):
    for name, content in (("s/a.txt", b"1"), ("s/b.md", b"2"), ("t/c", b"3")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "s/link").symlink_to(tmp_path / "t/c")
    schema = "bundle_id string, source string, type string, mount string, include array<string>, exclude array<string>, config string"
    path = lambda p: json.dumps({"path": p})
    git = json.dumps({"url": "https://h.org/r", "ref": "main", "subPath": "sub"})
    declared = [("b", "s", "path", "m", ["*.txt"], [], path("s")), ("b", "links", "path", "", [], [], path("s")), ("b", "none", "path", "", ["*.zip"], [], path("t")), ("b", "up", "path", "", [], [], path("../x")), ("b", "abs", "path", "", [], [], path(str(tmp_path))), ("b", "odd", "path", "", [], [], '{"path":"s","x":"y"}'), ("b", "svn", "svn", "", [], [], "{}"), ("b", "g", "git", "v", [], [], git), ("b", "bad", "git", "", [], [], json.dumps({"url": "http://h.org", "ref": "x"}))]

    def fetch(spark, sources):
        assert [s.source for s in sources] == ["g"]
        tree = [("sub/x", "100755", b"x"), ("sub/d", "040000", None), ("other", "100644", b"o")]
        return spark.createDataFrame([("b", "g", "c0ffee", *t) for t in tree], "bundle_id string, source string, commit string, path string, git_mode string, content binary")

    chosen = resolvers.Resolvers(resolvers.PathResolver(str(tmp_path)), resolvers.GitResolver(fetch, spark))
    got = chosen.resolve(spark, spark.createDataFrame(declared, schema))
    assert {(r.source, r.mount, r.path, r.mode, bytes(r.content)) for r in got.files.collect()} == {("s", "m", "a.txt", 0o644, b"1"), ("g", "v", "x", 0o755, b"x")}
    assert {(r.source, r.code) for r in got.findings.collect()} >= {("links", "unsupported-file"), ("none", "invalid-input"), ("up", "invalid-input"), ("abs", "invalid-input"), ("odd", "invalid-input"), ("svn", "unsupported-source"), ("bad", "invalid-input")}
    material = {r.source: r for r in got.material.collect()}
    assert material["s"].resolver == "arborix/path/v1" and material["s"].requested == {"path": "s"}
    want = inv.tree_digest(spark.createDataFrame([("x", "a.txt", 420, 1, sha(b"1"))], "bundle_id string, path string, mode int, size long, digest string")).first().tree_digest
    assert material["s"].tree_digest == want
    locked = spark.createDataFrame([("b", "s", sha(b"old"))], "bundle_id string, source string, tree_digest string")
    again = chosen.resolve(spark, spark.createDataFrame(declared[:1], schema), locked)
    assert [(r.source, r.code) for r in again.findings.collect()] == [("s", "stale-lock")] and again.files.count() == 0
    with pytest.raises(ValueError):
        resolvers.Resolvers(resolvers.PathResolver("."), resolvers.PathResolver("/"))


def test_files_that_change_or_are_too_many(spark, tmp_path, monkeypatch):
    from arborix.sources import directory

    for n in "abc":
        (tmp_path / n).write_bytes(b"12345")
    files, found = directory.read_directories(spark, {"b": str(tmp_path)}, max_files=2)
    assert files.count() == 0 and [r.code for r in found.collect()] == ["limit-exceeded"]
    real = directory.listing
    monkeypatch.setattr(directory, "listing", lambda *a: real(*a).withColumn("size", F.when(F.col("path") == "a", 4).otherwise(F.col("size"))))
    files, found = directory.read_directories(spark, {"b": str(tmp_path)})
    assert sorted(r.path for r in files.collect()) == ["b", "c"] and [(r.path, r.code) for r in found.collect()] == [("a", "source-changed")]


def test_policies_and_templates(spark):
    kinds = docs.Kinds()
    text = f"""
apiVersion: {kinds.api_version}
kind: {policies.POLICY_KIND}
metadata: {{name: p}}
spec:
  signatures: {{threshold: 1, identities: [{{issuer: i, subjectPattern: "a.*"}}], requireTransparencyLog: true}}
  evidence: {{maxAge: 36h}}
  provenance: {{sources: {{allowedHosts: [h.org]}}}}
  limits: {{maxFiles: 7}}
"""
    name, rules, asked = policies.parse_policy(text)
    assert (name, rules.max_age_seconds, rules.identities[0].issuer, rules.require_log, rules.source_hosts, asked) == ("p", 129600, "i", True, ["h.org"], {"maxFiles": 7})
    for old, new, code in (("threshold: 1", "threshold: true", "invalid-input"), ("a.*", "(", "invalid-input"), ("maxFiles: 7", "maxFiles: 99999999", "invalid-input"), ("36h", "3d", "invalid-input"), ("spec:", "spec:\n  spec: 1", "invalid-input"), ("name: p", "name: P", "invalid-input"), ("kind:", "kind: x\nkind:", "invalid-input"), ("apiVersion: ", "apiVersion: x", "unsupported-version")):
        with pytest.raises(policies.PolicyFault) as e:
            policies.parse_policy(text.replace(old, new, 1))
        assert e.value.code == code, old
    for path in (".", "a: b", "- x", 'q"\n#', "ü"):
        made = specs.parse_specs(spark.createDataFrame([("b", specs.template(path))], "bundle_id string, text string"))
        assert specs.spec_findings(made).count() == 0
        assert json.loads(specs.declared_sources(made).first().config) == {"path": path}
    assert durations.micros("-1h30m") == -5_400_000_000
    with pytest.raises(ValueError):
        durations.micros("1")


def test_the_second_reader_agrees_with_the_first(spark):
    """On every kind of path, and on bundles that are sound or broken in each part."""
    from tests.test_inventory import plain_code

    odd = ["a", "a/b", "", "/a", "a/", "a//b", "./a", "a/../b", "con", "x/COM1.txt", "a ", "a.", "a:b", "a\x01", "cafe\u0301", "é", "..", "a/.."]
    for p in odd:
        assert conformance.bad_path(p) == (plain_code(p) != "ok" or p == "cafe\u0301"), p
    one = lambda p: spark.range(1).select(paths.normalized(F.lit(p))).first()[0]
    assert one("cafe\u0301").path == "café" and one(bytearray(b"\xff\xfe")).message == "not UTF-8: \ufffd\ufffd" and one("a/").code == "unsafe-path"
    files = spark.createDataFrame([("b", f"d{i}/f{i}", 420 if i % 2 else 493, os.urandom(i * 700)) for i in range(9)], "bundle_id string, path string, mode int, content binary")
    built = operations.build(files.select("bundle_id", F.lit("s").alias("source"), F.lit("").alias("mount"), "path", "mode", "content"))
    parts = {r.part: bytes(r.data) for r in built.parts.collect()}
    whole = ("b", built.manifests.first().manifest.encode(), built.configs.first().config.encode(), b"".join(parts[i] for i in sorted(parts)))
    check = lambda m, c, x, level="canonical": {(r.deviation.split(":")[0], r.severity) for r in conformance.conformance(spark.createDataFrame([("b", m, c, x)], "bundle_id string, manifest binary, config binary, layer binary"), level).collect()}
    assert check(*whole[1:]) == set()
    assert check(whole[1], whole[2].replace(b":", b": ", 1), whole[3]) == {("config", "error")}
    assert ("layer", "error") in check(whole[1], whole[2], whole[3][:-20], "structure") and check(b"", b"", None) == {("not readable", "error")}
    for text, same in (('{"a":1,"b":[true,null,"x"]}', True), ('{"b":1,"a":1}', False), ('{"a":1,"a":1}', False), ("[1, 2]", False), ("-0", False), ("01", False), ('"\\u0041"', False), ('"\\u0001"', True), ('"\\n"', True), ('"\\u000a"', False), ("1.0", False), ("", False), ("{", False), ('{"\U0001f600":1,"\ufffd":2}', True), ("18446744073709551616", False)):
        assert conformance.is_canonical(text) is same, text


def test_steps_need_a_shared_folder(spark):
    class Elsewhere:
        class sparkContext:
            master = "k8s://x"
            getConf = classmethod(lambda cls: {})

        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        stage.folder(Elsewhere)
    assert stage.written(spark.range(3), "x").count() == 3
    assert ar.inventory_of(spark.createDataFrame([], "bundle_id string, path string, mode int, content binary")).count() == 0


def test_long_rows_are_written_in_small_row_groups(spark):
    """A row group, and so what its readers and a shuffle take at once, ends by bytes, after a short row too."""
    def packed(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([os.urandom(1 << 20 if n else 1)])], names=["part", "data"])

    parts = spark.range(0, 60, 1, 1).mapInArrow(packed, "part long, data binary")
    files = [f.removeprefix("file://") for f in stage.written(parts, "long").inputFiles()]
    meta = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in meta) == 60
    assert max(m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)) < 20 << 20


def test_a_walk_holds_no_folder_whole(tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    for i in range(50):
        (tmp_path / f"d/cafe\u0301{i}").write_bytes(b"")
    taken, real = [], os.scandir

    class Counted:
        def __init__(self, place):
            self.found = real(place)

        def __enter__(self):
            return (taken.append(e) or e for e in self.found)

        def __exit__(self, *_):
            self.found.close()

    monkeypatch.setattr(directory.os, "scandir", Counted)
    walk = directory._walk("b", str(tmp_path))
    first = next(walk)
    assert len(taken) == 2 and first[6].startswith("d/café") and first[2] != first[6]
    assert len({first[2], *(r[2] for r in walk)}) == 50


def test_a_layout_is_a_transport(spark, tmp_path):
    store = transport.LayoutTransport(spark, f"file://{tmp_path}/layout")
    assert {r.state for r in store.push(blobs(spark, b"one", b"ev"), rows(spark, (b"one", "v1")), rows(spark, (b"ev", None), subject=sha(b"one"))).collect()} == {"written"}
    wanted = spark.createDataFrame([("v1",), ("v2",)], "tag string")
    assert {tuple(r) for r in store.resolve(wanted).collect()} == {("v1", sha(b"one"), "ok"), ("v2", None, "not-found")}
    (tmp_path / "layout/blobs/sha256" / sha(b"ev")[7:]).write_bytes(b"EV")
    asked = spark.createDataFrame([(sha(b"one"), 3), (sha(b"ev"), 2), (sha(b"x"), 1)], "digest string, size long")
    assert {(r.digest, r.content and bytes(r.content), r.code) for r in store.fetch(asked).collect()} == {(sha(b"one"), b"one", "ok"), (sha(b"ev"), None, "digest-mismatch"), (sha(b"x"), None, "not-found")}
    subjects = spark.createDataFrame([(sha(b"one"),)], "digest string")
    assert [r.digest for r in store.referrers(subjects, "a").collect()] == [sha(b"ev")] and store.referrers(subjects, "b").count() == 0
