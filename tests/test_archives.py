import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from arborix.operators import archives as ar
from arborix.operators import inventory as inv

FILES = "bundle_id string, path string, mode int, content binary"
LONG = "/".join(["directory"] * 12) + "/deep.txt"
TREE = [("b", "README.md", 420, b"hello world\n"), ("b", "app/run.sh", 493, b"#!/bin/sh\ns\n"), ("b", "bin.dat", 420, b"\x00\x01\xfe\xff"), ("b", "café/naïve.txt", 420, b"utf"), ("b", LONG, 420, b"deep"), ("b", "empty", 420, b""), ("c", "x", 420, b"y" * 5000)]


def packed(spark, members, tail=b"", cut=None):
    """Parts of an archive of (name, type, content) by the standard library."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, kind, content in members:
            info = tarfile.TarInfo(name)
            info.type, info.size, info.mode = kind, len(content), 0o755 if kind == tarfile.DIRTYPE else 0o644
            tar.addfile(info, io.BytesIO(content))
    data = (gzip.compress(out.getvalue()) + tail)[:cut]
    return spark.createDataFrame([("b", i, data[i * 64 : i * 64 + 64]) for i in range(-(-len(data) // 64))], "bundle_id string, part int, data binary")


def codes(spark, parts, declared, **limits):
    rows = [("b", p, 420, c) for p, c in declared]
    inventory = ar.inventory_of(spark.createDataFrame(rows, FILES))
    return sorted((r.code, r.message) for r in ar.archive_findings(ar.entries(parts), inventory, **limits).collect())


def test_round_trip_in_small_parts(spark):
    files = spark.createDataFrame(TREE, FILES)
    parts = ar.pack(files, part_bytes=50).cache()
    assert parts.groupBy("bundle_id").count().where("count < 2").count() == 0
    read, want = ar.entries(parts), ar.inventory_of(files)
    assert ar.archive_findings(read, want, ar.descriptors(parts)).collect() == []
    assert ar.deviations(read, "canonical").collect() == []
    got = ar.expand(parts, want, ar.archive_findings(read, want))
    assert sorted(map(tuple, got.collect())) == sorted(TREE)
    digest = lambda df: sorted(map(tuple, inv.tree_digest(df).collect()))
    assert digest(ar.inventory_of(got)) == digest(want)


def test_the_standard_library_reads_what_is_written(spark):
    parts = ar.pack(spark.createDataFrame(TREE[:6], FILES), part_bytes=100).orderBy("part").collect()
    with tarfile.open(fileobj=io.BytesIO(gzip.decompress(b"".join(r.data for r in parts)))) as tar:
        names = tar.getnames()
        assert {m.name: tar.extractfile(m).read() for m in tar if m.isfile()} == {p: c for _, p, _, c in TREE[:6]}
        assert all((m.mtime, m.uid, m.gid) == (0, 0, 0) for m in tar)
    dirs = [n for n in names if n not in {r[1] for r in TREE}]
    assert names[: len(dirs)] == sorted(dirs) and names[len(dirs) :] == sorted(names[len(dirs) :])


REG, DIR = tarfile.REGTYPE, tarfile.DIRTYPE


@pytest.mark.parametrize(
    ("members", "declared", "want"),
    [
        ([("a", REG, b"1")], [("a", b"1")], set()),
        ([("/etc/x", REG, b"1")], [("/etc/x", b"1")], {"unsafe-path"}),
        ([("a/../../x", REG, b"1")], [("a/../../x", b"1")], {"unsafe-path"}),
        ([("CON", REG, b"1")], [("CON", b"1")], {"unsafe-path"}),
        ([("a\\b", REG, b"1")], [("a\\b", b"1")], {"unsafe-path"}),
        ([("a", REG, b"1"), ("b", REG, b"2")], [("a", b"1")], {"invalid-artifact"}),
        ([("a", REG, b"1")], [("a", b"1"), ("b", b"2")], {"invalid-artifact"}),
        ([("a", REG, b"1"), ("a", REG, b"1")], [("a", b"1")], {"invalid-artifact"}),
        ([("a", REG, b"2")], [("a", b"1")], {"digest-mismatch"}),
        ([("a", REG, b"22")], [("a", b"1")], {"digest-mismatch"}),
        ([("a", tarfile.SYMTYPE, b"")], [], {"unsupported-file"}),
        ([("a", tarfile.LNKTYPE, b"")], [], {"unsupported-file"}),
        ([("a", tarfile.CHRTYPE, b"")], [], {"unsupported-file"}),
        ([("a", tarfile.FIFOTYPE, b"")], [], {"unsupported-file"}),
        ([("a", DIR, b"")], [("a", b"1")], {"invalid-artifact"}),
    ],
)
def test_hostile_entries(spark, members, declared, want):
    assert {c for c, _ in codes(spark, packed(spark, members), declared)} == want


def test_hostile_bytes(spark):
    good = [("a", REG, b"1")]
    assert ("invalid-artifact", "data after the gzip member") in codes(spark, packed(spark, good, tail=gzip.compress(b"more")), [("a", b"1")])
    assert ("invalid-artifact", "truncated") in codes(spark, packed(spark, good, cut=40), [("a", b"1")])
    junk = spark.createDataFrame([("b", 0, b"not gzip")], "bundle_id string, part int, data binary")
    assert ("invalid-artifact", "not valid gzip") in codes(spark, junk, [("a", b"1")])
    bomb = packed(spark, [("a", REG, bytes(1 << 20))])
    assert codes(spark, bomb, [("a", bytes(1 << 20))]) == [("limit-exceeded", "expands too far")]
    assert ar.entries(bomb, max_expanded=1000).select(F.substring_index("name", ":", 1)).first()[0] == "limit-exceeded"
    assert codes(spark, packed(spark, good), [("a", b"1")], max_files=0) == [("limit-exceeded", "too many entries")]


def test_deviations_are_notes_or_errors_by_level(spark):
    parts = packed(spark, [("z", REG, b""), ("d", DIR, b""), ("a", REG, b""), ("m/x", REG, b""), ("A", REG, b"")])
    got = {(r.deviation, r.name): r.severity for r in ar.deviations(ar.entries(parts)).collect()}
    assert got == {("missing-parent", "m"): "error", ("needless-directory", "d"): "note", ("directory-after-file", "d"): "note", ("order", "a"): "note", ("order", "A"): "note", ("case", "A"): "note"}
    assert {r.severity for r in ar.deviations(ar.entries(parts), "canonical").collect()} == {"error"}
    with pytest.raises(ValueError):
        ar.deviations(parts, "bytes")


def test_expand_reads_an_archive_whole_after_a_late_broadcast(spark):
    """The join that leaves out faulty bundles is planned by a sort and broadcast once its sizes are known."""
    files = spark.createDataFrame(TREE, FILES)
    parts = ar.pack(files, part_bytes=20).repartition(4, "part").cache()
    faults = spark.createDataFrame([("other",)], "bundle_id string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = ar.expand(parts, ar.inventory_of(files), faults).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted((r.bundle_id, r.path, r.mode, bytes(r.content)) for r in got) == sorted(TREE)
