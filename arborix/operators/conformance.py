"""A second reader of bundles, which shares no parser, no path rule and no encoder with the first.

It reads a bundle's manifest, config and layer with the standard library, and says where they depart from the format. Whether
the two readers agree is a test of both. A bundle is read in whole by one task: this is a checker, not the way to read many
large bundles.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import posixpath
import re
import struct
import tarfile
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from .documents import Kinds

LEVELS = ("structure", "canonical")
_TOKEN = re.compile(r'[{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\(?:["\\bfnrt]|u00(?:0[0-7be-f]|1[0-9a-f])))*"|-?(?:0|[1-9][0-9]*)|true|false|null')
_DEVICES = re.compile(r"(?i)(?:con|prn|aux|nul|(?:com|lpt)[1-9])(?:\..*)?")


def is_canonical(text: str) -> bool:
    """Whether a text is the canonical form of a JSON value of integers: no byte that could be left out, names ascending by UTF-16 units and none twice."""
    at = 0
    for m in _TOKEN.finditer(text):
        if m.start() != at or m[0] == "-0":
            return False
        at = m.end()
    if at != len(text):
        return False

    def ordered(pairs: list) -> dict:
        units = [k.encode("utf-16-be", "surrogatepass") for k, _ in pairs]
        if any(a >= b for a, b in zip(units, units[1:], strict=False)):
            raise ValueError("order of names")
        return dict(pairs)

    try:
        json.loads(text, object_pairs_hook=ordered)
    except (ValueError, RecursionError):
        return False
    return all(-(2**63) <= int(m[0]) < 2**64 for m in _TOKEN.finditer(text) if m[0].lstrip("-").isdigit())


def bad_path(path: str) -> bool:
    """Whether a path isn't the plain relative form of itself, or holds what some system can't store."""
    if path in ("", ".") or path.startswith("/") or posixpath.normpath(path) != path or path.split("/")[0] == "..":
        return True
    if unicodedata.normalize("NFC", path) != path or any(unicodedata.category(c) == "Cc" for c in path) or re.search(r'[<>:"|?*\\]', path):
        return True
    return any(x[-1] in " ." or _DEVICES.fullmatch(x) for x in path.split("/"))


def match_inventory(declared: DataFrame, delivered: DataFrame) -> DataFrame:
    """(bundle_id, path, what): rows of one inventory that the other doesn't hold with all columns equal, as often; and bundles whose number or total differs.

    Rows are counted, +1 for declared and -1 for delivered, over all columns; nothing is joined.
    """
    columns = ["bundle_id", "path", "mode", "size", "digest"]
    both = declared.select(*columns, F.lit(1).alias("n")).unionByName(delivered.select(*columns, F.lit(-1).alias("n")))
    left = both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    rows = left.select("bundle_id", "path", F.when(F.col("n") > 0, "only declared").otherwise("only delivered").alias("what"))
    sums = both.groupBy("bundle_id").agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("size")).alias("total"))
    totals = sums.select("bundle_id", F.lit("").alias("path"), F.when(F.col("count") != 0, "count").when(F.col("total") != 0, "total").alias("what")).where("what is not null")
    return rows.unionByName(totals)


def _check(manifest: bytes, config: bytes | None, layer: bytes | None, kinds: Kinds, domain: str, max_bytes: int) -> Iterator[tuple[str, bool]]:
    """(what, whether it is about structure) of one bundle."""
    name = lambda data: "sha256:" + hashlib.sha256(data).hexdigest()
    try:
        m, c = json.loads(manifest), json.loads(config or b"")
        named, packed, files = m["config"], m["layers"][0], c["files"]
        want = {f["path"]: (f["mode"], f["size"], f["digest"]) for f in files}
    except (ValueError, KeyError, TypeError, IndexError, RecursionError):
        yield "not readable", True
        return
    for what, data in (("manifest", manifest), ("config", config)):
        if not is_canonical(data.decode("utf-8", "replace")):
            yield f"{what}: not canonical JSON", False
    if (m.get("schemaVersion"), m.get("artifactType"), len(m["layers"])) != (2, kinds.artifact_type, 1):
        yield "manifest: version, type or layers", True
    if (named.get("digest"), named.get("size")) != (name(config), len(config)):
        yield "config: another blob than named", True
    if layer is None or (packed.get("digest"), packed.get("size")) != (name(layer), len(layer)):
        yield "layer: another blob than named", True
    if (c.get("schemaVersion"), c.get("format")) != (1, kinds.format):
        yield "config: version or format", True
    if (c.get("fileCount"), c.get("totalSize")) != (len(files), sum(f["size"] for f in files)):
        yield "config: count or total", True
    listed = [f["path"].encode() for f in files]
    if listed != sorted(set(listed)):
        yield "config: order of files", True
    stream = domain.encode() + struct.pack(">Q", len(files))
    for f in files:
        stream += struct.pack(">I", len(f["path"].encode())) + f["path"].encode() + struct.pack(">IQ", f["mode"], f["size"]) + bytes.fromhex(f["digest"][7:])
    if c.get("treeDigest") != name(stream):
        yield "config: tree digest", True
    for path in want:
        if bad_path(path):
            yield f"path: {path}", True
    if layer is None:
        return
    try:
        with gzip.open(io.BytesIO(layer)) as f:
            raw = f.read(max_bytes + 1)
        if len(raw) > max_bytes:
            yield "layer: too long", True
            return
        got, names, last = {}, set(), {}
        for e in tarfile.open(fileobj=io.BytesIO(raw), mode="r:"):
            kind = "file" if e.isreg() else "directory" if e.isdir() else "other"
            if kind == "other":
                yield f"entry of another type: {e.name}", True
                continue
            if e.name in names:
                yield f"repeated: {e.name}", True
            if posixpath.dirname(e.name) and posixpath.dirname(e.name) not in names:
                yield f"missing parent: {e.name}", True
            if last.get(kind, "").encode() >= e.name.encode() or (kind == "directory" and "file" in last):
                yield f"order: {e.name}", False
            if e.mode not in ((0o755,) if kind == "directory" else (0o644, 0o755)) or e.mtime or e.uid or e.gid:
                yield f"header: {e.name}", False
            names.add(e.name)
            last[kind] = e.name
            if kind == "file":
                data = tarfile.open(fileobj=io.BytesIO(raw), mode="r:").extractfile(e).read()
                got[e.name] = (e.mode, len(data), name(data))
    except (OSError, EOFError, tarfile.TarError, ValueError) as e:
        yield f"layer: {type(e).__name__}", True
        return
    for path in sorted(got.keys() | want.keys()):
        if got.get(path) != want.get(path):
            yield f"file: {path}", True


def conformance(bundles: DataFrame, level: str = "structure", kinds: Kinds = Kinds(), domain: str = digests.TREE_DOMAIN, max_bytes: int = 1 << 30) -> DataFrame:
    """(bundle_id, deviation, severity) of bundles (bundle_id, manifest, config, layer, as bytes); faults of structure are errors at any level, departures from the canonical form notes at level structure and errors at level canonical."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(b, what, "error" if hard or level == "canonical" else "note") for b, m, c, x in zip(f["bundle_id"], f["manifest"], f["config"], f["layer"], strict=True) for what, hard in _check(m or b"", c, x, kinds, domain, max_bytes)]
            yield pd.DataFrame(out, columns=["bundle_id", "deviation", "severity"])

    return bundles.select("bundle_id", "manifest", "config", "layer").mapInPandas(run, "bundle_id string, deviation string, severity string")
