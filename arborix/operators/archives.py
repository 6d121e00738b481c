"""Archives of file trees (a gzip member around a tar), written and read in parts so that memory doesn't grow with them.

An archive is rows (bundle_id, part, data). A bundle's parts pass one task in
order; what is held is one part, one header and, for contents, one file.
Empty bundles have no archive. Reading never raises: what is wrong with an
archive becomes a row of kind fault, and the rest of that archive is skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import digests, paths
from .inventory import whole_bundles

BLOCK, NAME_BYTES, PART_BYTES, PULL = 512, 100, 4 << 20, 1 << 18
DIRECTORY_MODE = 0o755
BATCH_ROWS = 1024
ENTRIES = pa.schema([("bundle_id", pa.string()), ("entry_no", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("mode", pa.int32()), ("size", pa.int64()), ("digest", pa.string())])
CONTENTS = pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])


class ArchiveFault(ValueError):
    """What is wrong with an archive: a code and a message."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def _octal(n: int, width: int) -> bytes:
    return b"%0*o\0" % (width - 1, n)


def _header(name: bytes, mode: int, size: int, kind: bytes) -> bytes:
    fields = [name.ljust(NAME_BYTES, b"\0"), _octal(mode, 8), _octal(0, 8), _octal(0, 8), _octal(size, 12), _octal(0, 12), b" " * 8, kind, bytes(100), b"ustar\00000", bytes(64), _octal(0, 8), _octal(0, 8)]
    block = b"".join(fields).ljust(BLOCK, b"\0")
    return block[:148] + b"%06o\0 " % sum(block) + block[156:]


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK)


def _pax_path(name: bytes) -> bytes:
    """A record whose leading number counts its own digits."""
    rest = len(b" path=\n") + len(name)
    total = next(rest + d for d in range(1, 20) if len(str(rest + d)) == d)
    return b"%d path=%s\n" % (total, name)


def _shortened(name: bytes) -> bytes:
    return name[:NAME_BYTES].decode(errors="ignore").encode()


def tar_entry(index: int, name: str, mode: int, content: bytes | None) -> tuple[bytes, int]:
    """The bytes of an entry (content None: a directory) and how many headers it took; a long name goes before it in a PAX record."""
    raw = (name + "/" if content is None else name).encode()
    out, used = b"", 1
    if len(raw) > NAME_BYTES:
        record = _pax_path(raw)
        out, used, raw = _header(b"PaxHeaders/%d" % index, 0o644, len(record), b"x") + _padded(record), 2, _shortened(raw)
    size = 0 if content is None else len(content)
    return out + _header(raw, mode, size, b"5" if content is None else b"0") + _padded(content or b""), used


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):  # row by row, so that one batch of contents isn't held twice
            yield tuple(c[i].as_py() for c in batch.columns)


def pack(files: DataFrame, part_bytes: int = PART_BYTES, level: int = 9) -> DataFrame:
    """(bundle_id, part, data) from (bundle_id, path, mode, content): directories first, then files, each by path."""
    dirs = files.select("bundle_id", F.explode(paths.parents(F.col("path"))).alias("path")).distinct()
    rows = files.select("bundle_id", "path", "mode", "content").unionByName(dirs.select("bundle_id", "path", F.lit(DIRECTORY_MODE).alias("mode"), F.lit(None).cast("binary").alias("content")))
    rows = whole_bundles(rows.withColumn("is_file", F.col("content").isNotNull()), "is_file", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(bundle: str, n: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bundle], pa.string()), pa.array([n], pa.int32()), pa.array([data], pa.binary())], names=["bundle_id", "part", "data"])

        for bundle, entries in groupby(_rows(batches), itemgetter(0)):
            # a plain header: no name, no time
            deflate, index, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
            out = bytearray()
            for _, path, mode, content in entries:
                data, used = tar_entry(index, path, mode, content)
                index += used
                out += deflate.compress(data)
                while len(out) >= part_bytes:
                    yield part(bundle, n, bytes(out[:part_bytes]))
                    del out[:part_bytes]
                    n += 1
            out += deflate.compress(bytes(2 * BLOCK)) + deflate.flush()
            for at in range(0, len(out), part_bytes):
                yield part(bundle, n, bytes(out[at : at + part_bytes]))
                n += 1

    return rows.select("bundle_id", "path", "mode", "content").mapInArrow(run, "bundle_id string, part int, data binary")


class _Member:
    """The expanded bytes of one gzip member, pulled from its parts as needed."""

    def __init__(self, parts: Iterator[bytes], most: int) -> None:
        self.parts, self.most, self.inflate, self.sha = parts, most, zlib.decompressobj(31), hashlib.sha256()
        self.packed = self.expanded = 0
        self.tail, self.held = b"", bytearray()

    def _more(self) -> bool:
        """Expand a little further; bounded however well the input is packed."""
        while not self.inflate.eof:
            if not self.tail:
                part = next(self.parts, None)
                if part is None:
                    raise ArchiveFault("invalid-artifact", "truncated")
                self.packed += len(part)
                self.sha.update(part)
                self.tail = part
            try:
                got = self.inflate.decompress(self.tail, PULL)
            except zlib.error as e:
                raise ArchiveFault("invalid-artifact", "not valid gzip") from e
            self.tail = self.inflate.unconsumed_tail
            if got:
                self.expanded += len(got)
                if self.expanded > self.most:
                    raise ArchiveFault("limit-exceeded", f"expands to more than {self.most} bytes")
                self.held += got
                return True
        return False

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def exactly(self, n: int) -> bytes:
        out = self.read(n)
        if len(out) < n:
            raise ArchiveFault("invalid-artifact", "truncated")
        return out

    def finish(self) -> None:
        """Take what is left of the member and refuse anything after it."""
        self.held.clear()
        while self._more():
            self.held.clear()
        after = bool(self.inflate.unused_data)
        for part in self.parts:
            self.packed += len(part)
            self.sha.update(part)
            after = after or bool(part)
        if after:
            raise ArchiveFault("invalid-artifact", "data after the gzip member")


def _number(field: bytes) -> int:
    text = field.strip(b" \0")
    try:
        return int(text, 8) if text else 0
    except ValueError as e:
        raise ArchiveFault("invalid-artifact", "malformed number in a header") from e


def _pax(data: bytes) -> dict[str, str]:
    out = {}
    while data:
        try:
            n = int(data[: data.index(b" ")])
            key, value = data[data.index(b" ") + 1 : n - 1].split(b"=", 1)
            out[key.decode()] = value.decode()
        except ValueError as e:
            raise ArchiveFault("invalid-artifact", "malformed extended header") from e
        data = data[n:]
    return out


def _text(raw: bytes) -> str:
    try:
        return raw.split(b"\0", 1)[0].decode()
    except UnicodeDecodeError as e:
        raise ArchiveFault("unsafe-path", "a name isn't UTF-8") from e


#: An entry's (name, kind, mode, size, digest, content); content only where asked for.
Entry = tuple[str, str, int, int, str | None, bytes | None]


def read_entries(member: _Member, contents: bool) -> Iterator[Entry]:
    """Entries of the tar in member; kinds are file, directory and fault."""
    extended: dict[str, str] = {}
    while block := member.read(BLOCK):
        if len(block) < BLOCK:
            raise ArchiveFault("invalid-artifact", "truncated")
        if not any(block):
            break
        if _number(block[148:156]) != sum(block[:148]) + 256 + sum(block[156:]):
            raise ArchiveFault("invalid-artifact", "wrong checksum of a header")
        mode, size, kind = _number(block[100:108]), _number(block[124:136]), block[156:157]
        if kind in (b"x", b"g"):
            if size > 1 << 20:
                raise ArchiveFault("limit-exceeded", "an extended header of more than 1 MiB")
            record = _pax(member.exactly(size + -size % BLOCK)[:size])
            extended = record if kind == b"x" else extended
            continue
        prefix = _text(block[345:500]) if block[257:262] == b"ustar" else ""
        name = extended.get("path") or (f"{prefix}/" if prefix else "") + _text(block[:NAME_BYTES])
        size, extended = int(extended.get("size", size)), {}
        if kind == b"5" or (kind == b"\0" and name.endswith("/")):
            yield name.rstrip("/") if name.count("/") == len(name) else name.removesuffix("/"), "directory", mode, 0, None, None
            member.exactly(size + -size % BLOCK)
            continue
        if kind not in (b"0", b"\0"):
            raise ArchiveFault("unsupported-file", f"{name}: an entry of type {kind.decode('latin-1')!r}")
        sha, left, kept = hashlib.sha256(), size, []
        while left:
            piece = member.exactly(min(left, PULL))
            sha.update(piece)
            left -= len(piece)
            if contents:
                kept.append(piece)
        member.exactly(-size % BLOCK)
        yield name, "file", mode, size, "sha256:" + sha.hexdigest(), b"".join(kept) if contents else None
    member.finish()


def _reading(parts: DataFrame, contents: bool, max_expanded: int, emit: Callable, schema: pa.Schema) -> DataFrame:
    """Rows that emit makes of each entry, sent on in batches of bounded rows and bytes."""
    ordered = whole_bundles(parts.select("bundle_id", "part", "data"), "part")

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for bundle, rows in groupby(_rows(batches), itemgetter(0)):
            member = _Member((r[2] or b"" for r in rows), max_expanded)
            no = 0
            try:
                for entry in read_entries(member, contents):
                    yield from emit(bundle, no, *entry)
                    no += 1
                yield from emit(bundle, no, "", "layer", 0, member.packed, "sha256:" + member.sha.hexdigest(), None)
            except ArchiveFault as e:
                yield from emit(bundle, no, f"{e.code}: {e}", "fault", 0, 0, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in emitted(batches):
            held.append(row)
            size += len(row[-1] or b"") if contents else 0
            if len(held) == BATCH_ROWS or size >= PART_BYTES:
                full, held, size = _batch(held, schema), [], 0
                yield full
                del full
        if held:
            yield _batch(held, schema)

    return ordered.mapInArrow(run, from_arrow_schema(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def entries(parts: DataFrame, max_expanded: int = 8 << 30) -> DataFrame:
    """(bundle_id, entry_no, name, kind, mode, size, digest) of every entry.

    One more row a bundle: kind layer, with the packed size and its digest; or kind fault, with 'code: message' for a name.
    """

    def emit(*values: object) -> Iterator[tuple]:
        yield values[:-1]

    return _reading(parts, False, max_expanded, emit, ENTRIES)


def contents(parts: DataFrame, max_expanded: int = 8 << 30) -> DataFrame:
    """(bundle_id, path, content) of every file entry that can be read."""

    def emit(bundle: str, _no: int, name: str, kind: str, *rest: object) -> Iterator[tuple]:
        if kind == "file":
            yield bundle, name, rest[-1]

    return _reading(parts, True, max_expanded, emit, CONTENTS)


def _finding(df: DataFrame, code: str | Column, path: str | Column, message: str | Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("bundle_id", lit(code).alias("code"), lit(path).alias("path"), lit(message).alias("message"))


def archive_findings(read: DataFrame, inventory: DataFrame, layers: DataFrame | None = None, max_files: int = 100_000, max_ratio: int = 200) -> DataFrame:
    """(bundle_id, code, path, message) of what differs between entries() and the declared inventory; none: they agree.

    layers: (bundle_id, size, digest) as declared of the packed bytes. Every fault is listed, not the first alone.
    """
    name = F.col("name")
    body = read.where(F.col("kind").isin("file", "directory"))
    files, dirs = body.where("kind = 'file'"), body.where("kind = 'directory'")
    declared = inventory.select("bundle_id", F.col("path").alias("name"), F.col("size").alias("want_size"), F.col("digest").alias("want_digest"))
    matched = files.join(declared, ["bundle_id", "name"], "left")
    code = paths.path_code(name)
    repeated = body.groupBy("bundle_id", "kind", "name").agg(F.count("*").alias("n")).where("n > 1")
    sums = read.groupBy("bundle_id").agg(F.count_if(F.col("kind").isin("file", "directory")).alias("nodes"), F.sum(F.when(F.col("kind") == "file", F.col("size"))).alias("expanded"), F.max(F.when(F.col("kind") == "layer", F.col("size"))).alias("packed"))
    parts = [
        _finding(read.where("kind = 'fault'"), F.substring_index(name, ":", 1), "", F.expr("substr(name, locate(': ', name) + 2)")),
        _finding(body.where(code != "ok"), code, name, "not a safe path"),
        _finding(matched.where("want_digest is null"), "invalid-artifact", name, "not declared"),
        _finding(matched.where("size <> want_size"), "digest-mismatch", name, "size differs"),
        _finding(matched.where("size = want_size and digest <> want_digest"), "digest-mismatch", name, "content differs"),
        _finding(repeated, "invalid-artifact", name, "repeated entry"),
        _finding(dirs.join(declared, ["bundle_id", "name"], "left_semi"), "invalid-artifact", name, "a directory where a file is declared"),
        _finding(declared.join(files, ["bundle_id", "name"], "left_anti"), "invalid-artifact", name, "declared, not delivered"),
        _finding(sums.where(F.col("nodes") > max_files), "limit-exceeded", "", "too many entries"),
        _finding(sums.where(f"packed > 0 and expanded > 0 and expanded div packed > {int(max_ratio)}"), "limit-exceeded", "", "expands too far"),
    ]
    if layers is not None:
        got = read.where("kind = 'layer'").join(layers.select("bundle_id", F.col("size").alias("want_size"), F.col("digest").alias("want_digest")), "bundle_id")
        parts.append(_finding(got.where("size <> want_size or digest <> want_digest"), "digest-mismatch", "", "the packed bytes differ"))
    return reduce(DataFrame.unionByName, parts)


def deviations(read: DataFrame, level: str = "structure") -> DataFrame:
    """(bundle_id, name, deviation, severity): how archives depart from the canonical encoding.

    Missing parents and repeated entries are errors at any level; order, modes, needless directories and names that differ by
    case are notes at level structure and errors at level canonical.
    """
    if level not in ("structure", "canonical"):
        raise ValueError(f"unknown level {level!r}")
    body = read.where(F.col("kind").isin("file", "directory"))
    of_kind = W.partitionBy("bundle_id", "kind").orderBy("entry_no")
    before = W.partitionBy("bundle_id").orderBy("entry_no").rowsBetween(W.unboundedPreceding, -1)
    seen = body.withColumns({"prev": F.lag("name").over(of_kind), "after_file": F.coalesce(F.max(F.col("kind") == "file").over(before), F.lit(False))})
    modes = F.when(F.col("kind") == "directory", F.col("mode") != DIRECTORY_MODE).otherwise(~F.col("mode").isin(0o644, 0o755))
    needed = body.where("kind = 'file'").select("bundle_id", F.explode(paths.parents(F.col("name"))).alias("name")).distinct()
    present = body.where("kind = 'directory'").select("bundle_id", "name").distinct()
    folded = body.select("bundle_id", "name").distinct().groupBy("bundle_id", paths.fold_key("name").alias("k")).agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1")
    soft = "error" if level == "canonical" else "note"
    row = lambda df, what, severity: df.select("bundle_id", "name", F.lit(what).alias("deviation"), F.lit(severity).alias("severity"))
    parts = [
        row(needed.join(present, ["bundle_id", "name"], "left_anti"), "missing-parent", "error"),
        row(body.groupBy("bundle_id", "name").agg(F.count("*").alias("n")).where("n > 1"), "repeated", "error"),
        row(present.join(needed, ["bundle_id", "name"], "left_anti"), "needless-directory", soft),
        row(folded, "case", soft),
        row(seen.where("prev >= name"), "order", soft),
        row(seen.where("kind = 'directory' and after_file"), "directory-after-file", soft),
        row(body.where(modes), "mode", soft),
    ]
    return reduce(DataFrame.unionByName, parts)


def expand(parts: DataFrame, inventory: DataFrame, faults: DataFrame, max_expanded: int = 8 << 30) -> DataFrame:
    """(bundle_id, path, mode, content) of the bundles without findings, modes as declared.

    Write it with mode errorifexists: what is there already is never overwritten.
    """
    clean = parts.join(faults.select("bundle_id").distinct(), "bundle_id", "left_anti")
    return contents(clean, max_expanded).join(inventory.select("bundle_id", "path", "mode"), ["bundle_id", "path"]).select("bundle_id", "path", "mode", "content")


def descriptors(parts: DataFrame) -> DataFrame:
    """(bundle_id, size, digest) of the packed bytes, hashed as the parts pass."""
    ordered = whole_bundles(parts.select("bundle_id", "part", "data"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, rows in groupby(_rows(batches), itemgetter(0)):
            sha, size = hashlib.sha256(), 0
            for _, _, data in rows:
                sha.update(data)
                size += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.string()), pa.array([size], pa.int64()), pa.array(["sha256:" + sha.hexdigest()], pa.string())], names=["bundle_id", "size", "digest"])

    return ordered.mapInArrow(run, "bundle_id string, size long, digest string")


def inventory_of(files: DataFrame) -> DataFrame:
    """The inventory of (bundle_id, path, mode, content), modes made normal."""
    return files.select("bundle_id", "path", paths.normal_mode(F.col("mode")).alias("mode"), F.octet_length("content").cast("long").alias("size"), digests.sha256_text(F.col("content")).alias("digest"))
