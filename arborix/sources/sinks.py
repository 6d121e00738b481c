"""What is written: blobs by their digests, an index that names them last, single documents, and trees of files.

Places are URIs that driver and executors share (file:, hdfs:, s3: and what else pyarrow.fs opens). Data comes first, is
read back, and only then does anything point to it; nothing that is there is ever overwritten, but for the index, which is
replaced in one step. A run that died can be run again: what it had written is found, checked and kept. Each layout and each
destination has one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import layout

INDEX_TYPE = "application/vnd.oci.image.index.v1+json"  # fixed values of the public image layout
LAYOUT_FILE = b'{"imageLayoutVersion":"1.0.0"}'
STATES = "digest string, state string"


class DestinationExists(FileExistsError):
    """The place to write to is taken."""

    code = "destination-exists"


class NotPublished(RuntimeError):
    """What was read back isn't what was written; nothing points to it."""

    code = "digest-mismatch"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def _read(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _put(fs: pafs.FileSystem, path: str, data: bytes, mode: int | None = None) -> None:
    """The whole file or none: written beside its place under another name, then moved there."""
    folder, _, name = path.rpartition("/")
    staged = f"{folder}/.{name[:64]}.{uuid.uuid4().hex}"
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(staged, compression=None) as f:
        f.write(data)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(staged, "rb") as f:
            os.fsync(f.fileno())
        if mode is not None:
            os.chmod(staged, mode)
    fs.move(staged, path)


def rename_exclusive(fs: pafs.FileSystem, source: str, target: str) -> None:
    """Move source to target unless something is there. On this machine's disks a lock folder keeps others out; elsewhere the check and the move are two steps."""
    if not isinstance(fs, pafs.LocalFileSystem):
        if _exists(fs, target):
            raise DestinationExists(target)
        fs.move(source, target)
        return
    lock = f"{target}.lock"
    try:
        os.mkdir(lock)
    except FileExistsError:
        raise DestinationExists(f"{target} is being written") from None
    try:
        if os.path.lexists(target):
            raise DestinationExists(target)
        os.rename(source, target)
    finally:
        os.rmdir(lock)


def write_blobs(blobs: DataFrame, root: str) -> DataFrame:
    """(digest, state) of each blob (digest, content) once written below root: written, present (and sound), repaired (it was there and didn't hash to its name), or refused (the content given doesn't).

    An action of its own, on the executors; the rows are the result, a few bytes a blob.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for batch in batches:
            names, states = [], []
            for digest, content in zip(batch.column(0), batch.column(1), strict=True):
                name, data = digest.as_py(), content.as_py() or b""
                place = f"{base}/blobs/sha256/{(name or '').removeprefix('sha256:')}"
                if name != "sha256:" + hashlib.sha256(data).hexdigest():
                    state = "refused"
                elif _exists(fs, place) and _read(fs, place) == data:
                    state = "present"
                else:
                    state = "repaired" if _exists(fs, place) else "written"
                    _put(fs, place, data)
                names.append(name)
                states.append(state)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(states, pa.string())], names=["digest", "state"])

    once = blobs.select("digest", F.col("content").cast("binary").alias("content")).dropDuplicates(["digest"])
    spark = blobs.sparkSession
    return spark.createDataFrame(once.mapInArrow(run, STATES).collect(), STATES)


def read_back(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(digest, code) of the blobs wanted (digest) that aren't there or don't hash to their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for batch in batches:
            names, codes = [], []
            for name in batch.column(0).to_pylist():
                place = f"{base}/blobs/sha256/{(name or '').removeprefix('sha256:')}"
                code = "not-found" if not _exists(fs, place) else None if "sha256:" + hashlib.sha256(_read(fs, place)).hexdigest() == name else "digest-mismatch"
                names.append(name)
                codes.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(codes, pa.string())], names=["digest", "code"])

    return wanted.select("digest").distinct().mapInArrow(run, "digest string, code string").where("code is not null")


def _index(rows: list) -> bytes:
    """The index of catalogue rows, in the order of tag and digest."""
    listed = []
    for r in sorted(rows, key=lambda r: (r.tag or "", r.digest, r.subject or "")):
        one = {"mediaType": r.media_type, "digest": r.digest, "size": r.size}
        one |= {"artifactType": r.artifact_type} if r.artifact_type else {}
        one |= {"annotations": {layout.TAG_ANNOTATION: r.tag}} if r.tag else {}
        one |= {"subject": {"digest": r.subject}} if r.subject else {}
        listed.append(one)
    return json.dumps({"schemaVersion": 2, "mediaType": INDEX_TYPE, "manifests": listed}, sort_keys=True, separators=(",", ":")).encode()


def catalog_of(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue of a layout that may not be there yet; its column layout is root."""
    fs, base = _open(root)
    names = ", ".join(f"{c} {'long' if c == 'size' else 'string'}" for c in layout.CATALOG)
    if not _exists(fs, f"{base}/index.json"):
        return spark.createDataFrame([], names)
    index = json.loads(_read(fs, f"{base}/index.json"))
    rows = [(root, m["digest"], m.get("mediaType"), m.get("size"), m.get("artifactType"), (m.get("annotations") or {}).get(layout.TAG_ANNOTATION), (m.get("subject") or {}).get("digest")) for m in index.get("manifests", [])]
    return spark.createDataFrame(rows, names)


def publish(blobs: DataFrame, manifests: DataFrame, root: str, referrers: DataFrame | None = None, before_index: object = None) -> DataFrame:
    """Write blobs (digest, content), read them back, and only then name the manifests and referrers (catalogue rows; manifests with seq) in the index.

    Gives the states of the blobs. NotPublished: a blob was refused, or isn't there as written, or a row names a blob that isn't;
    the index is as it was. before_index: called before the index is replaced. An index is 1 MiB at most, and so are its rows.
    """
    spark = blobs.sparkSession
    states = write_blobs(blobs, root)
    if refused := [r.digest for r in states.where("state = 'refused'").limit(5).collect()]:
        raise NotPublished(f"content that doesn't hash to its name: {refused}")
    named = manifests.select("digest") if referrers is None else manifests.select("digest").union(referrers.select("digest"))
    if wrong := read_back(spark, root, blobs.select("digest").union(named)).limit(5).collect():
        raise NotPublished(f"read back: {[tuple(r) for r in wrong]}")
    at = F.lit(root)
    rows = layout.put_manifests(catalog_of(spark, root), manifests.withColumn("layout", at))
    if referrers is not None:
        rows = layout.put_referrers(rows, referrers.withColumn("layout", at))
    text = _index(rows.collect())
    if len(text) > layout.MOST_INDEX_BYTES:
        raise NotPublished("the index would be longer than readers accept")
    if before_index:
        before_index()
    fs, base = _open(root)
    if not _exists(fs, f"{base}/oci-layout"):
        _put(fs, f"{base}/oci-layout", LAYOUT_FILE)
    _put(fs, f"{base}/index.json", text)
    return states


def copy_subjects(spark: SparkSession, source: str, target: str, digests: list[str], blobs: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """Copy subjects and all their referrers, byte for byte, from one layout to another; blobs: (digest, content) of what they name.

    tags: the tags to give in the target, by digest; without it a subject keeps its own.
    """
    catalog = catalog_of(spark, source)
    chosen = spark.createDataFrame([(source, d) for d in digests], "layout string, digest string")
    rows = layout.copied(catalog, chosen, target)
    own = rows.where("subject is null").withColumn("seq", F.lit(0).cast("long"))
    if tags is not None:
        own = own.drop("tag").join(spark.createDataFrame(list(tags.items()), "digest string, tag string"), "digest", "left").select(*layout.CATALOG, "seq")
    return publish(blobs, own, target, rows.where("subject is not null"))


def write_document(text: str, uri: str, replace: bool = False) -> None:
    """One document, such as a lock, as a whole or not at all; DestinationExists where it is there and replace isn't asked for."""
    fs, path = _open(uri)
    if replace:
        _put(fs, path, text.encode(), 0o644)
        return
    staged = f"{path}.{uuid.uuid4().hex}"
    _put(fs, staged, text.encode(), 0o644)
    try:
        rename_exclusive(fs, staged, path)
    except DestinationExists:
        fs.delete_file(staged)
        raise


def write_trees(files: DataFrame, root: str, before_rename: object = None) -> dict[str, str]:
    """Write (bundle_id, path, mode, content) as the trees root/bundle_id; gives ok, destination-exists, unsafe-path or incomplete for each bundle.

    A tree is written beside its place, counted, and moved there as a whole; what can't be moved is removed. Files keep their
    modes on this machine's disks.
    """
    spark = files.sparkSession
    fs, base = _open(root)
    staging = f"{base}/.staging-{uuid.uuid4().hex}"
    safe = (paths.path_code(F.concat_ws("/", "bundle_id", "path")) == "ok") & ~F.col("bundle_id").contains("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, _ = _open(root)
        for batch in batches:
            done = []
            for bundle, path, mode, content in zip(*batch.columns, strict=True):
                _put(mine, f"{staging}/{bundle.as_py()}/{path.as_py()}", content.as_py() or b"", mode.as_py())
                done.append(bundle.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["bundle_id"])

    want = {r.bundle_id: (r.n, r.unsafe) for r in files.groupBy("bundle_id").agg(F.countDistinct("path").alias("n"), F.count_if(~safe).alias("unsafe")).collect()}
    wrote = files.where(safe).select("bundle_id", "path", F.col("mode").cast("int"), "content").mapInArrow(run, "bundle_id string").groupBy("bundle_id").count().collect()
    got = {r.bundle_id: r["count"] for r in wrote}
    if before_rename:
        before_rename()
    out = {}
    try:
        for bundle, (n, unsafe) in sorted(want.items(), key=lambda x: str(x[0])):
            if unsafe:
                out[bundle] = "unsafe-path"
                continue
            if got.get(bundle) != n:
                out[bundle] = "incomplete"
                continue
            try:
                rename_exclusive(fs, f"{staging}/{bundle}", f"{base}/{bundle}")
                out[bundle] = "ok"
            except DestinationExists:
                out[bundle] = "destination-exists"
    finally:
        if _exists(fs, staging):
            fs.delete_dir(staging)
    return out
