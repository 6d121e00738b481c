"""Digests in text form (sha256:<64 lower hex>) and the byte encoding of inventory records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of the hashed stream. A parameter everywhere: pass the one of the system whose digests are to be reproduced.
TREE_DOMAIN = "arborix-tree-v1\x00"
DIGEST = r"\Asha256:[0-9a-f]{64}\z"


def sha256_text(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def digest_code(raw: Column) -> Column:
    """ok, unsupported-version for another algorithm, else invalid."""
    return F.when(raw.rlike(DIGEST), "ok").when(raw.rlike(r"\A[a-z0-9+._-]+:") & ~raw.startswith("sha256:"), "unsupported-version").otherwise("invalid")


def big_endian(n: Column, width: int) -> Column:
    """A number as width bytes in hex."""
    return F.lpad(F.hex(n.cast("long")), 2 * width, "0")


def record_hex(path: Column, mode: Column, size: Column, digest: Column) -> Column:
    """u32 length of path, path, u32 mode, u64 size, digest."""
    return F.concat(big_endian(F.octet_length(path), 4), F.hex(F.encode(path, "UTF-8")), big_endian(mode, 4), big_endian(size, 8), F.upper(F.substr(digest, F.lit(8))))
