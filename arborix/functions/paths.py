"""Path rules as native expressions; NFC and non-ASCII folding are the only Python steps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Device names that are reserved as the stem of a segment, and characters no segment may hold
RESERVED = ["con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9", "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9"]
FORBIDDEN = r'[<>:"|?*\\]'
# Pairs that simple folding joins and casefold() doesn't
_FOLD_PAIRS = {"ﬅ": "ﬆ", "ΐ": "ΐ", "ΰ": "ΰ"}


def path_code(path: Column, max_bytes: int = 1024, max_segment: int = 255, max_depth: int = 64) -> Column:
    """ok, unsafe-path or limit-exceeded, by the first rule that fails; a limit of 0 is none."""
    segments = F.split(path, "/")
    limit = lambda n, at_most: (n > at_most) if at_most else F.lit(False)
    stem = lambda s: F.lower(F.substring_index(s, ".", 1)).isin(RESERVED)
    bad = lambda s: (s == "") | s.isin(".", "..") | s.rlike(r"[\x00-\x1f\x7f-\x9f]") | s.rlike(FORBIDDEN) | s.rlike(r"[ .]\z") | stem(s)
    return (
        F.when(path.isNull() | (path == ""), "unsafe-path")
        .when(path.startswith("/") | path.endswith("/"), "unsafe-path")
        .when(limit(F.octet_length(path), max_bytes) | limit(F.size(segments), max_depth), "limit-exceeded")
        .when(F.exists(segments, lambda s: (s != "") & limit(F.octet_length(s), max_segment)) & ~F.exists(segments, lambda s: s.isin("", ".", "..")), "limit-exceeded")
        .when(F.exists(segments, bad), "unsafe-path")
        .otherwise("ok")
    )


def quoted(raw: Column, most: int = 128) -> Column:
    """Bytes as text for a message: cut at most bytes, and what isn't UTF-8 replaced."""
    return F.make_valid_utf8(F.substring(raw.cast("binary"), 1, most).cast("string"))


def normalized(raw: Column, max_bytes: int = 1024, max_segment: int = 255, max_depth: int = 64) -> Column:
    """path (NFC; null unless ok), code and message of a path given as bytes or text. Bytes that aren't UTF-8 are unsafe; limits and rules are of the NFC form."""
    data = raw.cast("binary")
    valid = F.is_valid_utf8(data.cast("string"))
    path = nfc(F.when(valid, data.cast("string")))
    code = F.when(raw.isNull() | (F.octet_length(data) == 0), "unsafe-path").when(~valid, "unsafe-path").otherwise(path_code(path, max_bytes, max_segment, max_depth))
    why = F.when(raw.isNull() | (F.octet_length(data) == 0), "empty").when(~valid, "not UTF-8").when(code == "limit-exceeded", "too long or too deep").otherwise("not allowed")
    message = F.when(code != "ok", F.concat(why, F.lit(": "), F.coalesce(quoted(data), F.lit(""))))
    return F.struct(F.when(code == "ok", path).alias("path"), code.alias("code"), message.alias("message"))


def parents(path: Column) -> Column:
    """Directories above a path, the shallowest first; none for a path of one segment."""
    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normal_mode(mode: Column) -> Column:
    """0755 if any execute bit is set, else 0644."""
    return F.when(mode.bitwiseAND(0o111) != 0, F.lit(0o755)).otherwise(F.lit(0o644))


def mounted(mount: Column, path: Column) -> Column:
    return F.when(F.coalesce(mount, F.lit("")).isin("", "."), path).otherwise(F.concat_ws("/", mount, path))


def _fold(c: str) -> str:
    c = _FOLD_PAIRS.get(c, c)
    return c.casefold() if len(c.casefold()) == 1 else c.lower() if len(c.lower()) == 1 else c


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_key(s: pd.Series) -> pd.Series:
    """Equal for names that differ in simple case folding alone."""
    return s.map(lambda x: x.lower() if x.isascii() else "".join(map(_fold, x)), na_action="ignore")
