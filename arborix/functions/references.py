"""Locations of artifacts, names, tags and the signed form of payloads, as native expressions.

A null location is invalid like an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import DIGEST

# The public grammar of registry references
_LABEL = "(?:[a-zA-Z0-9]|[a-zA-Z0-9][a-zA-Z0-9-]*[a-zA-Z0-9])"
DOMAIN = rf"{_LABEL}(?:\.{_LABEL})*(?::[0-9]+)?"
_PART = "[a-z0-9]+(?:(?:[._]|__|-+)[a-z0-9]+)*"
REPOSITORY = f"{_PART}(?:/{_PART})*"
TAG = "[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}"
REGISTRY_REFERENCE = rf"\A(?:({DOMAIN})/)?({REPOSITORY})(?::({TAG}))?(?:@(.+))?\z"
NAME = r"\A[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\z"
SCHEMES = ("oci", "oci-layout")


def parse_reference(raw: Column) -> Column:
    """scheme, registry, repository, path, tag, digest and code (ok or invalid-input); what a location doesn't have is empty.

    Without a scheme it is a registry's; a registry's host is never guessed; a tag and a digest exclude each other.
    """
    raw = F.coalesce(raw, F.lit(""))
    has_scheme = raw.contains("://")
    scheme = F.when(has_scheme, F.substring_index(raw, "://", 1)).otherwise("oci")
    rest = F.when(has_scheme, F.substr(raw, F.locate("://", raw) + 3)).otherwise(raw)
    group = lambda i: F.regexp_extract(rest, REGISTRY_REFERENCE, i)
    has_host = group(1).rlike("[.:]") | (group(1) == "localhost")
    before = F.substring_index(rest, "@", 1)
    tagged = r"(?s)\A(.*):([^/\\:]*)\z"
    is_tagged = before.rlike(tagged)
    layout = {
        "path": F.when(is_tagged, F.regexp_extract(before, tagged, 1)).otherwise(before),
        "tag": F.when(is_tagged, F.regexp_extract(before, tagged, 2)).otherwise(""),
        "digest": F.when(rest.contains("@"), F.substr(rest, F.locate("@", rest) + 1)).otherwise(""),
    }
    registry = scheme == "oci"
    tag = F.when(registry, group(3)).otherwise(layout["tag"])
    digest = F.when(registry, group(4)).otherwise(layout["digest"])
    ok = F.when(registry, rest.rlike(REGISTRY_REFERENCE) & has_host).otherwise((layout["path"] != "") & (~rest.contains("@") | digest.rlike(DIGEST)))
    ok = scheme.isin(*SCHEMES) & ok & ((tag == "") | (digest == "")) & ((digest == "") | digest.rlike(DIGEST))
    only = lambda when, value: F.when(ok & when, value).otherwise("")
    always = F.lit(True)
    return F.struct(
        only(always, scheme).alias("scheme"),
        only(registry, group(1)).alias("registry"),
        only(registry, group(2)).alias("repository"),
        only(~registry, layout["path"]).alias("path"),
        only(always, tag).alias("tag"),
        only(always, digest).alias("digest"),
        F.when(ok, "ok").otherwise("invalid-input").alias("code"),
    )


def is_reference(operand: Column) -> Column:
    """A location rather than a directory."""
    return operand.contains("://")


def is_tag(tag: Column) -> Column:
    return tag.rlike(rf"\A{TAG}\z")


def is_name(name: Column) -> Column:
    return name.rlike(NAME) & (F.length(name) <= 63)


def is_source_type(kind: Column) -> Column:
    """A built-in type, or domain/name with a dot in the domain."""
    return kind.isin("path", "git") | kind.rlike(r"\A[^/]*\.[^/]*/(?s:.+)\z")


def mount_path(mount: Column) -> Column:
    """Empty for the root; null for what isn't relative or has empty, . or .. segments."""
    segments = F.split(mount, "/")
    return F.when(mount.isin("", "."), "").when(~F.exists(segments, lambda s: s.isin("", ".", "..")), mount)


def redacted(url: Column) -> Column:
    """Without user information, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*\z", ""), r"\A([A-Za-z][A-Za-z0-9+.-]*://)[^/]*@", "$1")


def fallback_tag(digest: Column, suffix: str = "evidence") -> Column:
    """The tag under which evidence of a digest is found where referrers can't be listed."""
    return F.concat(F.lit("sha256-"), F.substr(digest, F.lit(8)), F.lit(f".{suffix}"))


def pre_authentication(payload_type: Column, payload: Column) -> Column:
    """The bytes that a signature of an envelope covers: DSSEv1, and length and value of type and payload."""
    length = lambda c: F.octet_length(c).cast("string").cast("binary")
    space = F.lit(b" ")
    return F.concat(F.lit(b"DSSEv1 "), length(payload_type), space, payload_type.cast("binary"), space, length(payload), space, payload.cast("binary"))
