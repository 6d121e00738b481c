"""Resolvers: what turns a declared source into files, and the registry that a build is given.

A resolver has a type, an identity for locks and provenance, and resolve(). Rows of declared sources are (bundle_id, source,
type, mount, include, exclude, config), as specs.declared_sources() gives them. A build's sources are a short list, so they are
collected; files never are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Row
from pyspark.sql import functions as F

from ..functions import globs, paths, references
from ..operators import archives
from ..operators import inventory as inv
from . import directory

FILES = "bundle_id string, source string, mount string, path string, mode int, content binary"
FINDINGS = "bundle_id string, source string, code string, path string, message string"


class Resolved(NamedTuple):
    """Files (FILES), findings (FINDINGS), and material (bundle_id, source, tree_digest, resolver, requested, resolved)."""

    files: DataFrame
    findings: DataFrame
    material: DataFrame


class Resolver(Protocol):
    """The contract: nothing of a source with a finding may be used."""

    type: str
    identity: str

    def check(self, config: dict) -> str | None:
        """Why a configuration is refused; None if it isn't."""

    def read(self, spark: SparkSession, sources: list[Row]) -> tuple[DataFrame, DataFrame]:
        """(bundle_id, source, path, mode, content) of the files chosen, and findings."""


def strict_config(text: str | None, fields: set[str]) -> dict:
    """A configuration with no fields but these; ValueError for any other."""
    config = json.loads(text or "{}")
    if not isinstance(config, dict) or not config.keys() <= fields or not all(isinstance(v, str) for v in config.values()):
        raise ValueError(f"fields are {sorted(fields)}, and texts")
    return config


class PathResolver:
    """Directories, relative to base; absolute ones only where that is allowed, and none beyond base otherwise."""

    type, identity, fields = "path", "arborix/path/v1", {"path"}

    def __init__(self, base: str, allow_absolute: bool = False, max_file_bytes: int = 1 << 30) -> None:
        self.base, self.allow_absolute, self.max_file_bytes = base, allow_absolute, max_file_bytes

    def check(self, config: dict) -> str | None:
        path = config.get("path", "")
        if not path:
            return "no path"
        if os.path.isabs(path):
            return None if self.allow_absolute else "an absolute path"
        return "a path beyond its base" if os.path.normpath(path).split(os.sep)[0] == ".." else None

    def read(self, spark: SparkSession, sources: list[Row]) -> tuple[DataFrame, DataFrame]:
        parts = []
        for s in sources:
            root = os.path.join(self.base, json.loads(s.config)["path"])
            files, found = directory.read_directories(spark, {s.bundle_id: root}, list(s.include or []) or None, list(s.exclude or []) or None, self.max_file_bytes)
            mine = F.lit(s.source).alias("source")
            parts.append((files.select("bundle_id", mine, "path", "mode", "content"), found.select("bundle_id", mine, "code", "path", F.lit("").alias("message"))))
        return tuple(reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))


#: Gives the tree of each git source at its ref: (bundle_id, source, commit, path, git_mode as octal text, content).
Fetch = Callable[[SparkSession, list[Row]], DataFrame]


def git_refusal(url: Column, ref: Column, sub_path: Column) -> Column:
    """Why a git source is refused; null if it isn't: https alone, and nothing in a url that a lock would then publish."""
    url, ref, sub_path = (F.coalesce(c, F.lit("")) for c in (url, ref, sub_path))
    host = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return (
        F.when(url == "", "no url")
        .when(~F.lower(url).startswith("https://"), "not https")
        .when(host.contains("@"), "credentials in the url")
        .when(url.contains("?"), "a query in the url")
        .when(url.contains("#"), "a fragment in the url")
        .when(host == "", "no host")
        .when(ref == "", "no ref")
        .when((sub_path != "") & references.mount_path(sub_path).isNull(), "sub-path")
    )


def tree_files(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((bundle_id, source, path, mode, content), findings) of tree rows with git_mode: regular files stay, folders are passed over, links, submodules and stand-ins of large files are findings."""
    mode = F.col("git_mode")
    body = tree.where(~mode.isin("040000", "40000"))
    what = F.when(mode == "120000", "a symbolic link").when(mode == "160000", "a submodule").when(~mode.isin("100644", "100664", "100755"), "an unknown mode").when(directory.is_pointer(F.col("content")), "a stand-in of a large file")
    files = body.where(what.isNull()).select("bundle_id", "source", "path", F.when(mode == "100755", 0o755).otherwise(0o644).alias("mode"), "content")
    return files, body.where(what.isNotNull()).select("bundle_id", "source", F.lit("unsupported-file").alias("code"), "path", what.alias("message"))


class GitResolver:
    """Git trees; fetching them is given, as it needs a network."""

    type, identity, fields = "git", "arborix/git/v1", {"url", "ref", "subPath"}

    def __init__(self, fetch: Fetch, spark: SparkSession) -> None:
        self.fetch, self.spark = fetch, spark

    def check(self, config: dict) -> str | None:
        return self.spark.range(1).select(git_refusal(*(F.lit(config.get(k)).cast("string") for k in ("url", "ref", "subPath")))).first()[0]

    def read(self, spark: SparkSession, sources: list[Row]) -> tuple[DataFrame, DataFrame]:
        below = spark.createDataFrame([(s.bundle_id, s.source, f"{p}/" if (p := json.loads(s.config).get("subPath", "")) else "") for s in sources], "bundle_id string, source string, below string")
        tree = self.fetch(spark, sources).join(F.broadcast(below), ["bundle_id", "source"]).where(F.col("path").startswith(F.col("below")))
        files, found = tree_files(tree.withColumn("path", F.substr("path", F.length("below") + 1)))
        keep = reduce(lambda a, b: a | b, [(F.col("bundle_id") == s.bundle_id) & (F.col("source") == s.source) & globs.selected(F.col("path"), list(s.include or []) or None, list(s.exclude or []) or None) for s in sources])
        return files.where(keep), found.where(keep)


class Resolvers:
    """The resolvers of one build, by type; there is no registry beyond it."""

    def __init__(self, *resolvers: Resolver) -> None:
        self.by_type = {r.type: r for r in resolvers}
        if len(self.by_type) < len(resolvers):
            raise ValueError("two resolvers of one type")

    def resolve(self, spark: SparkSession, declared: DataFrame, locked: DataFrame | None = None) -> Resolved:
        """Everything that the declared sources give; locked: (bundle_id, source, tree_digest) that they must give."""
        chosen: dict[str, list[Row]] = {}
        found = []
        for s in declared.collect():
            resolver = self.by_type.get(s.type)
            if resolver is None:
                found.append((s.bundle_id, s.source, "unsupported-source", "", f"no resolver for {s.type}"))
                continue
            try:
                why = resolver.check(strict_config(s.config, resolver.fields))
            except ValueError as e:
                why = str(e)
            if why:
                found.append((s.bundle_id, s.source, "invalid-input", "", why))
            else:
                chosen.setdefault(s.type, []).append(s)
        reads = [self.by_type[t].read(spark, rows) for t, rows in chosen.items()]
        none = spark.createDataFrame([], "bundle_id string, source string, path string, mode int, content binary")
        files = reduce(DataFrame.unionByName, [f for f, _ in reads], none)
        findings = reduce(DataFrame.unionByName, [f for _, f in reads], spark.createDataFrame(found, FINDINGS))
        of = declared.select("bundle_id", "source", "mount", "type", "config")
        empty = of.where(F.col("type").isin(*chosen)).join(files.select("bundle_id", "source").distinct(), ["bundle_id", "source"], "left_anti") if chosen else of.limit(0)
        findings = findings.unionByName(empty.select("bundle_id", "source", F.lit("invalid-input").alias("code"), F.lit("").alias("path"), F.lit("no files").alias("message")))
        one = files.withColumn("__of", F.to_json(F.struct("bundle_id", "source")))
        trees = inv.tree_digest(archives.inventory_of(one.select(F.col("__of").alias("bundle_id"), "path", "mode", "content")))
        names = F.from_json("bundle_id", "bundle_id string, source string")
        trees = trees.select(names["bundle_id"].alias("bundle_id"), names["source"].alias("source"), "tree_digest")
        identities = F.create_map(*(F.lit(x) for t, r in self.by_type.items() for x in (t, r.identity)))
        material = trees.join(of, ["bundle_id", "source"]).select("bundle_id", "source", "tree_digest", F.element_at(identities, F.col("type")).alias("resolver"), F.from_json("config", "map<string,string>").alias("requested"), F.create_map(F.lit("treeDigest"), "tree_digest").alias("resolved"))
        if locked is not None:
            wrong = directory.changed(locked, material.select("bundle_id", "source", "tree_digest"))
            findings = findings.unionByName(wrong.select("bundle_id", "source", F.lit("stale-lock").alias("code"), F.lit("").alias("path"), F.lit("another tree than locked").alias("message")))
        placed = files.join(of.select("bundle_id", "source", "mount"), ["bundle_id", "source"]).select(*(c.split()[0] for c in FILES.split(", ")))
        clean = placed.join(findings.select("bundle_id", "source").distinct(), ["bundle_id", "source"], "left_anti")
        return Resolved(clean, findings, material)


def owners(composed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bundle_id, path, source, source_path) of each wanted final path: where it came from."""
    return wanted.join(composed.select("bundle_id", "path", "source", "source_path"), ["bundle_id", "path"], "left")


def path_findings(files: DataFrame) -> DataFrame:
    """Files whose path, as bytes or text in column path, can't be taken: (bundle_id, code, message)."""
    p = paths.normalized(F.col("path"))
    return files.select("bundle_id", p.alias("p")).where("p.code <> 'ok'").select("bundle_id", "p.code", "p.message")
