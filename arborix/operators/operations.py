"""Whole operations over many bundles: build and verify. Results are lazy; what is written here are steps between, not results."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests, paths
from ..sources.stage import written
from . import archives, documents, evaluation, limits
from . import inventory as inv


class Built(NamedTuple):
    """What a build gives; parts, configs and manifests are of the bundles without findings alone."""

    findings: DataFrame
    files: DataFrame
    parts: DataFrame
    configs: DataFrame
    manifests: DataFrame


def compose_findings(composed: DataFrame) -> DataFrame:
    """Every reason why sources can't be one tree: (bundle_id, stage, code, path, message)."""
    code = paths.path_code(F.col("path"))
    unsafe = composed.where(code != "ok").select("bundle_id", F.lit("compose").alias("stage"), code.alias("code"), F.col("path"), F.lit("path").alias("message"))
    return reduce(DataFrame.unionByName, [unsafe, inv.duplicate_paths(composed), inv.file_directory_clashes(composed), inv.fold_clashes(composed)])


def build(sources: DataFrame, kinds: documents.Kinds = documents.Kinds(), domain: str = digests.TREE_DOMAIN, asked: DataFrame | None = None) -> Built:
    """Build bundles from (bundle_id, source, mount, path, mode, content); asked: limits as limits.effective() takes them.

    Counts and sizes are held against the effective limits of every bundle: the defaults where nothing is asked.
    """
    placed = sources.select("bundle_id", "source", paths.nfc(paths.mounted(F.col("mount"), F.col("path"))).alias("path"), paths.normal_mode(F.col("mode")).alias("mode"), "content")
    none = sources.select("bundle_id").distinct().select("bundle_id", F.lit("maxFiles").alias("bound"), F.lit(0).cast("long").alias("value"), F.lit("unset").alias("origin"), F.lit(0).alias("precedence"))
    effective = limits.effective(none if asked is None else none.unionByName(asked.select(*none.columns)))
    sized = placed.select("bundle_id", "source", "path", F.octet_length("content").cast("long").alias("size"))
    sized = written(sized, "composed")
    found = written(compose_findings(sized).unionByName(inv.limit_findings(sized, effective)), "findings")
    files = placed.join(found.select("bundle_id").distinct(), "bundle_id", "left_anti").select("bundle_id", "path", "mode", "content")
    parts = archives.pack(files)
    configs = documents.encode_configs(archives.inventory_of(files), kinds, domain)
    return Built(found, files, parts, configs, documents.encode_manifests(configs, archives.descriptors(parts), kinds))


def verify(parts: DataFrame, inventory: DataFrame, subjects: DataFrame, rules: evaluation.Rules, evidence: DataFrame, evaluated_at: Column, semantics: DataFrame | None = None) -> DataFrame:
    """The report of each subject; its bundle_id says which archive is its own. An archive that isn't there is a finding of its files. Entries are written once read."""
    faults = archives.archive_findings(written(archives.entries(parts), "entries"), inventory)
    own = faults.select("bundle_id").distinct().join(subjects.select("bundle_id", "subject_digest"), "bundle_id").select("subject_digest")
    return evaluation.reports(subjects, evaluation.evaluate(rules, subjects.drop("bundle_id"), evidence, evaluated_at), own, semantics)
