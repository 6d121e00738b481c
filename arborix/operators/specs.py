"""Specs (declared sources of bundles), the locks and provenance made from them, and what inspection shows.

A spec is one YAML or JSON document a row. Python only turns it into canonical
JSON, a document at a time in Arrow batches; every check and projection is native.
YAML needs PyYAML on the executors; where that is missing, a spec must be JSON.
A null or empty document is no spec; specs of one bundle_id are judged row by row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digests, references
from ..functions.canonical_json import canonicalize
from . import inventory as inv
from .documents import STATEMENT_TYPE, Kinds, first_fault

SPEC_KIND = "Bundle"
_FIELDS = {"": {"apiVersion", "kind", "metadata", "spec"}, "metadata": {"name"}, "spec": {"sources"}, "source": {"name", "type", "mountPath", "include", "exclude", "config"}}
SPEC = "apiVersion string, kind string, metadata struct<name:string>, spec struct<sources:array<struct<name:string,type:string,mountPath:string,include:array<string>,exclude:array<string>,config:string>>>"

# One segment of a pattern: ** alone, or literals, wildcards, escapes and closed classes
_PIECE = r"(?:\\[^/]|\[\^?(?:\\[^/]|[^\\/])(?:\\[^/]|[^\\\]/])*\]|[^\\\[/])"
_SEGMENT = rf"(?:\*\*|(?!\.{{1,2}}(?:/|\z))(?![^/]*\*\*){_PIECE}+)"
PATTERN = rf"(?s)\A{_SEGMENT}(?:/{_SEGMENT})*\z"


def _no_repeats(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _load(text: str) -> object:
    """The one value of a document; ValueError for repeated keys or several documents."""
    try:
        return json.loads(text, object_pairs_hook=_no_repeats)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ValueError("not JSON, and there is no YAML reader") from None

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        return _no_repeats([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value])

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        return yaml.load(text, Loader=Strict)
    except (yaml.YAMLError, TypeError) as e:
        raise ValueError(str(e)) from None


def _strict(value: object, of: str) -> dict:
    if not isinstance(value, dict) or not value.keys() <= _FIELDS[of]:
        raise ValueError(f"not a strict {of or 'document'}")
    return value


def _checked(text: str) -> dict:
    spec = _strict(_load(text), "")
    for part in ("metadata", "spec"):
        _strict(spec.get(part) or {}, part)
    for source in (spec.get("spec") or {}).get("sources") or []:
        _strict(source, "source")
        if not isinstance(source.get("config") or {}, dict):
            raise ValueError("config is no mapping")
        for name in ("include", "exclude"):
            if not all(isinstance(p, str) for p in source.get(name) or []):
                raise ValueError("pattern is no text")
    return spec


def _normal(text: str) -> str | None:
    """Canonical JSON in which order and spelling of what is a set don't count; null for no strict document."""
    try:
        spec = _checked(text)
        sources = []
        for s in (spec.get("spec") or {}).get("sources") or []:
            s = s | {n: sorted(set(s.get(n) or []), key=str.encode) for n in ("include", "exclude")}
            s["mountPath"] = "" if s.get("mountPath") in (None, ".") else s["mountPath"]
            sources.append({"name": "", "type": ""} | {k: v for k, v in s.items() if v or k in ("name", "type")})
        sources.sort(key=lambda s: str(s["name"] or "").encode())
        head = {k: spec.get(k) or "" for k in ("apiVersion", "kind")}
        out = head | {"metadata": {"name": (spec.get("metadata") or {}).get("name") or ""}, "spec": {"sources": sources}}
        return canonicalize(json.dumps(out))
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def normal_spec(s: pd.Series) -> pd.Series:
    return s.map(_normal, na_action="ignore")


def parse_specs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bundle_id, code, normal, digest, doc) of each spec; the digest is that of the normal form."""
    read = docs.select("bundle_id", normal_spec(F.col(text)).alias("normal"))
    code = F.when(F.col("normal").isNull(), "invalid-input").otherwise("ok")
    return read.select("bundle_id", code.alias("code"), "normal", digests.sha256_text(F.col("normal")).alias("digest"), F.from_json("normal", SPEC).alias("doc"))


def is_pattern(pattern: Column) -> Column:
    return pattern.rlike(PATTERN)


def spec_findings(parsed: DataFrame, kinds: Kinds = Kinds(), kind: str = SPEC_KIND) -> DataFrame:
    """The first fault of each parsed spec: (bundle_id, code, path, message). Sources are looked at in the order of their names."""
    sources = F.col("doc.spec.sources")
    any_source = lambda bad: F.exists(sources, lambda s: F.coalesce(bad(s), F.lit(True)))
    loose = lambda s: F.concat(F.coalesce(s["include"], F.array()), F.coalesce(s["exclude"], F.array()))
    names = F.transform(sources, lambda s: s["name"])
    return first_fault(
        parsed,
        [
            (F.col("code") != "ok", "invalid-input", "not a strict document"),
            (F.col("doc.apiVersion") != kinds.api_version, "unsupported-version", "api version"),
            (F.col("doc.kind") != kind, "invalid-input", "kind"),
            (~references.is_name(F.col("doc.metadata.name")), "invalid-input", "name"),
            (F.coalesce(F.size(sources), F.lit(0)) < 1, "invalid-input", "no sources"),
            (any_source(lambda s: ~references.is_name(s["name"])), "invalid-input", "source name"),
            (any_source(lambda s: s["type"] == ""), "invalid-input", "no source type"),
            (any_source(lambda s: ~references.is_source_type(s["type"])), "unsupported-source", "source type"),
            (any_source(lambda s: references.mount_path(F.coalesce(s["mountPath"], F.lit(""))).isNull()), "invalid-input", "mount path"),
            (any_source(lambda s: F.exists(loose(s), lambda p: ~is_pattern(p))), "invalid-input", "pattern"),
            (F.size(names) != F.size(F.array_distinct(names)), "invalid-input", "repeated source"),
        ],
    )


def declared_sources(parsed: DataFrame) -> DataFrame:
    """(bundle_id, source, type, mount, include, exclude, config as JSON) of parsed specs."""
    s = parsed.select("bundle_id", F.explode("doc.spec.sources").alias("s"))
    return s.select("bundle_id", F.col("s.name").alias("source"), F.col("s.type").alias("type"), F.coalesce("s.mountPath", F.lit("")).alias("mount"), F.col("s.include").alias("include"), F.col("s.exclude").alias("exclude"), F.col("s.config").alias("config"))


def direct_specs(sources: DataFrame, kinds: Kinds = Kinds(), kind: str = SPEC_KIND) -> DataFrame:
    """(bundle_id, text): a spec of one directory for each row (bundle_id, name, path, mount, include, exclude); only the last part of the path is kept."""
    source = F.struct(F.col("name"), F.lit("path").alias("type"), F.col("mount").alias("mountPath"), "include", "exclude", F.struct(F.regexp_extract("path", r"([^/]*)/*\z", 1).alias("path")).alias("config"))
    doc = F.struct(F.lit(kinds.api_version).alias("apiVersion"), F.lit(kind).alias("kind"), F.struct("name").alias("metadata"), F.struct(F.array(source).alias("sources")).alias("spec"))
    return sources.select("bundle_id", F.to_json(doc).alias("text"))


def _sorted_map(c: str) -> Column:
    entries = F.array_sort(F.map_entries(c))
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def _set(c: str) -> Column:
    return F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c)))


def encode_locks(specs: DataFrame, sources: DataFrame, files: DataFrame, kinds: Kinds = Kinds(), domain: str = digests.TREE_DOMAIN) -> DataFrame:
    """(bundle_id, lock, digest): the canonical lock of each bundle that has sources and files.

    specs: (bundle_id, digest); sources: (bundle_id, name, type, resolver, resolver_version, requested, resolved, tree_digest,
    mount, include, exclude), maps of texts; files: (bundle_id, path, source, source_path, mode, size, digest).
    What is empty is left out. A lock is one document, so a bundle's entries meet in one cell.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    source = F.struct(_set("exclude").alias("exclude"), _set("include").alias("include"), some("mount").alias("mountPath"), "name", _sorted_map("requested").alias("requested"), _sorted_map("resolved").alias("resolved"), "resolver", some("resolver_version").alias("resolverVersion"), F.col("tree_digest").alias("treeDigest"), "type")
    file = F.struct("digest", "mode", "path", "size", "source", F.col("source_path").alias("sourcePath"))
    listed = lambda df, key, row: df.select("bundle_id", F.col(key).alias("k"), F.to_json(row).alias("j")).groupBy("bundle_id").agg(F.expr("listagg(j, ',') within group (order by k)").alias(f"by_{key}"))
    g = specs.select("bundle_id", F.col("digest").alias("spec_digest")).join(listed(sources, "name", source), "bundle_id").join(listed(files, "path", file), "bundle_id")
    g = g.join(inv.tree_digest(files, domain).select("bundle_id", "tree_digest"), "bundle_id")
    text = F.format_string('{"apiVersion":"' + kinds.api_version + '","files":[%s],"format":"' + kinds.format + '","kind":"' + kinds.lock_kind + '","manifestDigest":"%s","sources":[%s],"treeDigest":"%s"}', "by_path", "spec_digest", "by_name", "tree_digest")
    return g.select("bundle_id", text.alias("lock")).withColumn("digest", digests.sha256_text(F.col("lock")))


def provenance(parsed_locks: DataFrame, subjects: DataFrame, predicate_type: str, build_type: str, builder: str, version: str, section: str = "bundle") -> DataFrame:
    """(bundle_id, statement): what a lock says of a build, as an attestation's statement.

    parsed_locks: parsed locks and their digest (bundle_id, doc, lock_digest); subjects: (bundle_id, subject_digest).
    """
    dependency = lambda s: F.struct(F.create_map(F.lit("sha256"), F.regexp_replace(s["treeDigest"], r"\Asha256:", "")).alias("digest"), s["name"].alias("name"), F.try_element_at(s["requested"], F.lit("url")).alias("uri"))
    fact = lambda s: F.struct(s["mountPath"].alias("mountPath"), s["name"].alias("name"), s["requested"].alias("requested"), s["resolved"].alias("resolved"), s["resolver"].alias("resolver"), s["treeDigest"].alias("treeDigest"), s["type"].alias("type"))
    spec_digest = F.col("doc.manifestDigest")
    definition = F.struct(F.lit(build_type).alias("buildType"), F.struct(spec_digest.alias("specDigest")).alias("externalParameters"), F.transform("doc.sources", dependency).alias("resolvedDependencies"))
    run = F.struct(F.struct(F.lit(builder).alias("id"), F.create_map(F.lit(section), F.lit(version)).alias("version")).alias("builder"))
    own = F.struct(F.col("doc.format").alias("formatVersion"), F.col("lock_digest").alias("lockDigest"), spec_digest.alias("manifestDigest"), F.transform("doc.sources", fact).alias("sources"), F.lit(version).alias("toolVersion"), F.col("doc.treeDigest").alias("treeDigest"))
    subject = F.array(F.struct(F.create_map(F.lit("sha256"), F.regexp_replace("subject_digest", r"\Asha256:", "")).alias("digest")))
    statement = F.struct(F.lit(STATEMENT_TYPE).alias("_type"), F.struct(definition.alias("buildDefinition"), own.alias(section), run.alias("runDetails")).alias("predicate"), F.lit(predicate_type).alias("predicateType"), subject.alias("subject"))
    return parsed_locks.join(subjects.select("bundle_id", "subject_digest"), "bundle_id").select("bundle_id", F.to_json(statement).alias("statement"))


def document_kind(text: Column, kinds: Kinds = Kinds()) -> Column:
    """lock or manifest, by the kind that a JSON document states."""
    return F.when(F.get_json_object(text, "$.kind") == kinds.lock_kind, "lock").otherwise("manifest")


def inspect_specs(parsed: DataFrame) -> DataFrame:
    """What readable specs say: intent, so authored."""
    return parsed.where("code = 'ok'").select("bundle_id", F.lit("manifest").alias("kind"), F.col("doc.apiVersion").alias("api_version"), F.col("doc.metadata.name").alias("name"), "digest", F.size("doc.spec.sources").alias("n_sources"), F.lit("authored").alias("confidence"))


def inspect_locks(parsed: DataFrame) -> DataFrame:
    """What readable locks say: resolved. Entries are in doc.files."""
    d = parsed.where("code = 'ok'")
    return d.select("bundle_id", F.lit("lock").alias("kind"), F.col("doc.format").alias("format"), F.col("doc.manifestDigest").alias("manifest_digest"), F.col("doc.treeDigest").alias("tree_digest"), F.size("doc.sources").alias("n_sources"), F.size("doc.files").alias("n_files"), F.lit("resolved").alias("confidence"))


def inspect_bundles(manifests: DataFrame, configs: DataFrame) -> DataFrame:
    """Parsed manifests beside their parsed configs, without the payload; all came by their digests, so digest-verified."""
    m = manifests.where("code = 'ok'").select("bundle_id", F.col("doc.config.digest").alias("config_digest"), F.col("doc.layers")[0]["digest"].alias("layer_digest"), F.col("doc.layers")[0]["size"].alias("layer_size"))
    c = configs.where("code = 'ok'").select("bundle_id", F.col("doc.format").alias("format"), F.col("doc.treeDigest").alias("tree_digest"), F.col("doc.fileCount").alias("n_files"), F.col("doc.totalSize").alias("total_size"))
    return m.join(c, "bundle_id").withColumns({"kind": F.lit("bundle"), "confidence": F.lit("digest-verified")})


def template(path: str = ".", name: str = "example", kinds: Kinds = Kinds(), kind: str = SPEC_KIND) -> str:
    """A spec to begin with, of one directory; whatever the path holds, it stays one quoted text."""
    quoted = json.dumps(path or ".", ensure_ascii=False)
    return f"""apiVersion: {kinds.api_version}
kind: {kind}
metadata:
  name: {name}
spec:
  sources:
    - name: files
      type: path
      mountPath: ""
      include: ["**"]
      exclude: []
      config:
        path: {quoted}
"""
