"""Queries of archives, documents, locations, layouts and evaluation, each with its SQL; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, references
from ..operators import archives as ar
from ..operators import documents as docs
from ..operators import evaluation as ev
from ..operators import inventory as inv
from ..operators import specs
from ..sources import directory, layout
from ..sources.stage import written
from .queries import EVALUATED_AT, ORACLE_SQL, OTHER, POLICY, QUERIES, RULE_SQL, SUBJECT, TREE, altered_tree, document_tree, event_subjects, evidence, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]

KINDS = docs.Kinds()


def digest_sql(rows: str) -> str:
    return f"'sha256:' || sha256(unhex('{digests.TREE_DOMAIN.encode().hex()}' || lpad(hex(count(*)), 16, '0') || string_agg(lpad(hex(strlen(path)), 8, '0') || hex(path) || lpad(hex(mode), 8, '0') || lpad(hex(size), 16, '0') || upper(substr(digest, 8)), '' order by path))) as tree_digest from {rows} group by bundle_id"


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return d.select(F.coalesce("source", F.lit("")).alias("bundle_id"), path.alias("path"), F.when(F.col("doc_id") % 7 == 0, 493).otherwise(420).alias("mode"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


@query(f"with {TREE}, e as (select bundle_id, path as name, 'file' as kind, mode, size, digest from tree union all select distinct bundle_id, split_part(path, '/', 1), 'directory', 493, 0, null from tree) select bundle_id, row_number() over (partition by bundle_id order by kind, name) - 1 as entry_no, name, kind, mode, size, digest from e")
def layer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of the archives of all documents."""
    return ar.entries(ar.pack(document_files(spark, sf_dir))).where("kind <> 'layer'")


@query(f"with {TREE}, {OTHER} select t.bundle_id, 'invalid-artifact' as code, t.path, 'not declared' as message from tree t where not exists (select 1 from other o where o.bundle_id = t.bundle_id and o.path = t.path) union all select t.bundle_id, 'digest-mismatch', t.path, case when t.size <> o.size then 'size differs' else 'content differs' end from tree t join other o on o.bundle_id = t.bundle_id and o.path = t.path where t.digest <> o.digest union all select o.bundle_id, 'invalid-artifact', o.path, 'declared, not delivered' from other o where not exists (select 1 from tree t where o.bundle_id = t.bundle_id and o.path = t.path)")
def layer_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all documents held against an altered inventory."""
    read = written(ar.entries(ar.pack(document_files(spark, sf_dir))), "entries")
    return ar.archive_findings(read, altered_tree(spark, sf_dir), max_files=1 << 40)


@query(f"with {TREE} select bundle_id, {digest_sql('tree')}")
def expand_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree digest of what packing and expanding gives back."""
    files = document_files(spark, sf_dir)
    parts, want = written(ar.pack(files), "parts"), ar.inventory_of(files)
    faults = ar.archive_findings(written(ar.entries(parts), "entries"), want, max_files=1 << 40)
    return inv.tree_digest(ar.inventory_of(ar.expand(parts, want, faults))).select("bundle_id", "tree_digest")


CONFIG_SQL = f"c as (select bundle_id, '{{\"fileCount\":' || count(*) || ',\"files\":[' || string_agg('{{\"digest\":\"' || digest || '\",\"mode\":' || mode || ',\"path\":\"' || path || '\",\"size\":' || size || '}}', ',' order by path) || '],\"format\":\"{KINDS.format}\",\"schemaVersion\":1,\"totalSize\":' || sum(size) || ',\"treeDigest\":\"' || {digest_sql('tree').replace(' as tree_digest from tree group by bundle_id', '')} || '\"}}' as config from tree group by bundle_id)"


@query(f"with {TREE}, {CONFIG_SQL} select bundle_id, 'sha256:' || sha256(config) as digest, strlen(config)::bigint as size from c")
def config_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.encode_configs(document_tree(table(spark, sf_dir, "documents"))).select("bundle_id", "digest", "size")


MANIFEST_SQL = f"'{{\"artifactType\":\"{KINDS.artifact_type}\",\"config\":{{\"digest\":\"' || d || '\",\"mediaType\":\"{KINDS.config_type}\",\"size\":' || n || '}},\"layers\":[{{\"digest\":\"' || d || '\",\"mediaType\":\"{KINDS.layer_type}\",\"size\":' || n || '}}],\"mediaType\":\"{docs.MANIFEST_TYPE}\",\"schemaVersion\":2}}'"


@query(f"with {TREE}, d as (select bundle_id || '/' || path as bundle_id, digest as d, size as n from tree) select bundle_id, {MANIFEST_SQL} as manifest, 'sha256:' || sha256({MANIFEST_SQL}) as digest from d")
def manifest_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_tree(table(spark, sf_dir, "documents")).select(F.concat_ws("/", "bundle_id", "path").alias("bundle_id"), "digest", "size")
    return docs.encode_manifests(d, d)


@query(f"with {TREE}, h as (select bundle_id, count(*) as n, sum(size) as total from tree group by 1) select bundle_id, 'invalid-artifact' as code, '' as path, case when strlen(bundle_id) % 2 = 0 then 'file count' else 'total size' end as message from h where strlen(bundle_id) % 2 = 0 or n % 2 = 0")
def config_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs with wrong counts and totals planted by a rule."""
    tree = document_tree(table(spark, sf_dir, "documents"))
    even = F.octet_length("bundle_id") % 2 == 0
    h = inv.tree_digest(tree).select("bundle_id", F.lit(1).alias("schema_version"), F.lit(KINDS.format).alias("format"), "tree_digest", (F.col("n_files") + even.cast("long")).alias("file_count"), (F.col("total_size") + (F.col("n_files") % 2 == 0).cast("long")).alias("total_size"))
    pos = F.row_number().over(inv.W.partitionBy("bundle_id").orderBy("path"))
    return docs.config_findings(h, tree.withColumn("pos", pos))


@query(f"with {TREE}, {OTHER}, a as (select bundle_id, {digest_sql('tree')}), b as (select bundle_id, {digest_sql('other')}) select 'all' as bundle_id, coalesce(a.bundle_id, b.bundle_id) as source, case when b.bundle_id is null then 'not-locked' when a.bundle_id is null then 'not-declared' else 'changed' end as reason from a full join b on a.bundle_id = b.bundle_id where a.tree_digest is distinct from b.tree_digest")
def lock_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: inv.tree_digest(t).select(F.lit("all").alias("bundle_id"), F.col("bundle_id").alias("source"), "tree_digest")
    return docs.stale_locks(of(document_tree(table(spark, sf_dir, "documents"))), of(altered_tree(spark, sf_dir)))



@query(
    f"with r as (select doc_id, lang, doc_id % 4 = 1 as l, doc_id % 3 <> 2 as host, doc_id % 5 < 2 as t, doc_id % 7 < 2 as g, case doc_id % 3 when 0 then 'registry.example.com:5000' when 1 then 'localhost' else 'team' end as h from documents), "
    f"p as (select *, lang is not null and (l or host) and not (t and g) as ok from r) "
    f"select doc_id, case when not coalesce(ok, false) then '' when l then 'oci-layout' else 'oci' end as scheme, case when ok and not l then h else '' end as registry, case when ok and not l then lang || '/c' || doc_id else '' end as repository, case when ok and l then '/' || h || '/' || lang || '/c' || doc_id else '' end as path, case when ok and t then 'v' || doc_id else '' end as tag, case when ok and g then 'sha256:' || sha256(doc_id::varchar) else '' end as digest, case when ok then 'ok' else 'invalid-input' end as code from p"
)
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    scheme = F.when(n % 4 == 0, "oci://").when(n % 4 == 1, "oci-layout:///").otherwise("")
    host = F.when(n % 3 == 0, "registry.example.com:5000/").when(n % 3 == 1, "localhost/").otherwise("team/")
    tag = F.when(n % 5 < 2, F.concat(F.lit(":v"), n)).otherwise("")
    digest = F.when(n % 7 < 2, F.concat(F.lit("@sha256:"), F.sha2(n.cast("string"), 256))).otherwise("")
    raw = F.concat(scheme, host, "lang", F.lit("/c"), n, tag, digest)
    return table(spark, sf_dir, "documents").select("doc_id", references.parse_reference(raw).alias("r")).select("doc_id", "r.*")


@query("select page_id, regexp_replace(regexp_replace(url, '[?#].*\\z', '', 's'), '\\A([A-Za-z][A-Za-z0-9+.-]*://)[^/]*@', '\\1') as url from pages")
def url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", references.redacted(F.col("url")).alias("url"))


@query("select doc_id, 'sha256:' || sha256('DSSEv1 8 http://t ' || strlen(text) || ' ' || text) as digest from documents")
def signed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = references.pre_authentication(F.lit("http://t"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", digests.sha256_text(form).alias("digest"))


def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("layout"), s("event_id").alias("digest"), F.lit("m").alias("media_type"), F.length("props").cast("long").alias("size"), F.lit("a").alias("artifact_type"), F.when(F.col("event_id") % 3 != 0, s("event_type")).alias("tag"), F.lit(None).cast("string").alias("subject"), F.col("event_id").alias("seq"))


@query("select layout, tag, digest from (select user_id % 20 || '' as layout, case when event_id % 3 <> 0 then event_type end as tag, event_id || '' as digest, row_number() over (partition by user_id % 20, case when event_id % 3 <> 0 then event_type else event_id || '' end order by event_id % 2 desc, event_id desc) as rn from events) where rn = 1")
def catalog_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events put into the catalogue that the even ones left: a tag goes to the last one put, whatever held it."""
    rows = event_catalog(spark, sf_dir)
    held = layout.put_manifests(rows.limit(0), rows.where("seq % 2 = 0"))
    return layout.put_manifests(held, rows.where("seq % 2 = 1")).select("layout", "tag", "digest")


@query("with c as (select o_orderstatus as layout, o_custkey || '' as tag, count(*) as n, min(o_orderkey || '') as digest from orders group by 1, 2) select 'F' as layout, c_custkey || '' as tag, case when n = 1 then digest end as digest, case when n is null then 'not-found' when n > 1 then 'invalid-artifact' else 'ok' end as code from customer left join c on c.layout = 'F' and c.tag = c_custkey || ''")
def tag_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("layout"), F.col("o_orderkey").cast("string").alias("digest"), F.col("o_custkey").cast("string").alias("tag"))
    return layout.find_tags(catalog, table(spark, sf_dir, "customer").select(F.lit("F").alias("layout"), F.col("c_custkey").cast("string").alias("tag")))


@query("select doc_id, 'changed' as state from documents join labels using (doc_id) where toxic = 1 or quality is null")
def claims_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed against recomputed digests: those of documents labelled toxic are recomputed over another text."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    claim = d.select("doc_id", F.lit("b").alias("bundle_id"), F.col("doc_id").alias("source"), digests.sha256_text(F.coalesce("text", F.lit(""))).alias("tree_digest"))
    now = d.select(F.lit("b").alias("bundle_id"), F.col("doc_id").alias("source"), digests.sha256_text(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("toxic") == 1, "!").otherwise(""))).alias("tree_digest"))
    return directory.changed(claim, now).select("doc_id", F.lit("changed").alias("state"))


RULES = ev.Rules(POLICY.identities, 2, require_log=True, max_age_seconds=864_000, predicate_types=["purchase", "view"], max_files=100)
OLD = f"(ts is null or epoch_us(timestamp '{EVALUATED_AT}') - epoch_us(ts) > 864000 * 1000000::bigint)"


@query(
    f"with e as (select {SUBJECT} as subject_digest, event_id || '' as digest, {RULE_SQL} as rule, event_id % 3 <> 0 as log, event_id % 10 = 0 as fb, event_type, ts, event_id % 200 >= 100 as other from events), "
    "s as (select subject_digest, count(*) as n_files, count(distinct rule) as n, count(rule) as accepted from e group by 1), "
    "f as (select subject_digest, 'resource-limit' as code from s where n_files > 100 union all select subject_digest, 'signature-threshold' from s where n < 2 union all select subject_digest, 'transparency-proof' from s where accepted = 0 "
    f"union all select subject_digest, 'transparency-proof' from e where rule is not null and not log union all select subject_digest, 'evidence-expired' from e where rule is not null and {OLD} "
    "union all select subject_digest, 'predicate-not-allowed' from e where rule is not null and event_type not in ('purchase', 'view') union all select subject_digest, 'subject-mismatch' from e where rule is not null and other union all select subject_digest, 'tag-fallback-not-allowed' from e where fb) "
    "select subject_digest, code, count(*) as n from f group by 1, 2"
)
def trust_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a whole evaluation by subject and code."""
    n, none = F.col("digest").cast("long"), F.lit(None).cast("string")
    said = F.when(n % 200 >= 100, "another").otherwise(F.col("subject_digest"))
    e = evidence(spark, sf_dir)
    statement = F.struct(e["identities"][0]["issuer"].alias("predicate_type"), said.alias("subject_digest"), none.alias("tree_digest"), none.alias("format"), none.alias("lock_digest"), none.alias("builder"), F.array().cast("array<struct<name:string,type:string,url:string,tree_digest:string>>").alias("sources"))
    e = e.withColumns({"log_verified": n % 3 != 0, "via_fallback": n % 10 == 0, "statement": statement})
    subjects = event_subjects(e)
    found = ev.evaluate(RULES, subjects, e, F.lit(EVALUATED_AT).cast("timestamp"))
    return found.groupBy("subject_digest", "code").agg(F.count("*").alias("n"))


LANGS = "l as (select distinct coalesce(source, '') as bundle_id, coalesce(lang, 'none') as lang from documents)"
SPEC_SOURCE = """'{"config":{"path":"' || lang || '"},"include":["**","*.txt"],"name":"' || lang || '","type":"path"}'"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("bundle_id"), F.coalesce("lang", F.lit("none")).alias("lang")).distinct()


@query(f"with {LANGS}, t as (select bundle_id, count(*) as n, '{{\"apiVersion\":\"{KINDS.api_version}\",\"kind\":\"{specs.SPEC_KIND}\",\"metadata\":{{\"name\":\"corpus\"}},\"spec\":{{\"sources\":[' || string_agg({SPEC_SOURCE}, ',' order by lang) || ']}}}}' as text from l group by 1) select bundle_id, 'corpus' as name, 'sha256:' || sha256(text) as digest, n::int as n_sources, 'authored' as confidence from t")
def spec_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspection shows of the spec of each source, whose sources are declared last first and whose patterns are repeated."""
    pattern = F.array(F.lit("*.txt"), F.lit("**"), F.lit("*.txt"))
    one = F.struct(F.lit("path").alias("type"), F.lit(".").alias("mountPath"), F.col("lang").alias("name"), pattern.alias("include"), F.struct(F.col("lang").alias("path")).alias("config"))
    listed = languages(spark, sf_dir).select("bundle_id", F.to_json(one).alias("j"), "lang").groupBy("bundle_id").agg(F.expr("listagg(j, ', ') within group (order by lang desc)").alias("js"))
    text = F.format_string('{"spec": {"sources": [%s]}, "metadata": {"name": "corpus"}, "kind": "' + specs.SPEC_KIND + '", "apiVersion": "' + KINDS.api_version + '"}', "js")
    return specs.inspect_specs(specs.parse_specs(listed.select("bundle_id", text.alias("text")))).select("bundle_id", "name", "digest", "n_sources", "confidence")


LOCK_FILE = """'{"digest":"' || digest || '","mode":' || mode || ',"path":"' || path || '","size":' || size || ',"source":"' || split_part(path, '/', 1) || '","sourcePath":"' || split_part(path, '/', 2) || '"}'"""
LOCK_SOURCE = """'{"mountPath":"' || lang || '","name":"' || lang || '","requested":{"path":"' || lang || '"},"resolver":"path","treeDigest":"sha256:' || sha256(lang) || '","type":"path"}'"""


@query(
    f"with {TREE}, {LANGS}, f as (select bundle_id, string_agg({LOCK_FILE}, ',' order by path) as files from tree group by 1), s as (select bundle_id, string_agg({LOCK_SOURCE}, ',' order by lang) as sources from l group by 1), d as (select bundle_id, {digest_sql('tree')}), "
    f"k as (select bundle_id, '{{\"apiVersion\":\"{KINDS.api_version}\",\"files\":[' || files || '],\"format\":\"{KINDS.format}\",\"kind\":\"{KINDS.lock_kind}\",\"manifestDigest\":\"sha256:' || sha256(bundle_id) || '\",\"sources\":[' || sources || '],\"treeDigest\":\"' || tree_digest || '\"}}' as lock from f join s using (bundle_id) join d using (bundle_id)) select bundle_id, 'sha256:' || sha256(lock) as digest, strlen(lock)::bigint as size from k"
)
def lock_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lock of each source's tree."""
    langs, none = languages(spark, sf_dir), F.array().cast("array<string>")
    sources = langs.select("bundle_id", F.col("lang").alias("name"), F.lit("path").alias("type"), F.lit("path").alias("resolver"), F.lit("").alias("resolver_version"), F.create_map(F.lit("path"), "lang").alias("requested"), F.create_map().cast("map<string,string>").alias("resolved"), digests.sha256_text(F.col("lang")).alias("tree_digest"), F.col("lang").alias("mount"), none.alias("include"), none.alias("exclude"))
    files = document_tree(table(spark, sf_dir, "documents")).withColumns({"source": F.substring_index("path", "/", 1), "source_path": F.substring_index("path", "/", -1)})
    heads = langs.select("bundle_id").distinct().withColumn("digest", digests.sha256_text(F.col("bundle_id")))
    locks = specs.encode_locks(heads, sources, files)
    return locks.select("bundle_id", "digest", F.octet_length("lock").cast("long").alias("size"))
