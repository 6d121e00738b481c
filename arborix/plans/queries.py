"""Registered queries of the inventory engine, each with the same in DuckDB's SQL.

The tables play the parts of file trees: a document is a file lang/doc_id.txt of
the bundle named by its source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical_json, digests, globs, paths
from ..operators import evaluation as ev
from ..operators import inventory as inv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_tree(docs: DataFrame) -> DataFrame:
    path = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("source", F.lit("")).alias("bundle_id"), path.alias("path"), F.when(F.col("doc_id") % 7 == 0, 493).otherwise(420).alias("mode"), F.octet_length(text).cast("long").alias("size"), digests.sha256_text(text).alias("digest"))


TREE = "tree as (select coalesce(source, '') as bundle_id, coalesce(lang, 'none') || '/' || doc_id || '.txt' as path, case when doc_id % 7 = 0 then 493 else 420 end as mode, strlen(coalesce(text, ''))::bigint as size, 'sha256:' || sha256(coalesce(text, '')) as digest from documents)"
OTHER = "other as (select coalesce(source, '') as bundle_id, coalesce(lang, 'none') || '/' || doc_id || '.txt' as path, case when (doc_id % 7 = 0) <> (doc_id % 17 = 0) then 493 else 420 end as mode, strlen(t)::bigint as size, 'sha256:' || sha256(t) as digest from (select *, case when doc_id % 13 = 0 then coalesce(text, '') || 'x' else coalesce(text, '') end as t from documents where doc_id % 11 <> 0) union all select 'src0', 'bench/' || item_id || '.txt', 420, strlen(text)::bigint, 'sha256:' || sha256(text) from benchmark)"
DIFF = "changes as (select coalesce(a.bundle_id, b.bundle_id) as bundle_id, coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' when a.digest <> b.digest then 'modified' when a.mode <> b.mode then 'mode-changed' end as change, a.digest as old_digest, b.digest as new_digest from tree a full join other b on a.bundle_id = b.bundle_id and a.path = b.path)"


def altered_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.col("text")))
    flip = F.expr("doc_id % 7 = 0") != F.expr("doc_id % 17 = 0")
    tree = document_tree(docs).drop("mode")
    doc_id = F.regexp_extract("path", r"/(-?[0-9]+)\.txt\z", 1).cast("long")
    tree = tree.withColumn("doc_id", doc_id).withColumn("mode", F.when(flip, 493).otherwise(420))
    bench = table(spark, sf_dir, "benchmark").select(F.lit("src0").alias("bundle_id"), F.concat(F.lit("bench/"), "item_id", F.lit(".txt")).alias("path"), F.lit(420).alias("mode"), F.octet_length("text").cast("long").alias("size"), digests.sha256_text(F.col("text")).alias("digest"))
    return tree.select("bundle_id", "path", "mode", "size", "digest").unionByName(bench)


@query(f"with {TREE} select bundle_id, count(*) as n_files, sum(size)::bigint as total_size, 'sha256:' || sha256(unhex('{digests.TREE_DOMAIN.encode().hex()}' || lpad(hex(count(*)), 16, '0') || string_agg(lpad(hex(strlen(path)), 8, '0') || hex(path) || lpad(hex(mode), 8, '0') || lpad(hex(size), 16, '0') || upper(substr(digest, 8)), '' order by path))) as tree_digest from tree group by bundle_id")
def tree_digest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.tree_digest(document_tree(table(spark, sf_dir, "documents")))


@query(f"with {TREE} select bundle_id, 'sha256:' || sha256(unhex('{digests.TREE_DOMAIN.encode().hex()}' || lpad(hex(count(*)), 16, '0') || string_agg(lpad(hex(strlen(path)), 8, '0') || hex(path) || lpad(hex(mode), 8, '0') || lpad(hex(size), 16, '0') || upper(substr(digest, 8)), '' order by path))) as tree_digest from tree group by bundle_id")
def tree_digest_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.tree_digest_stream(document_tree(table(spark, sf_dir, "documents")))


@query(f"with {TREE}, {OTHER}, {DIFF} select * from changes where change is not null")
def diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = inv.diff(document_tree(table(spark, sf_dir, "documents")), altered_tree(spark, sf_dir))
    return changes.select("bundle_id", "path", "change", "old_digest", "new_digest")


@query(f"with {TREE}, {OTHER}, {DIFF} select bundle_id, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'removed') as removed, count(*) filter (where change = 'modified') as modified, count(*) filter (where change = 'mode-changed') as mode_changed from changes where change is not null group by bundle_id")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.diff_summary(inv.diff(document_tree(table(spark, sf_dir, "documents")), altered_tree(spark, sf_dir)))




RESERVED_SQL = ", ".join(f"'{x}'" for x in paths.RESERVED)
BAD_SEGMENT = f"(s = '' or s in ('.', '..') or regexp_matches(s, '[\\x00-\\x1f\\x7f-\\x{{9f}}]') or regexp_matches(s, '[<>:\"|?*\\\\]') or regexp_matches(s, '[ .]\\z') or lower(split_part(s, '.', 1)) in ({RESERVED_SQL}))"


@query(rf"with p as (select page_id, substr(url, strpos(url, '://') + 3) as path from pages) select page_id, path, case when path is null or path = '' or starts_with(path, '/') or ends_with(path, '/') then 'unsafe-path' when strlen(path) > 40 or len(string_split(path, '/')) > 6 then 'limit-exceeded' when len(list_filter(string_split(path, '/'), lambda s: s <> '' and strlen(s) > 30)) > 0 and len(list_filter(string_split(path, '/'), lambda s: s in ('', '.', '..'))) = 0 then 'limit-exceeded' when len(list_filter(string_split(path, '/'), lambda s: {BAD_SEGMENT})) > 0 then 'unsafe-path' else 'ok' end as code from p")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("substr(url, locate('://', url) + 3)").alias("path"))
    return p.withColumn("code", paths.path_code(F.col("path"), 40, 30, 6))


@query("with p as (select page_id, string_split(regexp_extract(substr(url, strpos(url, '://') + 3), '\\A[^?#]*'), '/') as l from pages) select distinct array_to_string(l[1:i], '/') as parent from (select l, unnest(range(1, len(l))) as i from p)")
def path_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract(F.expr("substr(url, locate('://', url) + 3)"), r"\A[^?#]*", 0)
    return table(spark, sf_dir, "pages").select(F.explode(paths.parents(p)).alias("parent")).distinct()


@query("select p_partkey, case when (p_size & 73) <> 0 then 493 else 420 end as mode from part")
def mode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", paths.normal_mode(F.col("p_size")).alias("mode"))


@query("select bundle_id, path, 'duplicate-path' as code, n_sources from (select o_orderstatus as bundle_id, l_orderkey || '/' || l_linenumber as path, count(*) as n, count(distinct l_returnflag) as n_sources from lineitem join orders on o_orderkey = l_orderkey group by 1, 2) where n > 1")
def collision_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = lines.select(F.col("o_orderstatus").alias("bundle_id"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.col("l_returnflag").alias("source"))
    return inv.duplicate_paths(rows).select("bundle_id", "path", "code", F.size(F.split("message", ",")).cast("long").alias("n_sources"))


@query("with w as (select p_brand as bundle_id, unnest([p_name, upper(p_name)]) as path from part) select bundle_id, min(path) as path, max(path) as other from (select distinct bundle_id, path from w) group by bundle_id, lower(path) having count(*) > 1")
def collision_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bundle_id"), F.explode(F.array("p_name", F.upper("p_name"))).alias("path"))
    return inv.fold_clashes(rows).select("bundle_id", "path", F.col("message").alias("other"))


@query("with f as (select 'all' as bundle_id, regexp_extract(substr(url, strpos(url, '://') + 3), '\\A[^?#]*') as path from pages), l as (select string_split(path, '/') as l from f), d as (select distinct array_to_string(l[1:i], '/') as path from (select l, unnest(range(1, len(l))) as i from l)) select distinct f.bundle_id, f.path from f join d on d.path = f.path")
def collision_file_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract(F.expr("substr(url, locate('://', url) + 3)"), r"\A[^?#]*", 0)
    return inv.file_directory_clashes(table(spark, sf_dir, "pages").select(F.lit("all").alias("bundle_id"), p.alias("path"))).select("bundle_id", "path")


@query("select 'corpus' as bundle_id, case when lang = 'en' then doc_id || '.txt' else lang || '/' || doc_id || '.txt' end as path, source, doc_id || '.txt' as source_path from documents")
def compose_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = document_tree(docs.select("doc_id", "text", "lang", F.lit("corpus").alias("source")))
    parts = docs.select(F.lit("corpus").alias("bundle_id"), "source", F.when(F.col("lang") == "en", ".").otherwise(F.col("lang")).alias("mount"), F.concat("doc_id", F.lit(".txt")).alias("path"), F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("full"))
    joined = parts.join(rows.select(F.col("path").alias("full"), "mode", "size", "digest"), "full")
    return inv.compose(joined).select("bundle_id", "path", "source", "source_path")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def inventory_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return inv.missing(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'F')")
def inventory_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return inv.missing(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), declared, ["l_orderkey"])


@query("select conv_id, turn, fault from (select conv_id, turn, case when lag(role) over w = role then 'duplicate' when lag(role) over w > role then 'unsorted' end as fault from conversations window w as (partition by conv_id order by turn)) where fault is not null")
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.order_faults(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "fault")


@query("with l as (select n_regionkey as b, n_nationkey * 7 % 30 as value, n_name as origin, n_nationkey as precedence from nation) select 'r' || b as bundle_id, 'maxFiles' as bound, value, origin from (select *, row_number() over (partition by b order by value, precedence) as rn from l where value > 0) where rn = 1")
def limits_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.lit("r"), "n_regionkey").alias("bundle_id"), F.lit("maxFiles").alias("bound"), (F.col("n_nationkey") * 7 % 30).alias("value"), F.col("n_name").alias("origin"), F.col("n_nationkey").alias("precedence"))
    return inv.resolve_limits(rows)


SUBJECT = "(event_id % 100)::varchar"


STATEMENT = "struct<predicate_type:string,subject_digest:string,tree_digest:string,format:string,lock_digest:string,builder:string,sources:array<struct<name:string,type:string,url:string,tree_digest:string>>>"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence without statements: an event is signed by its user under its type's issuer."""
    none = F.lit(None).cast("string")
    signer = F.struct(none.alias("key_id"), F.col("event_type").alias("issuer"), F.concat(F.lit("user"), F.col("user_id") % 50).alias("subject"))
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 100).cast("string").alias("subject_digest"), F.col("event_id").cast("string").alias("digest"), F.array(signer).alias("identities"), F.lit(True).alias("log_verified"), F.lit(False).alias("via_fallback"), F.col("ts").cast("timestamp").alias("signed_at"), F.lit(None).cast(STATEMENT).alias("statement"))


def event_subjects(e: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return e.groupBy("subject_digest").agg(F.lit(True).alias("by_digest"), none.alias("format"), F.count("*").alias("n_files"), F.lit(0).alias("total_size"), none.alias("tree_digest"))


POLICY = ev.Rules([ev.Identity(issuer="click", subject_pattern="user[0-4]"), ev.Identity(issuer="view", subject="user7"), ev.Identity(issuer="purchase")], threshold=2)
RULE_SQL = "case when event_type = 'click' and regexp_matches('user' || (user_id % 50), '\\A(?:user[0-4])\\z') then 0 when event_type = 'view' and 'user' || (user_id % 50) = 'user7' then 1 when event_type = 'purchase' then 2 end"


@query(f"with s as (select distinct {SUBJECT} as subject_digest from events), c as (select {SUBJECT} as subject_digest, count(distinct {RULE_SQL}) as accepted from events group by 1) select s.subject_digest, coalesce(accepted, 0) as accepted, coalesce(accepted, 0) >= 2 as ok from s left join c using (subject_digest)")
def identity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    counts = ev.signer_counts(e.select("subject_digest").distinct(), ev.accepted(POLICY, e))
    return counts.select("subject_digest", F.col("n_matched").alias("accepted"), (F.col("n_matched") >= POLICY.effective_threshold).alias("ok"))


EVALUATED_AT = "2024-01-31 00:00:00"


@query(f"select {SUBJECT} as subject_digest, count(*) as n_stale from events where ts is null or epoch_us(timestamp '{EVALUATED_AT}') - epoch_us(ts) > 864000 * 1000000::bigint group by 1")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = evidence(spark, sf_dir).where(ev.expired(F.lit(EVALUATED_AT).cast("timestamp"), 864_000))
    return old.groupBy("subject_digest").agg(F.count("*").alias("n_stale"))


@query(f"with e as (select {SUBJECT} as subject_digest, {RULE_SQL} as rule, ts from events), s as (select distinct subject_digest from e), f as (select s.subject_digest from s left join (select subject_digest, count(distinct rule) as n from e group by 1) c using (subject_digest) where coalesce(n, 0) < 2 union all select subject_digest from e where rule is not null and (ts is null or epoch_us(timestamp '{EVALUATED_AT}') - epoch_us(ts) > 864000 * 1000000::bigint)) select s.subject_digest, count(f.subject_digest) as errors, case when count(f.subject_digest) = 0 then 'pass' else 'fail' end as trust from s left join f using (subject_digest) group by 1")
def policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir)
    rules, subjects = ev.Rules(POLICY.identities, 2, max_age_seconds=864_000), event_subjects(e)
    return ev.reports(subjects, ev.evaluate(rules, subjects, e, F.lit(EVALUATED_AT).cast("timestamp"))).select("subject_digest", "errors", "trust")


@query("select page_id, nullif(regexp_replace(regexp_extract(url, '\\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '\\A.*@', ''), '') as host from pages")
def source_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ev.authority(F.col("url")).alias("host"))


RAW_DIGEST = "case doc_id % 4 when 0 then 'sha256:' || sha256(text) when 1 then 'sha256:' || upper(sha256(text)) when 2 then 'sha512:' || sha256(text) else sha256(text) end"


@query(f"select doc_id, case when regexp_matches(d, '\\Asha256:[0-9a-f]{{64}}\\z') then 'ok' when regexp_matches(d, '\\A[a-z0-9+._-]+:') and not starts_with(d, 'sha256:') then 'unsupported-version' else 'invalid' end as code from (select doc_id, {RAW_DIGEST} as d from documents)")
def digest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("text", 256)
    raw = F.expr("doc_id % 4")
    d = F.when(raw == 0, F.concat(F.lit("sha256:"), h)).when(raw == 1, F.concat(F.lit("sha256:"), F.upper(h))).when(raw == 2, F.concat(F.lit("sha512:"), h)).otherwise(h)
    return table(spark, sf_dir, "documents").select("doc_id", digests.digest_code(d).alias("code"))


@query("select l_orderkey, l_linenumber, (l_extendedprice::bigint) // (l_quantity::bigint) as ratio from lineitem where l_quantity::bigint > 0 and l_extendedprice::bigint > 0 and (l_extendedprice::bigint) // (l_quantity::bigint) > 1000")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_quantity").cast("long").alias("compressed"), F.expr("cast(bround(l_extendedprice) as long)").alias("expanded"))
    return inv.over_ratio(sizes, 1000).select("l_orderkey", "l_linenumber", "ratio")
