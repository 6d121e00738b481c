"""URL filter: rules first, then trust and distrust propagated over the graph of hosts.

Hosts are joined by edges from a page's host to each host that an absolute or
protocol-relative href or src of the page names, and between a host and its parent
domain in both directions, unless the parent is a suffix under which strangers
register (SHARED_SUFFIXES, a parameter). Trust is a personalised PageRank from the
hosts with allowed pages along the edges; distrust is one from the hosts with
blocked pages against them. A page without a rule is blocked where distrust is more
than the threshold's share of both scores of its host. A share has no unit: it stays
as it is when seeds, pages or subdomains multiply. At 0.5 a host goes to the side
that it stands nearer to; equal scores, and none, leave it allowed.

After ROUNDS rounds a share of DAMPING ** ROUNDS, 2%, of the scores has yet to move,
and hosts up to that many links from a seed have one.

A null url, or one without ://, has empty host and path and so no rule and no
edges; a null html has no links; repeated rows weigh as often as they occur; a null
page_id is kept; an empty table gives no rows; a very long html is one row. Columns
other than page_id, url and html are not read. Hosts that hold many edges, or many
pages, are split.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, ascii_lower, drop_written, split_join, table, written


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/")]
DAMPING, ROUNDS, THRESHOLD, ROUNDING, SPLIT = 0.85, 24, 0.5, 1e-9, 16
#: Suffixes whose names belong to strangers; a longer list is a parameter.
SHARED_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "pages.dev")
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules: list[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits columns host and path; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the links in html, from columns host and html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to"))
    return links.select("src", ascii_lower(F.col("to")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def site_edges(hosts: DataFrame, shared: Iterable[str] = SHARED_SUFFIXES) -> DataFrame:
    """Both directions between each host, or a parent of it, and its parent domain of two labels or more that isn't shared."""
    labels = F.split("host", r"\.")
    chain = hosts.select(F.explode(F.expr(r"if(size(split(host, '[.]')) > 2, sequence(1, size(split(host, '[.]')) - 2), array())")).alias("i"), labels.alias("l"))
    suffix = lambda at: F.array_join(F.slice("l", at, F.size("l")), ".")
    up = chain.select(suffix(F.col("i")).alias("src"), suffix(F.col("i") + 1).alias("dst")).where(~F.col("src").isin(*shared) & ~F.col("dst").isin(*shared)).distinct()
    return up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust), written, from seeds (host, good, bad) and distinct edges (src, dst), both written, after a fixed number of rounds.

    A host without onward edges passes nothing on. A round is one join and one sum: seeds are rows beside the flows. Scores
    are combined before the shuffle, so a hub costs one row a task; a host with many flows meets them in SPLIT places.
    """
    total = edges.count()
    flows = []
    for a, b, trust, distrust in (("src", "dst", 1.0, 0.0), ("dst", "src", 0.0, 1.0)):
        degree = edges.groupBy(a).agg(F.count("*").alias("n")).withColumn("share", 1 / F.col("n")).withColumn("splits", F.when(F.col("n") > total // HOT_SHARE + 1, SPLIT).otherwise(1))
        flows.append(split_join(edges, degree, a, "n", total).select(F.col(a).alias("from"), F.col(b).alias("to"), (F.col("share") * trust).alias("t"), (F.col("share") * distrust).alias("d"), "splits"))
    flows = written(flows[0].union(flows[1]).withColumn("place", F.pmod(F.xxhash64("to"), F.col("splits")).cast("int")), "host-flows")
    many = flows.where("splits > 1").groupBy(F.col("from").alias("host")).agg(F.max("splits").alias("splits"))  # 2 * HOT_SHARE hosts at most
    nodes = seeds.select("host", "good", "bad").union(edges.select("src", F.lit(0.0), F.lit(0.0))).union(edges.select("dst", F.lit(0.0), F.lit(0.0)))
    sums = nodes.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    all_of = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    share = sums.join(F.broadcast(many), "host", "left").select("host", (F.col("good") / (all_of.g or 1.0)).alias("trust"), (F.col("bad") / (all_of.b or 1.0)).alias("distrust"), F.coalesce("splits", F.lit(1)).alias("splits"))
    share = written(share, "host-seeds")
    rank, before = share, None
    for r in range(1, rounds + 1):
        spread = rank.select(F.col("host").alias("from"), "trust", "distrust", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("place"))
        moved = flows.join(spread, ["from", "place"]).select(F.col("to").alias("host"), (damping * F.col("trust") * F.col("t")).alias("trust"), (damping * F.col("distrust") * F.col("d")).alias("distrust"), F.lit(1).alias("splits"))
        fresh = share.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"), "splits")
        rank = moved.union(fresh).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.max("splits").alias("splits"))
        if r % 6 == 0 or r == rounds:
            rank = written(rank, "host-rank")
            if before is not None:
                drop_written(before)
            before = rank
    if before is not None:
        drop_written(flows)
        drop_written(share)
    return rank.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules: list[UrlRule] | None = None, threshold: float = THRESHOLD, shared: Iterable[str] = SHARED_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; rules are a short list, an expression each."""
    name, verdict = first_rule(RULES if rules is None else rules)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = parsed.withColumn("rule", name).withColumn("ruled", verdict)
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("good"), F.count_if(F.col("ruled") == "block").cast("double").alias("bad"), F.count("*").alias("n"))
    seeds = written(seeds, "hosts")
    edges = written(host_edges(parsed).union(site_edges(seeds.select("host"), shared)).distinct(), "host-edges")
    part = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    blocked = propagate(seeds, edges).where((F.col("distrust") > 0) & (part > threshold + ROUNDING)).join(seeds.select("host", "n"), "host")
    blocked = written(blocked.select("host", F.lit("block").alias("spread"), "n"), "hosts-blocked")
    rows = int(seeds.agg(F.sum("n")).first()[0] or 0)
    drop_written(edges)
    drop_written(seeds)
    out = split_join(ruled.drop("html"), blocked, "host", "n", rows, "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle(rules: list[UrlRule] | None = None) -> str:
    """The same in DuckDB's SQL, each round a common table."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r.host + r.path))
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    name = "case " + " ".join(f"when {fits(r)} then '{r.host + r.path}'" for r in rules) + " end"
    verdict = "case " + " ".join(f"when {fits(r)} then '{r.verdict}'" for r in rules) + " end"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    steps = [
        rf"parsed as (select page_id, {lower(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, html from pages)",
        f"ruled as materialized (select page_id, host, path, html, {name} as rule, {verdict} as ruled from parsed)",
        "hosts as materialized (select host, sum(case when ruled = 'allow' then 1.0 else 0.0 end)::double as good, sum(case when ruled = 'block' then 1.0 else 0.0 end)::double as bad from ruled where host <> '' group by host)",
        f"links as (select host as src, {lower('u.x')} as dst from ruled, unnest(regexp_extract_all(html, '{link}', 1)) as u(x))",
        "chain as (select l, unnest(range(1, len(l) - 1)) as i from (select string_split(host, '.') as l from hosts))",
        f"up as (select * from (select array_to_string(l[i:], '.') as src, array_to_string(l[i + 1:], '.') as dst from chain) where src not in {SHARED_SUFFIXES!r} and dst not in {SHARED_SUFFIXES!r})",
        "edges as materialized (select src, dst from links where src <> '' and dst <> '' and src <> dst union select src, dst from up union select dst, src from up)",
        "outs as materialized (select src, count(*) as n from edges group by src)",
        "ins as materialized (select dst, count(*) as n from edges group by dst)",
        "seeds as (select host, sum(good) as good, sum(bad) as bad from (select host, good, bad from hosts union all select src, 0.0, 0.0 from edges union all select dst, 0.0, 0.0 from edges) group by host)",
        "total as (select case when sum(good) > 0 then sum(good) else 1.0 end as g, case when sum(bad) > 0 then sum(bad) else 1.0 end as b from seeds)",
        "r0 as materialized (select host, good / g as trust, bad / b as distrust, good / g as gs, bad / b as bs from seeds, total)",
    ]
    for r in range(ROUNDS):
        steps += [
            f"t{r} as (select e.dst as host, sum(p.trust / o.n) as v from edges e join r{r} p on p.host = e.src join outs o on o.src = e.src group by e.dst)",
            f"d{r} as (select e.src as host, sum(p.distrust / i.n) as v from edges e join r{r} p on p.host = e.dst join ins i on i.dst = e.dst group by e.src)",
            f"r{r + 1} as materialized (select s.host, {1 - DAMPING!r} * s.gs + {DAMPING!r} * coalesce(t.v, 0) as trust, {1 - DAMPING!r} * s.bs + {DAMPING!r} * coalesce(d.v, 0) as distrust, s.gs, s.bs from r{r} s left join t{r} t on t.host = s.host left join d{r} d on d.host = s.host)",
        ]
    return "with " + ", ".join(steps) + f" select u.page_id, u.host, u.path, u.rule, coalesce(u.ruled, case when k.distrust > 0 and k.distrust / (k.trust + k.distrust) > {THRESHOLD!r} + {ROUNDING!r} then 'block' end, 'allow') as verdict from ruled u left join r{ROUNDS} k on k.host = u.host"
