"""Quality rules: a decision list learned from labelled statistics, applied as a Spark conditional expression.

Statistics of every whole text come from built-in functions only. Sequential
covering learns the list from at most max_labelled labelled rows: a rule grows by
the threshold condition of highest information gain until it covers no good text,
is pruned on rows held out from growing, and stays only if it is precise there;
the rows that it covers go, and the next rule follows. The list is an ordered
conditional expression over integer columns.

A null text counts as empty, which the base rule rejects; a null id matches no
label; repeated rows are judged alike; an empty table gives no rows; without labels
the list is empty and the base rule alone decides. Ids whose labels disagree count
as bad; of equally good conditions the first in the order of FEATURES is taken.
Windows of words are compared by 64-bit hash within one text; a very long text is
one row, in memory in proportion to it. Columns other than those of keep and the
text are not read; a name of keep must not start with __ unless it is __row.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokens
from .samples import sampled

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 5


class Condition(NamedTuple):
    feature: str
    at_least: bool
    bound: int


class Rule(NamedTuple):
    name: str
    conditions: tuple[Condition, ...]
    bad: int
    good: int


def _permille(part: str, whole: str) -> str:
    return f"if({whole} > 0, {part} * 1000 div {whole}, 0L)"


#: What rules may test: integers computed from the statistics.
FEATURES = {
    "symbols_permille": _permille("n_symbols", "word_chars"),
    "capitals_permille": _permille("__upper", "word_chars"),
    "exclaim_permille": _permille("__bang", "word_chars"),
    "dup_lines_permille": _permille("n_dup_lines", "__lines"),
    "repeat_permille": _permille("n_repeat_words", "n_words"),
    "distinct_permille": _permille("__distinct", "n_words"),
    "word_length_permille": _permille("word_chars", "n_words"),
    "n_words": "n_words",
}


#: Words in windows that occur twice or more, from the hashes __h of all windows. Each name is bound once by a transform over
#: one element; most texts repeat no window and stop at the first test.
REPEATED = f"""get(transform(array(__h), h -> if(size(array_distinct(h)) = size(h), 0L,
    get(transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
    get(transform(array(sort_array(transform(
        filter(sequence(0, size(s) - 1), j -> get(s, j - 1).x <=> get(s, j).x or get(s, j + 1).x <=> get(s, j).x),
        j -> get(s, j).i))), p ->
    aggregate(sequence(0, size(p) - 1), {WINDOW}L, (n, j) -> n + if(j = 0, 0, least({WINDOW}, get(p, j) - get(p, j - 1))))
    ), 0)), 0))), 0)"""


def _count(pattern: str) -> Column:
    """Characters of the text that the pattern for all others leaves."""
    return F.length(F.regexp_replace("__text", pattern, "")).cast("long")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, the base statistics and FEATURES of every row; internal columns start with __."""
    t = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    t = t.withColumn("__words", tokens(F.col("__text"))).withColumn("__all_lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    nth = ", ".join(f"get(__words, i + {j})" for j in range(WINDOW))
    t = t.withColumn("__h", F.expr(f"if(size(__words) < {WINDOW}, array(), transform(sequence(0, size(__words) - {WINDOW}), i -> xxhash64({nth})))"))
    t = t.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("__words")).cast("long").alias("__distinct"),
        _count(r"[^#*$%&|<>]+").alias("n_symbols"),
        _count(r"[^!]+").alias("__bang"),
        _count(r"[^\p{Lu}]+").alias("__upper"),
        F.size("__all_lines").cast("long").alias("__lines"),
        (F.size("__all_lines") - F.size(F.array_distinct("__all_lines"))).cast("long").alias("n_dup_lines"),
        "__h",
    )
    t = t.withColumn("n_repeat_words", F.expr(REPEATED))
    # a filter above would else be pushed below and compute its statistics anew for each condition
    t = t.withColumn("__barrier", F.monotonically_increasing_id())
    return t.select(*keep, *BASE, *(F.expr(c).alias(n) for n, c in FEATURES.items() if n != "n_words"), "__barrier")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _covers(conditions: tuple[Condition, ...], row: dict) -> bool:
    return all((row[c.feature] >= c.bound) if c.at_least else (row[c.feature] <= c.bound) for c in conditions)


def _best_condition(rows: list[dict]) -> Condition | None:
    """The condition with the most information gain, by one sweep over each feature's sorted values; bounds lie midway between two."""
    bad = sum(r["bad"] for r in rows)
    before, best, found = math.log2(bad / len(rows)), 1e-9, None
    for feature in FEATURES:
        for at_least in (True, False):
            p = n = 0
            ordered = sorted(rows, key=lambda r: -r[feature] if at_least else r[feature])
            for row, follower in zip(ordered, [*ordered[1:], None], strict=True):
                p += row["bad"]
                n += 1
                if follower is None or follower[feature] == row[feature] or not p:
                    continue
                if (gain := p * (math.log2(p / n) - before)) > best:
                    best, found = gain, Condition(feature, at_least, (row[feature] + follower[feature] + at_least) // 2)
    return found


def _worth(rows: list[dict], conditions: tuple[Condition, ...]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if _covers(conditions, r)]
    return sum(hit), len(hit) - sum(hit)


def learn(rows: list[dict], precision: float = 0.9, most_conditions: int = 3, least_bad: int = 5) -> list[Rule]:
    """Sequential covering over rows with the integer FEATURES and bad (0 or 1); every third row is held out for pruning."""
    grow, prune, rules = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0], []
    while any(r["bad"] for r in grow):
        conditions, covered = (), grow
        while len(conditions) < most_conditions and not all(r["bad"] for r in covered):
            if (c := _best_condition(covered)) is None:
                break
            conditions += (c,)
            covered = [r for r in covered if _covers((c,), r)]
        if not conditions:
            break
        tried = []
        for k in range(len(conditions), 0, -1):
            p, n = _worth(prune, conditions[:k])
            tried.append(((p - n) / max(p + n, 1), -k, p, n))
        score, k, p, n = max(tried)
        if p + n < least_bad or p < precision * (p + n):
            break
        rules.append(Rule(f"reject_{len(rules) + 1}", conditions[:-k], p, n))
        grow, prune = ([r for r in part if not _covers(conditions[:-k], r)] for part in (grow, prune))
    return rules


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, learnable: Column | None = None) -> list[dict]:
    """Statistics of at most max_labelled labelled rows that pass the base rule, however often an id repeats; chosen and ordered by hash."""
    fit = F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
    known = labels.where(fit if learnable is None else fit & learnable).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    chosen = sampled(known, max_labelled, "doc_id")  # at most max_labelled rows of 12 bytes: bounded, so it may be broadcast
    some = sampled(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), max_labelled, "doc_id", "text")
    stats = statistics(some.select(F.xxhash64("doc_id", "text").alias("__order"), "__quality", "text"), ["__order", "__quality"])
    got = stats.select("__order", (1 - F.col("__quality")).alias("bad"), *FEATURES, base_failed().alias("failed")).collect()
    rows = [r.asDict() for r in got if not r.failed]
    return sorted(rows, key=lambda r: (r["__order"], r["bad"], *(r[f] for f in FEATURES)))


def expression(rules: list[Rule]) -> Column:
    """The decision list: the name of the first rule that fires, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        tests = [(F.col(c.feature) >= c.bound) if c.at_least else (F.col(c.feature) <= c.bound) for c in rule.conditions]
        out = F.when(reduce(lambda a, b: a & b, tests), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """statistics() with base_failed, rule (of the list, else null) and kept."""
    t = statistics(docs, keep).withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), expression(rules)))
    # the number of the row is never negative: it only keeps a filter by kept from computing each statistic anew
    return t.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull() & (F.col("__barrier") >= 0)).drop("__barrier")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = learn(labelled(docs, table(spark, sf_dir, "labels")))
    return judge(docs, rules, ["doc_id"]).select("doc_id", *BASE, "base_failed", "kept", "rule")
