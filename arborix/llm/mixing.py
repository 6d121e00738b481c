"""Mixing of sources to target weights by temperature.

Each source's share of the tokens is raised to a power; the power is bisected so
that no source repeats more often than a limit (or that the entropy of the mix
reaches a target), and the shares are normalised again. The budget is the least
one under which every source is taken in whole at least once, so mixing repeats
documents and never loses one. A source then gives whole passes and, for what
is left of its tokens, the start of one more. A pass is a block permutation: the
documents are dealt into about sqrt(n) blocks by a hash of pass and document, and
ordered by a second hash within a block, so order and running sums need only a
small table of blocks and one block at a time.

A null source counts as the source ''; a null text has no tokens, and takes part;
sources without tokens are taken once; repeated rows are rows of their own, as are
null ids; an empty table gives no rows. Rows of equal id and text are ordered by the
hash of what is carried. A very long text is one row of many tokens. Columns of any
name but __carry's own may be carried; the others are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, tokens, written

STEPS, WAYS, SALTS = 60, 64, 64


def _fold(step: str, state: str) -> Column:
    return F.expr(f"aggregate(sequence(1, {STEPS}), {state}, (s, i) -> {step})")


def exponent_for_repeat(top: float, least: float, max_repeat: float) -> Column:
    """The least exponent in 0..1 under which the source of the least share repeats no more often than the limit, by bisection.

    Only the largest and the least share decide that, so this folds two numbers, whatever the number of sources.
    """
    mid = "(s.lo + s.hi) / 2"
    fits = f"pow({float(top)!r}D / {float(least)!r}D, 1 - {mid}) <= {float(max_repeat)!r}D"
    return _fold(f"if({fits}, named_struct('lo', s.lo, 'hi', {mid}), named_struct('lo', {mid}, 'hi', s.hi))", "named_struct('lo', 0D, 'hi', 1D)").getField("hi")


def exponent_for_entropy(shares: DataFrame, min_entropy: float, rounds: int = 9) -> float:
    """The largest exponent in 0..1 whose mix has the entropy or more: each round takes the sums of WAYS exponents in one pass and keeps the interval that holds the answer."""
    lo, width = 0.0, 1.0
    for _ in range(rounds):
        tried = [lo + width * i / WAYS for i in range(1, WAYS + 1)]
        sums = [x for a in tried for x in (F.sum(F.pow("__p", F.lit(a))), F.sum(F.pow("__p", F.lit(a)) * F.lit(a) * F.log("__p")))]
        got = shares.agg(*(c.alias(f"x{i}") for i, c in enumerate(sums))).first()
        # entropy of p ** a / z is ln z - sum(p ** a * a * ln p) / z; it falls as the exponent grows
        enough = [a for a, z, t in zip(tried, got[::2], got[1::2], strict=True) if math.log(z) - t / z >= min_entropy]
        lo, width = (enough[-1] if enough else lo), width / WAYS
        if lo >= 1:
            break
    return min(lo, 1.0)


def weights(totals: DataFrame, max_repeat: float | None = 2.0, min_entropy: float | None = None) -> DataFrame:
    """alpha, weight, and repeat (how often its tokens are taken) for each source of totals (source, n_tokens).

    The largest power in 0..1 (nearest to the natural mix) is searched for the entropy, the least (flattest mix) for the limit of repetition.
    Sources stay rows: the driver gets sums, the largest and the least.
    """
    spark, live = totals.sparkSession, totals.where("n_tokens > 0")
    whole = live.agg(F.sum("n_tokens").alias("all"), F.max("n_tokens").alias("top"), F.min("n_tokens").alias("least")).first()
    everything = float(whole["all"] or 1)
    shares = live.select((F.col("n_tokens") / F.lit(everything)).alias("__p"))
    if whole["all"] is None:
        alpha = 1.0
    elif min_entropy is not None:
        alpha = exponent_for_entropy(shares, min_entropy)
    else:
        alpha = spark.range(1).select(exponent_for_repeat(whole["top"], whole["least"], max_repeat)).first()[0]
    z = shares.agg(F.sum(F.pow("__p", F.lit(alpha)))).first()[0] or 1.0
    share, lone = F.col("n_tokens") / F.lit(everything), F.col("n_tokens") <= 0
    weight = F.when(lone, 0.0).otherwise(F.pow(share, F.lit(alpha)) / F.lit(z))
    repeat = F.when(lone, 1.0).otherwise(F.round(F.pow(F.lit(float(whole["top"] or 1)) / F.col("n_tokens"), F.lit(1 - alpha)), 9))
    return totals.select("source", "n_rows", "n_tokens", F.lit(alpha).alias("alpha"), weight.alias("weight"), repeat.alias("repeat"))


def mix(docs: DataFrame, carry: list[str], max_repeat: float | None = 2.0, min_entropy: float | None = None, seed: int = 11) -> DataFrame:
    """One row for each time a document is taken: the columns of carry, then __source, __tokens, __epoch, __block, __position.

    __position is gapless from 0 within source and epoch. Texts are split into words once; what is needed of them is written.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*carry).alias("__carry"), F.coalesce("source", F.lit("")).alias("__source"), F.size(tokens(text)).cast("long").alias("__tokens"), F.xxhash64("doc_id", text).alias("__key"), F.xxhash64(*carry).alias("__tie"))
    rows = written(rows, "mix-rows")
    totals = written(rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__tokens").alias("n_tokens"), F.count("*").alias("n_rows")), "mix-sources")
    plan = weights(totals, max_repeat, min_entropy).select(
        F.col("source").alias("__source"),
        F.floor("repeat").cast("int").alias("__full"),
        F.floor(F.col("n_tokens") * (F.col("repeat") - F.floor("repeat"))).cast("long").alias("__rest"),
        F.ceil(F.sqrt("n_rows")).cast("long").alias("__blocks"),
    )
    # where the plan is too large to broadcast, a source with many rows meets it in SALTS places
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    taken = rows.withColumn("__salt", F.pmod("__key", F.lit(SALTS)).cast("int")).join(salted, ["__source", "__salt"]).withColumn("__epoch", F.explode(F.expr("sequence(0, if(__rest > 0, __full, __full - 1))")))
    taken = taken.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), "__epoch", "__key"), F.col("__blocks")))
    of = ["__source", "__epoch", "__block"]
    cum = W.partitionBy("__source", "__epoch").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = taken.groupBy(*of).agg(F.count("*").alias("__n"), F.sum("__tokens").alias("__t"))
    blocks = blocks.select(*of, F.coalesce(F.sum("__n").over(cum), F.lit(0)).alias("__rows_before"), F.coalesce(F.sum("__t").over(cum), F.lit(0)).alias("__tokens_before"))
    inside = W.partitionBy(*of).orderBy(F.xxhash64(F.lit(seed + 1), "__epoch", "__key"), "__key", "__tie")
    placed = taken.join(blocks, of).withColumn("__position", F.col("__rows_before") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("__spent", F.col("__tokens_before") + F.sum("__tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.where((F.col("__epoch") < F.col("__full")) | (F.col("__spent") <= F.col("__rest")))
    return placed.select("__carry.*", "__source", "__tokens", "__epoch", "__block", "__position")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time a document is taken: source, pass, and place in the pass's order."""
    out = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__position").alias("position"))
