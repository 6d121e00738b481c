"""A corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs. Columns of any name may stand beside those used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.common import table, written
from arborix.llm.decontaminate import without_leaks
from arborix.llm.mixing import mix
from arborix.llm.quality_rules import judge, labelled, learn
from arborix.llm.sharding import shard_rows
from arborix.llm.near_sets import one_of_each


def _as_row(docs: DataFrame, *used: str) -> DataFrame:
    """Every row whole as __row beside the columns used, so that no other column's name can clash."""
    return docs.select(F.struct(*docs.columns).alias("__row"), *used)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    rules = learn(labelled(docs, table(spark, sf_dir, "labels")))
    judged = judge(_as_row(docs, "text"), rules, ["__row"])
    return judged.where("kept").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by SimHash and an exact check of its links."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of small sources repeated, up to twice."""
    return mix(_as_row(docs, "doc_id", "text", "source"), ["__row"]).select("__row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every row in 16 shards."""
    return shard_rows(docs, payload=["lang", "source"])


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix_sources", mixed), ("shard", sharded)]

#: Learned rules, components and templates aren't expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
