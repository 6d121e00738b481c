"""Tables written between steps: several readers then cost one computation, and a lost executor costs no more than a step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parquet's pages and row groups end by bytes, looked at after every row. By default they are looked at after 100 rows at the
#: earliest, which is 400 MB of an archive's parts in one page, held by its writer, its compressor, its reader and a shuffle.
BY_BYTES = {"parquet.block.size": str(16 << 20), "parquet.page.size.check.estimate": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master without that setting, one of this machine; elsewhere that setting is required."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/arborix-local"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back; the session's folder is removed when its JVM ends."""
    spark = df.sparkSession
    home = f"{folder(spark)}/arborix-steps/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.options(**BY_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
