"""Shared helpers of the operators: input columns, the shared folder, small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\x20\x09-\x0D]"
HOT_SHARE = 256  # a key is hot if it holds more than 1 / HOT_SHARE of the rows; so at most HOT_SHARE keys are


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A session on this machine alone (a local master) may do without; any other without that setting is refused, for its
    executors would write to folders that the others can't read.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/arborix-local"


def _at(spark: SparkSession, place: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to a new place in the shared folder and read that back.

    The files outlive lost executors. drop_written() removes one table; the session's folder is removed when its JVM ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/arborix/{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    fs, at = _at(spark, folder)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arborix_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Remove what written() wrote for df; df can't be read any more."""
    fs, at = _at(df.sparkSession, df._arborix_path)
    fs.delete(at, True)


def split_join(rows: DataFrame, small: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with small (one row a key) without a task that gets all rows of a hot key.

    n: a column of small that counts the rows of its key, total: of all rows. The keys with more than total / HOT_SHARE
    rows are HOT_SHARE at most, so they are broadcast whatever the size of small; the rest is joined as any other.
    """
    bound = max(total // HOT_SHARE, 1)
    hot = F.broadcast(small.where(F.col(n) > bound).withColumn("__hot", F.lit(True)).drop(n))
    some = rows.join(hot, key, "left")
    extra = [c for c in small.columns if c not in (key, n)]
    first = some.where("__hot").select(*rows.columns, *extra)
    rest = some.where("__hot is null").select(*rows.columns).join(small.where(F.col(n) <= bound).drop(n), key, how)
    return first.unionByName(rest.select(*first.columns))


def with_columns(fields: list[T.StructField], ddl: str) -> T.StructType:
    """The schema of the fields, whatever their names and types, and then those of the DDL string."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def tokens(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

