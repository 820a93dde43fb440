"""Tables that a job writes and reads again, in a folder that all executors share, and joins
whose keys may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a key is hot if it meets more than this part of all rows, so there are a thousand hot keys at most
HOT_PART = 1000
HOT_LEAST = 10_000


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir.

    Where it names none, one machine gets a temporary folder; a cluster gets an error, since its
    executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sieveworks-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: a restart point that outlives executors."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables that `written` made, by the file system that Spark uses for their path.

    Only for tables that no later step reads: what was made of them must be written by then."""
    for df in tables:
        remove(df.sparkSession, df.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder by the file system that Spark uses for its path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keyed_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows joined with the rows of unique keys that `keyed` has; `weight` says how many rows each meets.

    Keys that meet more than a thousandth of all rows can only be a thousand, so their rows are
    broadcast; rows with such a key are then dealt by a hash of the whole row instead of the key.
    All others meet by a shuffle.  The rows are read once."""
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    least = max(HOT_LEAST, total // HOT_PART)
    hot = keyed.where(F.col(weight) > least)
    if hot.isEmpty():
        return rows.join(keyed.hint("merge"), on)
    values = [c for c in keyed.columns if c not in on]
    few = hot.select(*on, F.struct(*values).alias("_hot"))
    deal = F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*rows.columns).bitwiseOR(F.lit(1)))
    tagged = rows.join(F.broadcast(few), on, "left").withColumn("_deal", deal)
    cold = keyed.where(F.col(weight) <= least).select(*on, F.lit(0).cast("bigint").alias("_deal"), F.struct(*values).alias("_cold"))
    both = tagged.join(cold.hint("merge"), [*on, "_deal"], "left").withColumn("_met", F.coalesce("_hot", "_cold")).where("_met is not null")
    return both.select(*rows.columns, *(F.col(f"_met.{c}").alias(c) for c in values))
