"""Restart points and row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_BITS = (1 << 33) - 1


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the folder in spark.checkpoint.dir, which executors share; its lineage
    ends there.  Where a session names none, one machine gets a temporary folder, a cluster an error."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='sieveworks-')}")
    return context.getCheckpointDir()


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the same folder: like `settled`, for tables of which later steps read some columns, or the rows of some values of `by`."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """The rows with a number from 1 in a total order, without gathering them in one task.

    They are range-partitioned and sorted; a row's number is its place in its partition plus the
    rows before.  Only the partitions' sizes go to the driver.  The rows are a table before, as they
    are read twice: for the bounds of the ranges, and to be dealt by them."""
    placed = stored(df).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stored(placed)
    sizes = {r.p: r.n for r in placed.groupBy(F.shiftright("_place", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*map(F.lit, before or [0])), (F.shiftright("_place", 33) + 1).cast("int"))
    return placed.withColumn(name, (F.col("_place").bitwiseAND(F.lit(_ROW_BITS)) + offset + 1).cast("bigint")).drop("_place")
