"""Memo checks and running summaries over streams of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.published import KeyedStore


def first_results(results: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key (id, fingerprint), so that a repeated result isn't taken twice;
    state is dropped once the watermark has passed."""
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Completed and failed results by key, for the complete output mode."""
    return results.groupBy(*keys).agg(F.count("*").alias("results"), F.count_if(F.col("status") == "error").alias("errors"))


def windowed_counts(results: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Results by window and key, final once the watermark has passed, for the append mode."""
    return results.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("results")).select("window.start", "window.end", *keys, "results")


def upsert_batches(results: DataFrame, store: KeyedStore, checkpoint: str):
    """Puts each micro-batch into a keyed store, once: a batch is known by the stream's id, which its checkpoint keeps, and its number."""

    def put(batch: DataFrame, number: int) -> None:
        store.upsert(batch, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number)

    return results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
