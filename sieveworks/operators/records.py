"""Memoised results, usage, evaluation and report aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import texts, verdicts


def reusable(units: DataFrame, memo: DataFrame) -> DataFrame:
    """Units (id, fingerprint) whose stored result (id, fingerprint, status) has both equal and isn't an error."""
    return units.join(memo.where("status <> 'error'").select("id", "fingerprint").distinct(), ["id", "fingerprint"], "left_semi")


def to_recompute(units: DataFrame, memo: DataFrame) -> DataFrame:
    return units.join(memo.where("status <> 'error'").select("id", "fingerprint").distinct(), ["id", "fingerprint"], "left_anti")


def upserted(memo: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The stored rows, with the new ones in place of those with the same key."""
    return memo.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(runs: DataFrame, keys: list[str], order: str, test: Column) -> DataFrame:
    """The newest row of each key that passes the test; ties keep the greatest row."""
    rest = [c for c in runs.columns if c not in (*keys, order)]
    return runs.where(test).groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_l")).select(*keys, "_l.*")


def error_breakdown(rows: DataFrame, completed: Column, kind: Column) -> DataFrame:
    """(error_type, n) of the rows that aren't completed; a missing type is unknown."""
    return rows.where(~F.coalesce(completed, F.lit(False))).groupBy(F.coalesce(kind, F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n"))


def usage(calls: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Calls, tokens and cost, in all or by key."""
    sums = [F.count("*").alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens"))]
    return calls.groupBy(*keys).agg(*sums) if keys else calls.agg(*sums)


def priced(usage_rows: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Usage by model with its cost; a model without a price has the default's.  prices: model,
    input_price, output_price, for a million tokens: a table of models, so it is small by its kind."""
    joined = usage_rows.join(prices, "model", "left")
    price = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return joined.withColumn("cost", texts.cost(F.col("input_tokens"), F.col("output_tokens"), price("input_price", default[0]), price("output_price", default[1]))).drop("input_price", "output_price")


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: counts, accuracy, precision, recall and F1 (four places) of booleans; rows where
    either is null aren't evaluated; a share of nothing is 0."""
    n = {k: F.count_if(t & p) for k, t, p in (("tp", truth, predicted), ("fp", ~truth, predicted), ("fn", truth, ~predicted), ("tn", ~truth, ~predicted))}
    row = rows.where(truth.isNotNull() & predicted.isNotNull()).agg(*(c.alias(k) for k, c in n.items()))
    share = lambda a, b: F.when(b > 0, F.bround(a / b, 4)).otherwise(0.0)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return row.select("tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def inconsistent_groups(rows: DataFrame, pattern: Column, verdict: Column) -> DataFrame:
    """(pattern, members, verdicts): groups of two or more whose verdicts differ, in capitals; VULNERABLE
    stands for BYPASSABLE too, SAFE for PROTECTED, and nothing else is folded."""
    said = F.upper(F.coalesce(verdict, F.lit("")))
    folded = F.when(said == "BYPASSABLE", "VULNERABLE").when(said == "PROTECTED", "SAFE").otherwise(said)
    groups = rows.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("members"), F.array_sort(F.collect_set(folded)).alias("verdicts"))
    return groups.where("members >= 2 and size(verdicts) > 1")


def unit_statistics(units: DataFrame, kind: str, up: Column, down: Column) -> DataFrame:
    """By kind: units, and the means of two counts to two places, half to even."""
    return units.groupBy(kind).agg(F.count("*").alias("units"), F.bround(F.sum(up) / F.count("*"), 2).alias("mean_up"), F.bround(F.sum(down) / F.count("*"), 2).alias("mean_down"))


def most_common(rows: DataFrame, value: Column, first: Column | None = None) -> DataFrame:
    """(value, n): the value with the most rows; of equal ones that which comes first by `first`, else the least; rows
    without one don't vote."""
    at = F.lit(0) if first is None else first
    counts = rows.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(at).alias("_at"))
    return counts.orderBy(F.desc("n"), "_at", "value").limit(1).drop("_at")


def main_language(files: DataFrame) -> DataFrame:
    """(value, n): the language of most of the files (path), by their endings; of equal ones that of the first path.  Folders
    that scans leave out don't count; no row if no file has a known language."""
    from ..sources.files import SKIPPED_FOLDERS

    own = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))))
    return most_common(own, texts.language_of(F.col("path")), F.col("path"))


def ordered_text(rows: DataFrame, key: str, order: str, text: Column, boundary: str) -> DataFrame:
    """(key, text): the distinct texts of each key in order, joined; the size of a key's rows is a unit's."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("text"))))
    return rows.groupBy(key).agg(F.array_join(F.array_distinct(F.transform(listed, lambda s: s["text"])), boundary).alias("text"))


def packed(files: DataFrame, group: str, cap: int, overhead: int = 50) -> DataFrame:
    """(group, id, bin): the files (id, path, size) with a bin number from 0 in their group, by ascending
    size, then id; a bin is cut where the next file would take it over the cap.

    A cut depends on all files before it, so a group is gone through in order; its sorted rows
    stream through one task with a counter, and are never held together."""
    need = (F.col("size") + F.length("path") + overhead).cast("bigint")
    rows = files.select(F.col(group), "size", "id", need.alias("need")).repartition(group).sortWithinPartitions(group, "size", "id")

    def run(batches):
        last, used, number = object(), 0, 0
        for batch in batches:
            bins = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != last:
                    last, used, number = key, 0, 0
                if used and used + n > cap:
                    used, number = 0, number + 1
                used += n
                bins.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bins, pa.int32())], names=[group, "id", "bin"])

    kinds = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in (group, "id")]
    return rows.mapInArrow(run, ", ".join([*kinds, "bin int"]))


def running_summary(rows: DataFrame, keys: list[str], order: list[str], done: Column) -> DataFrame:
    """The rows with how many of their key were done up to each."""
    at = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("completed", F.sum(F.coalesce(done, F.lit(False)).cast("int")).over(at))
