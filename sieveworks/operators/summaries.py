"""Counts and totals for reports: each is one aggregation, with partial sums before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): how often each value of each column occurs; null counts as a value.

    The rows are counted by all columns together first, so that only combinations are unfolded."""
    small = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns)))
    return small.select(pairs.alias("p"), "n").groupBy("p.dimension", "p.value").agg(F.sum("n").alias("n"))


def index_statistics(nodes: DataFrame) -> DataFrame:
    """One row: functions, distinct names, files, and the mean and most functions of a file."""
    files = nodes.groupBy("file_path").agg(F.count("*").alias("n"))
    per_file = files.agg(F.sum("n").alias("functions"), F.count("*").alias("files"), F.max("n").alias("most_in_file"))
    names = nodes.agg(F.count_distinct("name").alias("names"))
    row = per_file.crossJoin(names)  # two single rows
    return row.select(F.coalesce("functions", F.lit(0)).alias("functions"), "names", "files", F.bround(F.col("functions") / F.col("files"), 2).alias("mean_in_file"), "most_in_file")


def work_totals(rows: DataFrame, failed: Column, sums: dict[str, Column]) -> DataFrame:
    """One row: rows done, rows failed, and sums over those that did not fail; 0 where there are none."""
    bad = F.coalesce(failed, F.lit(False))
    return rows.agg(F.count_if(~bad).alias("done"), F.count_if(bad).alias("failed"), *(F.coalesce(F.sum(F.when(~bad, c)), F.lit(0)).alias(k) for k, c in sums.items()))


def growth(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: units, characters before and after, and by how many percent they grew."""
    row = rows.agg(F.count("*").alias("units"), F.coalesce(F.sum(before), F.lit(0)).alias("before"), F.coalesce(F.sum(after), F.lit(0)).alias("after"))
    return row.withColumn("percent", F.when(F.col("before") > 0, F.bround((F.col("after") / F.col("before") - 1) * 100, 1)).otherwise(0.0))


def challenge_summary(rows: DataFrame, vulnerable: Column, verdict: Column, arbitration: Column) -> DataFrame:
    """(kind, challenged, model_correct, ground_truth_correct, uncertain) of false positives and false negatives.

    A VULNERABLE verdict on what the truth calls safe is the one, a SAFE one on what it calls vulnerable the other;
    rows without a truth aren't challenged, and any other arbitration than the two verdicts is uncertain."""
    said = F.coalesce(arbitration, F.lit(""))
    kinds = {"false_positive": (verdict == "VULNERABLE") & ~vulnerable, "false_negative": (verdict == "SAFE") & vulnerable}
    outcomes = {"challenged": F.lit(True), "model_correct": said == "MODEL_CORRECT", "ground_truth_correct": said == "GROUND_TRUTH_CORRECT", "uncertain": ~said.isin("MODEL_CORRECT", "GROUND_TRUTH_CORRECT")}
    one = rows.agg(*(F.count_if(F.coalesce(test & outcome, F.lit(False))).alias(f"{k}_{o}") for k, test in kinds.items() for o, outcome in outcomes.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), *(F.col(f"{k}_{o}").alias(o) for o in outcomes)) for k in kinds))).alias("r")).select("r.*")


def sarif_summary(findings: DataFrame) -> DataFrame:
    """(dimension, value, n): findings by level and by rule, and the number of their files."""
    files = findings.agg(F.lit("files").alias("dimension"), F.lit("distinct").alias("value"), F.count_distinct("file").alias("n"))
    return counts_by(findings, ["level", "rule"]).unionByName(files)


def last_by_step(reports: DataFrame, step: str, order: list[str], values: list[str]) -> DataFrame:
    """The last report of each step."""
    return reports.groupBy(step).agg(F.max(F.struct(*order, *(v for v in values if v not in order))).alias("_r")).select(step, *(F.col(f"_r.{v}").alias(v) for v in values))


def state_series(counts: DataFrame) -> DataFrame:
    """The states that occur, in report order, with their rank: the series of a chart."""
    return counts.where("n > 0").select(verdicts.state_rank(F.col("final_state")).cast("int").alias("rank"), "final_state", "n").orderBy("rank")


def with_ground_truth(rows: DataFrame, positives: DataFrame, negatives: DataFrame, key: str) -> DataFrame:
    """The rows with truth: TP where the positives have the key, else TN where the negatives do, else UNKNOWN."""
    listed = positives.select(key, F.lit(0).alias("_t")).unionAll(negatives.select(key, F.lit(1).alias("_t"))).groupBy(key).agg(F.min("_t").alias("_t"))
    return rows.join(listed, key, "left").withColumn("truth", F.when(F.col("_t") == 0, "TP").when(F.col("_t") == 1, "TN").otherwise("UNKNOWN")).drop("_t")


def routed(units: DataFrame, routes: DataFrame) -> DataFrame:
    """Units (file, name) with the route of their handler, by file and name, else by name alone; the last route (pos) counts."""
    exact = routes.groupBy("file", "name").agg(F.max_by("route", "pos").alias("_exact"))
    loose = routes.groupBy("name").agg(F.max_by("route", "pos").alias("_loose"))
    out = units.join(exact, ["file", "name"], "left").join(loose, "name", "left").withColumn("route", F.coalesce("_exact", "_loose"))
    return out.withColumn("unit_type", F.when(F.col("route").isNotNull(), "route_handler").otherwise("function")).drop("_exact", "_loose")


def last_packages(packages: DataFrame, name: Column, order: str) -> DataFrame:
    """One version of each package, the last; names are equal after folding."""
    return packages.groupBy("ecosystem", name.alias("package")).agg(F.max_by("version", order).alias("version"))


def completed_ids(records: DataFrame, key: str, failed: Column) -> DataFrame:
    """Keys with a record that did not fail: what a resumed run leaves out."""
    return records.where(~F.coalesce(failed, F.lit(False)) & F.col(key).isNotNull()).select(key).distinct()


def neighbourhoods(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees): sorted distinct neighbours of the wanted nodes; one without edges has none."""
    ends = edges.select(F.col("caller").alias("id"), F.lit("callee").alias("side"), F.col("callee").alias("other")).unionAll(edges.select(F.col("callee").alias("id"), F.lit("caller").alias("side"), F.col("caller").alias("other")))
    near = ends.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(*(F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("other")))).alias(f"{s}s") for s in ("caller", "callee")))
    return ids.select("id").distinct().join(near, "id", "left").select("id", *(F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("callers", "callees")))
