"""Constraints as queries: each gives (rule, n), or the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts

# What a stage's record may say.
STAGE1_DECISIONS = ("candidate", "no_finding", "inconclusive", "error")
STAGE2_DECISIONS = ("confirmed", "rejected", "inconclusive")
DYNAMIC_DECISIONS = ("reproduced", "not_reproduced", "inconclusive")
STAGE2_RUNS = ("succeeded", "failed", "skipped")
DYNAMIC_RUNS = ("succeeded", "failed", "skipped", "blocked")
DIFF_SCOPES = ("changed_files", "changed_functions", "callers")


def broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule, all in one pass; a test that is null is not broken."""
    one = rows.agg(*(F.count_if(F.coalesce(test, F.lit(False))).alias(k) for k, test in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules))).alias("r")).select("r.rule", "r.n")


def record_errors(records: DataFrame, decisions: tuple[str, ...], runs: tuple[str, ...] = (), sure: tuple[str, ...] = ()) -> DataFrame:
    """Rules of a stage's records; `sure` decisions need a run that succeeded."""
    d = F.col("decision")
    rules = {"no_unit": F.col("unit_id").isNull(), "bad_decision": ~F.coalesce(d.isin(*decisions), F.lit(False))}
    if runs:
        run = F.col("execution_state")
        rules |= {"bad_run": ~F.coalesce(run.isin(*runs), F.lit(False)), "sure_without_run": d.isin(*sure) & (F.coalesce(run, F.lit("")) != "succeeded")}
    return broken(records, rules)


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): repeated node ids, edges with an unknown end, self edges, unknown confidences."""
    twice = nodes.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_id").alias("rule"), "n")
    marks = nodes.select("id").distinct()
    for end in ("caller", "callee"):
        edges = edges.join(marks.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    rules = {"unknown_caller": F.col("_caller").isNull(), "unknown_callee": F.col("_callee").isNull(), "self_edge": F.col("caller") == F.col("callee"), "bad_confidence": ~F.lower("confidence").isin("exact", "low", "")}
    return twice.unionByName(broken(edges, rules))


def span_errors(units: DataFrame) -> DataFrame:
    """(rule, n) of units (id, file, lo, hi): no id or file, one line number without the other, an inverted range."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return broken(units, {"no_id": blank("id"), "no_file": blank("file"), "half_range": F.col("lo").isNull() != F.col("hi").isNull(), "inverted": F.col("lo") > F.col("hi")})


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """(rule, n) of (scope, file, start, stop): unknown scopes, unsafe paths, ranges that are empty or begin before line 1."""
    return broken(manifest, {"bad_scope": ~F.coalesce(F.col("scope").isin(*DIFF_SCOPES), F.lit(False)), "unsafe_path": texts.is_unsafe_path(F.col("file")), "bad_range": (F.col("start") < 1) | (F.col("stop") < F.col("start"))})


def forbidden_keys(rows: DataFrame, id_: str, json: Column, keys: tuple[str, ...]) -> DataFrame:
    """(id, key): forbidden keys at any depth of a JSON text; text that is no JSON has none."""
    found = F.array_distinct(F.regexp_extract_all(json, F.lit(f'(?<!\\\\)"({"|".join(keys)})"\\s*:'), F.lit(1)))
    return rows.where(F.json_object_keys(json).isNotNull()).select(id_, F.explode(found).alias("key"))


def missing_roles(required: tuple[str, ...], covered: Column) -> Column:
    """The required roles that no evidence covers, in their order."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(covered, F.array().cast("array<string>")))
