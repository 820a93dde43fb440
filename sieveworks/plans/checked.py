"""Registered queries of constraints, predicates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts, verdicts
from ..operators import checks
from .registry import query


@query(
    """SELECT 'no_unit' AS rule, count(*) FILTER (unit_id IS NULL) AS n FROM {dynamic} UNION ALL SELECT 'bad_decision', count(*) FILTER (decision NOT IN ('reproduced', 'not_reproduced', 'inconclusive')) FROM {dynamic}
    UNION ALL SELECT 'bad_run', count(*) FILTER (execution_state NOT IN ('succeeded', 'failed', 'skipped', 'blocked')) FROM {dynamic} UNION ALL SELECT 'sure_without_run', count(*) FILTER (decision <> 'inconclusive' AND execution_state <> 'succeeded') FROM {dynamic}"""
)
def dynamic_record_errors(t):
    return checks.record_errors(t["dynamic"], checks.DYNAMIC_DECISIONS, checks.DYNAMIC_RUNS, ("reproduced", "not_reproduced"))


@query(
    """SELECT 'no_unit' AS rule, count(*) FILTER (unit_id IS NULL) AS n FROM {stage2} UNION ALL SELECT 'bad_decision', count(*) FILTER (decision NOT IN ('confirmed', 'rejected', 'inconclusive')) FROM {stage2}
    UNION ALL SELECT 'bad_run', count(*) FILTER (execution_state NOT IN ('succeeded', 'failed', 'skipped')) FROM {stage2} UNION ALL SELECT 'sure_without_run', count(*) FILTER (decision <> 'inconclusive' AND execution_state <> 'succeeded') FROM {stage2}"""
)
def stage2_record_errors(t):
    return checks.record_errors(t["stage2"], checks.STAGE2_DECISIONS, checks.STAGE2_RUNS, ("confirmed", "rejected"))


@query("SELECT 'no_unit' AS rule, count(*) FILTER (unit_id IS NULL) AS n FROM {stage1} UNION ALL SELECT 'bad_decision', count(*) FILTER (decision NOT IN ('candidate', 'no_finding', 'inconclusive', 'error')) FROM {stage1}")
def stage1_record_errors(t):
    return checks.record_errors(t["stage1"], checks.STAGE1_DECISIONS)


@query(
    """SELECT 'repeated_id' AS rule, (SELECT count(*) FROM (SELECT id FROM {nodes} GROUP BY id HAVING count(*) > 1) x) AS n UNION ALL SELECT 'unknown_caller', count(*) FROM {edges} WHERE caller NOT IN (SELECT id FROM {nodes})
    UNION ALL SELECT 'unknown_callee', count(*) FROM {edges} WHERE callee NOT IN (SELECT id FROM {nodes}) UNION ALL SELECT 'self_edge', count(*) FROM {edges} WHERE caller = callee UNION ALL SELECT 'bad_confidence', count(*) FROM {edges} WHERE confidence NOT IN ('exact', 'low')"""
)
def graph_errors(t):
    return checks.graph_errors(t["nodes"], t["edges"])


@query(
    """SELECT 'no_id' AS rule, count(*) FILTER (id IS NULL OR trim(id) = '') AS n FROM {spans} UNION ALL SELECT 'no_file', count(*) FILTER (file IS NULL OR trim(file) = '') FROM {spans}
    UNION ALL SELECT 'half_range', count(*) FILTER ((lo IS NULL) <> (hi IS NULL)) FROM {spans} UNION ALL SELECT 'inverted', count(*) FILTER (lo > hi) FROM {spans}"""
)
def span_errors(t):
    return checks.span_errors(t["spans"])


@query("SELECT 'bad_scope' AS rule, count(*) FILTER (start % 5 = 0) AS n FROM {hunks} UNION ALL SELECT 'unsafe_path', count(*) FILTER (start % 7 = 0) FROM {hunks} UNION ALL SELECT 'bad_range', count(*) FILTER (start < 1 OR stop < start) FROM {hunks}")
def manifest_errors(t):
    rows = t["hunks"].withColumn("scope", F.when(F.col("start") % 5 == 0, "other").otherwise("callers")).withColumn("file", F.when(F.col("start") % 7 == 0, F.concat(F.lit("../"), "file")).otherwise(F.col("file")))
    return checks.manifest_errors(rows)


@query("SELECT event_id, 'k' AS key FROM {events} WHERE event_id % 5 <> 4 AND event_id % 3 = 0")
def forbidden_keys(t):
    nested = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": ['), "props", F.lit("]}"))).otherwise('{"a": "k"}')
    rows = t["events"].select("event_id", F.when(F.col("event_id") % 5 == 4, "none").otherwise(nested).alias("json"))
    return checks.forbidden_keys(rows, "event_id", F.col("json"), ("k", "verdict"))


@query("SELECT part, CASE k WHEN 0 THEN 'sink,guard' WHEN 1 THEN 'source,guard' WHEN 2 THEN 'source,sink,guard' ELSE '' END AS missing FROM (SELECT p_partkey AS part, p_partkey % 4 AS k FROM {part}) x")
def missing_roles(t):
    k = F.col("p_partkey") % 4
    covered = F.when(k == 0, F.array(F.lit("source"))).when(k == 1, F.array(F.lit("sink"))).when(k == 3, F.array(*map(F.lit, ("guard", "sink", "source"))))
    return t["part"].select(F.col("p_partkey").alias("part"), F.array_join(checks.missing_roles(("source", "sink", "guard"), covered), ",").alias("missing"))


@query(
    """SELECT unit_id, confirmed, CASE WHEN decision <> 'candidate' THEN 'not_a_candidate' WHEN NOT confirmed THEN 'not_confirmed' WHEN k = 2 THEN 'unresolved_evidence' ELSE 'eligible' END AS reason
    FROM (SELECT s1.unit_id, s1.decision, s1.unit_id % 3 AS k, s2.decision = 'confirmed' AND s2.execution_state = 'succeeded' AND s1.unit_id % 3 > 0 AS confirmed FROM {stage1} s1 JOIN {stage2} s2 ON s1.unit_id = s2.unit_id) x"""
)
def dynamic_eligibility(t):
    two = t["stage2"].select("unit_id", F.col("decision").alias("d2"), "execution_state")
    rows = t["stage1"].join(two, "unit_id").withColumn("k", F.col("unit_id") % 3)
    cited = F.when(F.col("k") == 2, F.array(F.lit("e1"), F.lit("e9"))).otherwise(F.array(F.lit("e1")))
    evidence = F.transform(cited, lambda e: F.struct(F.when(F.col("k") > 0, e).otherwise("").alias("evidence_id"), F.lit("code").alias("kind")))
    confirmed = verdicts.is_confirmed(F.col("d2"), F.col("execution_state"), F.col("finding_id"), evidence)
    return rows.select("unit_id", confirmed.alias("confirmed"), verdicts.dynamic_eligibility(F.col("decision"), confirmed, cited, F.array(F.lit("e1"))).alias("reason"))


_CHECKS = ("blocked", "build_ok", "parse_ok", "harness_ok", "marker_ok", "begun", "harness_begun", "same_target", "resolvable", "preconditions", "success_run", "success_hit", "negative_run", "negative_pass")


@query(
    """SELECT event_id, CASE k WHEN 0 THEN 'blocked' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' ELSE 'succeeded' END AS execution_state, CASE k WHEN 3 THEN 'reproduced' WHEN 4 THEN 'not_reproduced' ELSE 'inconclusive' END AS decision,
    CASE k WHEN 0 THEN 'target_unresolvable' WHEN 1 THEN 'build_or_infra_error' WHEN 2 THEN 'harness_json_invalid' WHEN 3 THEN 'success_oracle_hit' WHEN 4 THEN 'success_miss_negative_pass' ELSE 'oracle_incomplete' END AS reason FROM (SELECT event_id, event_id % 6 AS k FROM {events}) x"""
)
def oracle_decisions(t):
    k, yes = F.col("event_id") % 6, F.lit(True)
    tests = dict.fromkeys(_CHECKS, yes) | {"infra_error": F.lit(False), "blocked": k == 0, "build_ok": k != 1, "parse_ok": k != 2, "success_hit": k == 3, "negative_pass": k == 4}
    made = verdicts.oracle_decision(**tests)
    return t["events"].select("event_id", *(made[c].alias(c) for c in ("execution_state", "decision", "reason")))


@query(
    """SELECT event_id, CASE WHEN kind IS NULL THEN event_id % 3 = 0 ELSE event_type IN ('click') END AS rate_limited, CASE WHEN kind IS NULL THEN event_id % 3 < 2 ELSE event_type IN ('click', 'signup') OR event_type = 'error' AND status >= 500 END AS retryable FROM {failures}"""
)
def failure_predicates(t):
    k = F.col("event_id") % 3  # the text that is looked at where there is no kind
    rows = t["failures"].withColumn("text", F.when(k == 0, "a RATE_LIMIT was hit").when(k == 1, "status 503, try again").otherwise("no such file"))
    return rows.select("event_id", verdicts.is_rate_limited(F.col("kind"), F.col("text")).alias("rate_limited"), verdicts.is_retryable(F.col("kind"), F.col("status"), F.col("text")).alias("retryable"))


@query("SELECT event_id, event_id % 5 = 3 AS truncated FROM {answers}")
def truncation_heuristic(t):
    return t["answers"].select("event_id", texts.looks_truncated(F.col("answer")).alias("truncated"))


@query(
    """SELECT part, CASE WHEN part % 3 = 0 THEN part ELSE 0 END AS cwe, part % 3 <> 0 OR part % 2 = 0 AS applies FROM (SELECT cast(p_partkey AS int) AS part FROM {part}) x"""
)
def cwe_filter(t):
    part = F.col("p_partkey").cast("int")
    cwe = texts.cwe_number(F.when(part % 3 == 0, F.concat(F.lit("CWE-"), part.cast("string"))).otherwise("none"))
    return t["part"].select(part.alias("part"), cwe.alias("cwe"), texts.advisory_applies(cwe, F.when(part % 2 == 0, F.array(part)).otherwise(F.array(part + 1))).alias("applies"))


@query("SELECT event_id, CASE WHEN s < 60 THEN concat(s, '.0s') WHEN s < 3600 THEN concat(s // 60, 'm ', lpad(cast(s % 60 AS varchar), 2, '0'), 's') ELSE concat(s // 3600, 'h ', lpad(cast(s % 3600 // 60 AS varchar), 2, '0'), 'm') END AS took, CASE WHEN s % 10 > 0 THEN cast(s AS double) / (s % 10) * (10 - s % 10) END AS eta FROM (SELECT event_id, cast(event_id * 37 % 9000 AS int) AS s FROM {events}) x")
def durations(t):
    s = (F.col("event_id") * 37 % 9000).cast("int")
    return t["events"].select("event_id", texts.duration(s).alias("took"), texts.remaining_seconds(s.cast("double"), s % 10, F.lit(10)).alias("eta"))


@query(
    """SELECT doc_id, CASE WHEN length(text) > 800 THEN concat(left(text, 800), '…') ELSE text END AS preview, CASE WHEN doc_id % 2 = 0 THEN concat('src:', source) ELSE '' END AS file, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS function,
    CASE WHEN doc_id % 3 = 0 THEN concat(source, ' → ', lang) ELSE source END AS vector FROM {documents}"""
)
def text_views(t):
    at = texts.split_id(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("src:"), "source", F.lit(":"), "lang")).otherwise(F.col("source")))
    vector = texts.attack_vector(F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(""), F.lit(None).cast("string"))
    return t["documents"].select("doc_id", texts.preview(F.col("text")).alias("preview"), at["file"].alias("file"), at["function"].alias("function"), vector.alias("vector"))


@query("SELECT id, k NOT IN (1, 2) AS valid, left(ref, 8) AS short FROM (SELECT o_orderkey AS id, o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN '-x' WHEN 2 THEN 'a..b' ELSE 'release/1.2-rc' END AS ref FROM {orders}) x")
def ref_checks(t):
    k = F.col("o_orderkey") % 4
    ref = F.when(k == 0, "main").when(k == 1, "-x").when(k == 2, "a..b").otherwise("release/1.2-rc")
    return t["orders"].select(F.col("o_orderkey").alias("id"), texts.is_valid_ref(ref).alias("valid"), texts.short_sha(ref).alias("short"))
