"""Registered queries of report summaries and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import package_name
from ..operators import graph, matching, records, stages, summaries
from .registry import query


@query("SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM {failures} GROUP BY event_type UNION ALL SELECT 'kind', kind, count(*) FROM {failures} GROUP BY kind")
def counts_by_level_and_rule(t):
    return summaries.counts_by(t["failures"], ["event_type", "kind"])


@query("SELECT cast(sum(n) AS bigint) AS functions, (SELECT count(DISTINCT name) FROM {nodes}) AS names, count(*) AS files, round_even(sum(n) / count(*), 2) AS mean_in_file, max(n) AS most_in_file FROM (SELECT file_path, count(*) AS n FROM {nodes} GROUP BY file_path) x")
def index_statistics(t):
    return summaries.index_statistics(t["nodes"])


@query("SELECT file_path, count(*) AS functions FROM {nodes} GROUP BY file_path")
def functions_per_file(t):
    return t["nodes"].groupBy("file_path").agg(F.count("*").alias("functions"))


@query("SELECT count(*) FILTER (status < 500) AS done, count(*) FILTER (status >= 500) AS failed, cast(coalesce(sum(status) FILTER (status < 500), 0) AS bigint) AS status_sum FROM {failures}")
def work_totals(t):
    return summaries.work_totals(t["failures"], F.col("status") >= 500, {"status_sum": F.col("status").cast("bigint")})


@query("SELECT count(*) AS units, cast(sum(length(text)) AS bigint) AS before, cast(sum(length(text) + 10 * length(source)) AS bigint) AS after, round_even((sum(length(text) + 10 * length(source)) / sum(length(text)) - 1) * 100, 1) AS percent FROM {documents}")
def text_growth(t):
    return summaries.growth(t["documents"], F.length("text"), F.length("text") + 10 * F.length("source"))


@query(
    """SELECT kind, count(*) AS challenged, count(*) FILTER (outcome = 0) AS model_correct, count(*) FILTER (outcome = 1) AS ground_truth_correct, count(*) FILTER (outcome > 1) AS uncertain
    FROM (SELECT CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 'false_positive' WHEN id % 3 = 1 AND id % 2 = 0 THEN 'false_negative' END AS kind, id % 5 AS outcome FROM {words}) x WHERE kind IS NOT NULL GROUP BY kind"""
)
def challenge_summary(t):
    k = F.col("id")
    outcome = F.when(k % 5 == 0, "MODEL_CORRECT").when(k % 5 == 1, "GROUND_TRUTH_CORRECT").when(k % 5 == 2, "UNCERTAIN")
    return summaries.challenge_summary(t["words"], k % 2 == 0, F.when(k % 3 == 0, "VULNERABLE").when(k % 3 == 1, "SAFE"), outcome)


@query("SELECT 'level' AS dimension, event_type AS value, count(*) AS n FROM {events} GROUP BY event_type UNION ALL SELECT 'rule', concat('r', user_id % 7), count(*) FROM {events} GROUP BY 2 UNION ALL SELECT 'files', 'distinct', count(DISTINCT user_id) FROM {events}")
def sarif_summary(t):
    return summaries.sarif_summary(t["events"].select(F.col("event_type").alias("level"), F.concat(F.lit("r"), F.col("user_id") % 7).alias("rule"), F.col("user_id").alias("file")))


@query("SELECT event_type AS step, event_id, value AS seconds FROM {events} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_step_reports(t):
    return summaries.last_by_step(t["events"].select(F.col("event_type").alias("step"), "ts", "event_id", F.col("value").alias("seconds")), "step", ["ts", "event_id"], ["event_id", "seconds"])


@query("SELECT lang, count(*) AS n FROM {documents} GROUP BY lang")
def language_distribution(t):
    return t["documents"].groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("SELECT count(*) AS total, count(*) FILTER (n_chars >= 500) AS kept, round_even((1 - count(*) FILTER (n_chars >= 500) / count(*)) * 100, 1) AS percent FROM {documents}")
def reduction_stats(t):
    return stages.reduction(t["documents"], t["documents"].where("n_chars >= 500"))


@query("SELECT unit_id, CASE WHEN unit_id % 5 = 0 THEN 'TP' WHEN unit_id % 7 = 0 THEN 'TN' ELSE 'UNKNOWN' END AS truth FROM {stage1}")
def ground_truth_lookup(t):
    units = t["stage1"].select("unit_id")
    return summaries.with_ground_truth(units, units.where("unit_id % 5 = 0"), units.where("unit_id % 7 = 0"), "unit_id")


@query(
    """WITH r AS (SELECT file_path AS file, name, concat('/r', id) AS route, id AS pos FROM {nodes} WHERE id % 4 = 0), e AS (SELECT file, name, arg_max(route, pos) AS route FROM r GROUP BY file, name), l AS (SELECT name, arg_max(route, pos) AS route FROM r GROUP BY name)
    SELECT n.id, coalesce(e.route, l.route) AS route, CASE WHEN coalesce(e.route, l.route) IS NULL THEN 'function' ELSE 'route_handler' END AS unit_type FROM {nodes} n LEFT JOIN e ON e.file = n.file_path AND e.name = n.name LEFT JOIN l ON l.name = n.name"""
)
def route_lookup(t):
    units = t["nodes"].select("id", F.col("file_path").alias("file"), "name")
    routes = units.where("id % 4 = 0").select("file", "name", F.concat(F.lit("/r"), "id").alias("route"), F.col("id").alias("pos"))
    return summaries.routed(units, routes).select("id", "route", "unit_type")


@query("SELECT ecosystem, concat('pkg-', part - part % 10) AS package, arg_max(version, part) AS version FROM {packages} GROUP BY ALL")
def packages_last_wins(t):
    return summaries.last_packages(t["packages"], package_name(F.col("name")), "part")


@query("SELECT DISTINCT user_id FROM {events} WHERE event_type <> 'error'")
def completed_ids(t):
    return summaries.completed_ids(t["events"], "user_id", F.col("event_type") == "error")


@query(
    """SELECT i.id, coalesce((SELECT string_agg(DISTINCT caller, ',' ORDER BY caller) FROM {edges} e WHERE e.callee = i.id), '') AS callers, coalesce((SELECT string_agg(DISTINCT callee, ',' ORDER BY callee) FROM {edges} e WHERE e.caller = i.id), '') AS callees FROM {roots} i"""
)
def graph_neighbourhoods(t):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return summaries.neighbourhoods(t["roots"], t["edges"]).select("id", joined("callers"), joined("callees"))


@query("SELECT coalesce(confidence, 'exact') = 'exact' AS exact, count(*) AS n FROM {edges} WHERE caller <> callee AND caller IN (SELECT id FROM {nodes}) AND callee IN (SELECT id FROM {nodes}) GROUP BY 1")
def edge_confidence_partition(t):
    return graph.clean_edges(t["edges"], t["nodes"]).groupBy("exact").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT caller, callee, 'exact' AS confidence FROM {edges}")
def adjacency_to_edges(t):
    return graph.to_edges(graph.adjacency(t["edges"]))


@query("SELECT id AS finding_id, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (cast(substr(evidence_id, 2) AS int) % 3 <> 0), '') AS resolved, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (cast(substr(evidence_id, 2) AS int) % 3 = 0), '') AS missing FROM {cited} GROUP BY id")
def evidence_resolution(t):
    findings = t["cited"].groupBy(F.col("id").alias("finding_id")).agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    index = t["cited"].select("evidence_id").distinct().where("cast(substr(evidence_id, 2) as int) % 3 <> 0")
    return matching.resolved_evidence(findings, index).select("finding_id", F.array_join("resolved", ",").alias("resolved"), F.array_join("missing", ",").alias("missing"))


@query("SELECT event_id, user_id, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS completed FROM {events}")
def running_summary(t):
    done = records.running_summary(t["events"], ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") != "error")
    return done.select("event_id", "user_id", "completed")


@query("SELECT decision AS bucket, count(*) AS n, min(unit_id) AS first FROM {stage1} GROUP BY decision UNION ALL SELECT 'all', count(*), min(unit_id) FROM {stage1}")
def finding_buckets(t):
    one = t["stage1"].groupBy("decision").agg(F.count("*").alias("n"), F.min("unit_id").alias("first"))
    return one.withColumnRenamed("decision", "bucket").unionAll(one.agg(F.lit("all").alias("bucket"), F.sum("n").alias("n"), F.min("first").alias("first")))


@query("SELECT id FROM {nodes} WHERE id IN (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_quantity >= 45)")
def flagged_units(t):
    flagged = t["lineitem"].where("l_quantity >= 45").select(F.col("l_partkey").alias("id"))
    return t["nodes"].select("id").join(flagged, "id", "left_semi")


@query("SELECT CASE WHEN decision = 'candidate' THEN 4 WHEN decision = 'inconclusive' THEN 6 ELSE 7 END AS rank, decision AS final_state, count(*) AS n FROM {stage1} WHERE decision <> 'no_finding' GROUP BY decision")
def state_series(t):
    counted = t["stage1"].where("decision <> 'no_finding'").select(F.col("decision").alias("final_state"))
    return summaries.state_series(stages.count_by_state(counted))
