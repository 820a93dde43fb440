"""The registered queries: an operator over derived tables, and SQL of its own for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, texts, verdicts
from ..operators import graph, matching, records, stages
from ..tables import stored
from . import called, checked, reported, summed  # noqa: F401  they register theirs
from .derived import Tables
from .registry import ORACLES, QUERIES, query
from .shown import FOUND_ORDER as _ORDER
from .shown import FOUND_STATES as _STATES
from .shown import found as _found
from .shown import merged_findings as _findings


def _joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_METRICS = """SELECT a.*, b.*, c.* FROM (SELECT count(*) FILTER (decision = 'candidate') AS stage1_candidates, count(*) FILTER (decision = 'no_finding') AS stage1_no_finding, count(*) FILTER (decision = 'inconclusive') AS stage1_inconclusive, count(*) FILTER (decision = 'error') AS stage1_errors FROM {stage1}) a,
    (SELECT count(*) FILTER (execution_state = 'failed') AS stage2_failed, count(*) FILTER (decision = 'confirmed' AND execution_state = 'succeeded') AS stage2_confirmed, count(*) FILTER (decision = 'rejected' AND execution_state = 'succeeded') AS stage2_rejected, count(*) FILTER (decision = 'inconclusive' AND execution_state <> 'failed') AS stage2_inconclusive FROM {stage2}) b,
    (SELECT count(*) FILTER (execution_state = 'failed') AS dynamic_failed, count(*) FILTER (execution_state = 'blocked') AS dynamic_blocked, count(*) FILTER (execution_state = 'skipped') AS dynamic_skipped, count(*) FILTER (decision = 'reproduced' AND execution_state = 'succeeded') AS dynamic_reproduced, count(*) FILTER (decision = 'not_reproduced' AND execution_state = 'succeeded') AS dynamic_not_reproduced, count(*) FILTER (decision = 'inconclusive' AND execution_state NOT IN ('failed', 'blocked', 'skipped')) AS dynamic_inconclusive FROM {dynamic}) c"""


@query(f"SELECT s.final_state, count(x.unit_id) AS n FROM (VALUES ('reproduced'), ('confirmed_not_dynamically_tested'), ('confirmed_not_reproduced'), ('candidate'), ('rejected'), ('inconclusive'), ('error')) s(final_state) LEFT JOIN ({_STATES}) x ON s.final_state = x.final_state GROUP BY s.final_state")
def final_state_rollup(t):
    return stages.count_by_state(_findings(t, cited=False))


@query(_METRICS)
def stage_metrics(t):
    return stages.metrics(t["stage1"], t["stage2"], t["dynamic"])


@query(
    """SELECT 'stage2' AS stage, count(*) FILTER (execution_state = 'skipped') AS skipped, count(*) FILTER (execution_state <> 'skipped') AS attempted, count(*) FILTER (execution_state = 'succeeded') AS succeeded, count(*) FILTER (execution_state = 'failed') AS failed, count(*) FILTER (execution_state = 'blocked') AS blocked,
    count(*) FILTER (decision = 'confirmed') AS positive, count(*) FILTER (decision = 'rejected') AS negative, count(*) FILTER (decision = 'inconclusive') AS inconclusive FROM {stage2}
    UNION ALL SELECT 'dynamic', count(*) FILTER (execution_state = 'skipped'), count(*) FILTER (execution_state <> 'skipped'), count(*) FILTER (execution_state = 'succeeded'), count(*) FILTER (execution_state = 'failed'), count(*) FILTER (execution_state = 'blocked'),
    count(*) FILTER (decision = 'reproduced' AND execution_state = 'succeeded'), count(*) FILTER (decision = 'not_reproduced' AND execution_state = 'succeeded'), count(*) FILTER (execution_state = 'blocked' OR execution_state = 'succeeded' AND decision = 'inconclusive') FROM {dynamic}"""
)
def stage_tallies(t):
    both = [(n, stages.tally(t[n], a, b).withColumnsRenamed({a: "positive", b: "negative"})) for n, a, b in (("stage2", "confirmed", "rejected"), ("dynamic", "reproduced", "not_reproduced"))]
    one, two = (df.withColumn("stage", F.lit(n)) for n, df in both)
    return one.unionByName(two)


@query(
    f"""SELECT level, met FROM (SELECT * FROM ({_METRICS}) m, (SELECT count(*) FILTER (final_state = 'candidate') AS c, count(*) FILTER (final_state LIKE 'confirmed%' OR final_state = 'reproduced') AS s, count(*) FILTER (final_state = 'reproduced') AS r, count(*) FILTER (final_state = 'error') AS e FROM ({_STATES}) x) f) z,
    LATERAL (VALUES ('candidate', stage1_candidates + c > 0), ('confirmed', stage2_confirmed + s > 0), ('reproduced', dynamic_reproduced + r > 0), ('error', stage1_errors + stage2_failed + dynamic_failed + e > 0)) v(level, met)"""
)
def threshold_gate(t):
    return stages.gates(stages.metrics(t["stage1"], t["stage2"], t["dynamic"]), _findings(t, cited=False))


_IDS = "array_to_string(list_filter(cited, lambda x, i: list_position(cited, x) = i), ';')"


@query(
    f"""SELECT {_ORDER} AS rank, section, pos, final_state, CASE final_state WHEN 'reproduced' THEN 'Reproduced' WHEN 'confirmed_not_dynamically_tested' THEN 'Confirmed, not dynamically tested' WHEN 'confirmed_not_reproduced' THEN 'Confirmed, not reproduced' WHEN 'candidate' THEN 'Candidate' WHEN 'rejected' THEN 'Rejected' WHEN 'inconclusive' THEN 'Inconclusive' ELSE 'Error' END AS section_label,
    finding_id, unit_id, file, function, coalesce(d1, '') AS stage1_decision, coalesce(d2, '') AS stage2_decision, coalesce(e2, '') AS stage2_execution_state, coalesce(dd, '') AS dynamic_decision, coalesce(ed, '') AS dynamic_execution_state, {_IDS} AS evidence_ids FROM ({_STATES}) x"""
)
def csv_rows(t):
    return stages.csv_rows(_findings(t))


@query(f"SELECT unit_id, final_state, row_number() OVER (ORDER BY {_ORDER}, section, pos, unit_id) AS number, row_number() OVER (PARTITION BY final_state ORDER BY section, pos, unit_id) AS in_section FROM ({_STATES}) x")
def section_numbers(t):
    return stages.section_numbers(_findings(t, cited=False)).select("unit_id", "final_state", "number", "in_section")


@query(
    f"""SELECT CASE w WHEN 1 THEN 'reproduced' WHEN 2 THEN 'confirmed_not_dynamically_tested' WHEN 3 THEN 'confirmed_not_reproduced' WHEN 4 THEN 'candidate' WHEN 5 THEN 'rejected' WHEN 6 THEN 'inconclusive' ELSE 'error' END AS final_state, count(*) AS files
    FROM (SELECT file, min({_ORDER}) AS w FROM ({_STATES}) x GROUP BY file) y GROUP BY w"""
)
def state_per_file_worst(t):
    return stages.worst_state_per_file(_findings(t, cited=False), "file")


def _all_status(t):
    # every unit that the graph or the first stage knows is a node
    units = t["nodes"].select("id").unionAll(t["stage1"].select("unit_id"))
    return graph.reachability(units, t["edges"], t["roots"])


_STEPS = "SELECT caller, callee, coalesce(confidence, 'exact') = 'exact' AS exact FROM {edges} WHERE caller <> callee"
_COUNTED = f"""WITH RECURSIVE steps AS ({_STEPS}), known AS (SELECT id FROM {{nodes}} UNION SELECT unit_id FROM {{stage1}}), r(id) AS (SELECT id FROM {{roots}} UNION SELECT s.callee FROM r JOIN steps s ON s.caller = r.id WHERE s.exact),
    u(id) AS (SELECT s.callee FROM r JOIN steps s ON s.caller = r.id UNION SELECT s.callee FROM u JOIN steps s ON s.caller = u.id),
    n AS (SELECT count(*) AS total_units, count(*) FILTER (id IN (SELECT id FROM r)) AS reachable, count(*) FILTER (id NOT IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM u)) AS unreachable, count(*) FILTER (id NOT IN (SELECT id FROM r) AND id IN (SELECT id FROM u)) AS unknown_reachability FROM known)
    SELECT n.*, m.* FROM n, ({_METRICS}) m"""


@query(_COUNTED)
def analysis_metrics(t):
    return stages.full_metrics(stages.reach_counts(_all_status(t)), t["stage1"], t["stage2"], t["dynamic"])


@query(
    _COUNTED.replace("SELECT n.*, m.* FROM n,", "SELECT rule, ok FROM (SELECT n.*, m.* FROM n,")
    + """) z, LATERAL (VALUES ('reachability_sum', reachable + unreachable + unknown_reachability = total_units), ('stage1_sum', stage1_candidates + stage1_no_finding + stage1_inconclusive + stage1_errors <= total_units),
    ('not_negative', least(total_units, reachable, unreachable, unknown_reachability, stage1_candidates, stage2_failed, stage2_confirmed, dynamic_failed, dynamic_blocked) >= 0)) v(rule, ok)"""
)
def metric_checks(t):
    return stages.metric_errors(stages.full_metrics(stages.reach_counts(_all_status(t)), t["stage1"], t["stage2"], t["dynamic"]))


_BROKEN = f"""SELECT unit_id, unnest(list_filter([CASE WHEN final_state = 'reproduced' AND NOT (coalesce(dd, '') = 'reproduced' AND coalesce(ed, '') = 'succeeded') THEN 'reproduced_without_run' END, CASE WHEN final_state = 'reproduced' AND coalesce(d2, '') <> 'confirmed' THEN 'reproduced_without_confirmation' END,
    CASE WHEN (final_state = 'reproduced' OR final_state LIKE 'confirmed%') AND d2 = 'rejected' THEN 'rejected_but_confirmed' END, CASE WHEN final_state = 'confirmed_not_reproduced' AND dd IS DISTINCT FROM 'not_reproduced' THEN 'not_reproduced_without_run' END], lambda x: x IS NOT NULL)) AS rule FROM ({_STATES}) x"""


@query(_BROKEN)
def state_violations(t):
    return stages.state_errors(_findings(t))


@query(
    f"""WITH x AS ({_STATES}), metrics AS ({_METRICS.replace("{stage1}", "{found1}").replace("{stage2}", "{found2}").replace("{dynamic}", "{found3}")}), broken AS ({_BROKEN} UNION ALL SELECT unit_id, 'unresolved_evidence' FROM (SELECT DISTINCT unit_id, unnest(cited) AS e FROM x) c WHERE e IN ('e5', 'e9'))
    SELECT rule, count(*) AS n FROM broken GROUP BY rule UNION ALL SELECT 'bucket_rejected', 1 UNION ALL SELECT 'bucket_inconclusive', 1 WHERE (SELECT count(*) FROM x WHERE final_state = 'inconclusive') > 0 UNION ALL SELECT 'bucket_error', 1
    UNION ALL SELECT 'reproduced_differs', 1 FROM metrics WHERE dynamic_reproduced <> (SELECT count(*) FROM x WHERE final_state = 'reproduced')
    UNION ALL SELECT 'not_reproduced_exceeds', 1 FROM metrics WHERE dynamic_not_reproduced > 0 AND dynamic_not_reproduced < (SELECT count(*) FROM x WHERE final_state = 'confirmed_not_reproduced') UNION ALL SELECT 'summary_sum', 1"""
)
def artifact_violations(t):
    """An artifact whose lists lack rejected, inconclusive and error findings, and whose summary doesn't add up."""
    found = stored(_findings(t).select("unit_id", "final_state", "s1", "s2", "dyn", "dyn_run", "evidence_ids"))  # as an artifact's findings are a table: its lists are counted from it too
    reach = t["stage1"].agg(F.count("*").alias("total_units")).select((F.col("total_units") * 3).alias("total_units"), (F.col("total_units") * 3).alias("reachable"), F.lit(0).alias("unreachable"), F.lit(0).alias("unknown_reachability"))
    buckets = found.where("final_state = 'candidate'").agg(F.lit("candidate").alias("state"), F.count("*").alias("n"))
    known = t.spark.range(11).select(F.concat(F.lit("e"), "id").alias("evidence_id")).where("evidence_id not in ('e5', 'e9')")
    summary = reach.withColumn("unreachable", F.lit(1))
    return stages.artifact_errors(found, stages.full_metrics(reach, _found(t, "found1"), _found(t, "found2"), _found(t, "found3")), buckets, summary, known)


_REACH = f"""WITH RECURSIVE steps AS ({_STEPS}), r(id) AS (SELECT id FROM {{roots}} UNION SELECT s.callee FROM r JOIN steps s ON s.caller = r.id WHERE s.exact),
    u(id) AS (SELECT s.callee FROM r JOIN steps s ON s.caller = r.id UNION SELECT s.callee FROM u JOIN steps s ON s.caller = u.id)
    SELECT n.id, CASE WHEN n.id IN (SELECT id FROM r) THEN 'reachable' WHEN n.id IN (SELECT id FROM u) THEN 'unknown' ELSE 'unreachable' END AS status FROM {{nodes}} n"""


@query(_REACH)
def reachability_fixpoint(t):
    return graph.reachability(t["nodes"], t["edges"], t["roots"])


# the oracle takes the candidates from each unresolved call's own file, or else its folder
_CANDIDATES = """SELECT caller, callee_name, id AS candidate FROM (SELECT u.caller, u.callee_name, n.id, n.file_path = c.file_path AS own, bool_or(n.file_path = c.file_path) OVER (PARTITION BY u.caller, u.callee_name) AS any_own
    FROM (SELECT DISTINCT caller, callee_name FROM {unresolved} WHERE callee_name NOT LIKE '<%') u JOIN {nodes} c ON c.id = u.caller JOIN {nodes} n ON n.name = split_part(u.callee_name, '.', 2) AND n.folder = c.folder AND n.id <> u.caller) q WHERE own OR NOT any_own"""


def _scoped(t):
    return t["nodes"].withColumn("package", F.lit(None).cast("string")).withColumn("language", F.lit("python"))


def _open(t):
    """The unresolved calls without lists, and what their names may mean."""
    open_, named = graph.scoped_names(t["unresolved"], _scoped(t))
    return open_.withColumn("candidates", F.array().cast("array<bigint>")), named


@query(
    f"""WITH RECURSIVE steps AS ({_STEPS}), cand AS ({_CANDIDATES}), r(id) AS (SELECT id FROM {{roots}} UNION SELECT s.callee FROM r JOIN steps s ON s.caller = r.id WHERE s.exact),
    wide AS (SELECT caller, callee FROM steps UNION SELECT caller, candidate FROM cand),
    u(id) AS (SELECT w.callee FROM r JOIN wide w ON w.caller = r.id UNION SELECT w.callee FROM u JOIN wide w ON w.caller = u.id)
    SELECT n.id, CASE WHEN n.id IN (SELECT id FROM r) THEN 'reachable' WHEN n.id IN (SELECT id FROM u) THEN 'unknown' ELSE 'unreachable' END AS status FROM {{nodes}} n"""
)
def reachability_with_candidates(t):
    open_, named = _open(t)
    return graph.reachability(t["nodes"], t["edges"], t["roots"], open_.where("open_name is not null"), named)


@query(
    f"""WITH RECURSIVE steps AS ({_STEPS}), cand AS ({_CANDIDATES}), r(id) AS (SELECT id FROM {{roots}} UNION SELECT s.callee FROM r JOIN steps s ON s.caller = r.id WHERE s.exact),
    wide AS (SELECT caller, callee FROM steps UNION SELECT caller, candidate FROM cand), u(id) AS (SELECT w.callee FROM r JOIN wide w ON w.caller = r.id UNION SELECT w.callee FROM u JOIN wide w ON w.caller = u.id),
    open AS (SELECT count(*) AS n FROM {{unresolved}} x WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.caller = x.caller AND c.callee_name = x.callee_name) AND (x.caller IN (SELECT id FROM r) OR x.caller IN (SELECT id FROM u)))
    SELECT n.id, CASE WHEN n.id IN (SELECT id FROM r) THEN 'reachable' WHEN (SELECT n FROM open) > 0 OR n.id IN (SELECT id FROM u) THEN 'unknown' ELSE 'unreachable' END AS status FROM {{nodes}} n"""
)
def reachability_with_unresolved(t):
    return graph.reachability(t["nodes"], t["edges"], t["roots"], *_open(t))


@query(_REACH.replace("SELECT n.id, CASE", "SELECT count(*) AS total, count(*) FILTER (status <> 'unreachable') AS kept, round_even((1 - count(*) FILTER (status <> 'unreachable') / count(*)) * 100, 1) AS percent FROM (SELECT n.id, CASE") + ") z")
def reachability_filter(t):
    status = graph.reachability(t["nodes"], t["edges"], t["roots"])
    return stages.reduction(t["nodes"], graph.kept_units(t["nodes"], status))


def _bfs_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE w(seed, id, depth) AS (SELECT id, id, 0 FROM {{roots}} UNION SELECT w.seed, e.{b}, w.depth + 1 FROM w JOIN {{edges}} e ON e.{a} = w.id WHERE w.depth < 3)
    SELECT seed, id, cast(min(depth) AS int) AS depth FROM w WHERE seed <> id GROUP BY seed, id"""


@query(_bfs_sql("caller", "callee"))
def bfs_callees_d3(t):
    return graph.within(t["roots"], t["edges"], 3)


@query(_bfs_sql("callee", "caller"))
def bfs_callers_d3(t):
    return graph.within(t["roots"], t["edges"], 3, reverse=True)


@query("SELECT caller AS id, array_to_string(list_sort(list(DISTINCT callee)), ',') AS neighbours FROM {edges} GROUP BY caller")
def adjacency(t):
    return graph.adjacency(t["edges"]).withColumn("neighbours", _joined("neighbours"))


@query("SELECT callee AS id, array_to_string(list_sort(list(DISTINCT caller)), ',') AS neighbours FROM {edges} GROUP BY callee")
def reverse_adjacency(t):
    return graph.adjacency(t["edges"], reverse=True).withColumn("neighbours", _joined("neighbours"))


@query(
    """SELECT count(*) AS nodes, cast(sum(o) AS bigint) AS edges, round_even(sum(o) / count(*), 2) AS mean_out, round_even(sum(i) / count(*), 2) AS mean_in, max(o) AS max_out, max(i) AS max_in, count(*) FILTER (o = 0 AND i = 0) AS isolated FROM
    (SELECT n.id, (SELECT count(*) FROM (SELECT DISTINCT caller, callee FROM {edges}) e WHERE e.caller = n.id) AS o, (SELECT count(*) FROM (SELECT DISTINCT caller, callee FROM {edges}) e WHERE e.callee = n.id) AS i FROM {nodes} n) d"""
)
def degree_stats(t):
    return graph.degree_stats(t["nodes"], t["edges"])


@query("SELECT id, CASE WHEN kind = 'module_level' THEN 'module_init' ELSE 'exported_symbol' END AS kind FROM {nodes} WHERE kind = 'module_level' OR is_exported OR (visibility = 'public' AND kind <> 'lambda')")
def structural_roots(t):
    none = {c: F.lit(None).cast("string") for c in ("code", "package")}
    return graph.structural_roots(t["nodes"].withColumns(none | {"language": F.lit("python")}))


@query(f"SELECT u.caller, u.callee_name, u.reason, coalesce(c.candidates, '') AS candidates FROM {{unresolved}} u LEFT JOIN (SELECT caller, callee_name, array_to_string(list_sort(list(DISTINCT candidate)), ',') AS candidates FROM ({_CANDIDATES}) k GROUP BY caller, callee_name) c ON c.caller = u.caller AND c.callee_name = u.callee_name")
def unresolved_candidates(t):
    return graph.scoped_candidates(t["unresolved"], _scoped(t)).withColumn("candidates", _joined("candidates")).select("caller", "callee_name", "reason", "candidates")


@query("SELECT reason, count(*) AS n FROM {unresolved} GROUP BY reason")
def unresolved_by_reason(t):
    return t["unresolved"].groupBy("reason").agg(F.count("*").alias("n"))


_MEETS = "SELECT DISTINCT s.id FROM {spans} s JOIN {hunks} h ON s.file = h.file WHERE s.lo <= h.stop AND s.hi >= h.start"


@query(f"SELECT DISTINCT s.id, s.file, s.lo, s.hi FROM {{spans}} s WHERE s.id IN ({_MEETS})")
def interval_overlap_semijoin(t):
    return matching.overlapping(t["spans"].distinct(), t["hunks"].withColumnRenamed("stop", "end"))


def _manifest(t, hunks="hunks"):
    """The hunks, and changed files without any."""
    bare = t["part"].select(F.concat(F.lit("./file"), F.col("p_partkey") % 1000).alias("file"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")).distinct()
    return t[hunks].withColumnRenamed("stop", "end").unionByName(bare)


def _crowded(sql: str) -> str:
    return sql.replace("{spans}", "{crowded_spans}").replace("{hunks}", "{crowded_hunks}")


_CALLS = "SELECT DISTINCT s.id, (SELECT min(id) FROM {spans} m WHERE m.file = s.file) AS callee FROM {spans} s"


@query(
    f"""WITH u AS (SELECT DISTINCT * FROM {{crowded_spans}}), f AS (SELECT file FROM {{crowded_hunks}} UNION SELECT concat('file', p_partkey % 1000) FROM {{part}}), fb AS (SELECT id FROM u WHERE lo IS NULL AND file IN (SELECT file FROM f)),
    ch AS ({_crowded(_MEETS)}), sel AS (SELECT id FROM fb UNION SELECT id FROM ch), ca AS (SELECT DISTINCT c.id FROM ({_crowded(_CALLS)}) c WHERE c.callee IN (SELECT id FROM sel) AND c.id NOT IN (SELECT id FROM sel))
    SELECT (SELECT count(*) FROM u) AS total, (SELECT count(*) FROM sel) + (SELECT count(*) FROM ca) AS selected, (SELECT count(*) FROM fb) AS fallback, (SELECT count(*) FROM ca) AS callers_added, (SELECT count(*) FROM f) AS changed_files"""
)
def diff_stats(t):
    units = t["crowded_spans"].distinct()
    least = units.groupBy("file").agg(F.array(F.min("id")).alias("direct_calls"))
    manifest = _manifest(t, "crowded_hunks")
    units = stored(units.join(least, "file"))  # as parsers' units are a table and not worked out by each step
    return matching.diff_statistics(matching.diff_selection(units, manifest, "callers"), manifest)


# an ending of the path is the file, or of the file the path; the first file (by its first span) counts
@query(
    """WITH f AS (SELECT file, min(id) AS pos FROM {spans} WHERE lo IS NOT NULL GROUP BY file), p AS (SELECT p_partkey AS point_id, concat(CASE WHEN p_partkey % 2 = 0 THEN 'repo/src/file' ELSE 'ile' END, p_partkey - p_partkey % 3) AS path, p_size AS a, p_size + 30 AS b FROM {part}),
    m AS (SELECT path, arg_min(file, pos) AS file FROM (SELECT DISTINCT path FROM p) q JOIN f ON ends_with(q.path, f.file) OR ends_with(f.file, q.path) GROUP BY path)
    SELECT DISTINCT p.point_id, s.id FROM p JOIN m ON m.path = p.path JOIN {spans} s ON s.file = m.file AND (p.a BETWEEN s.lo AND s.hi OR p.b BETWEEN s.lo AND s.hi)"""
)
def endpoint_in_range_join(t):
    head = F.when(F.col("p_partkey") % 2 == 0, "repo/src/file").otherwise("ile")
    points = t["part"].select(F.col("p_partkey").alias("point_id"), F.concat(head, F.col("p_partkey") - F.col("p_partkey") % 3).alias("path"), F.col("p_size").alias("start"), (F.col("p_size") + 30).alias("end"))
    return matching.containing(points, t["spans"].where("lo is not null").distinct().withColumn("pos", F.col("id")))


@query("SELECT DISTINCT e.caller AS id FROM {edges} e JOIN {roots} r ON r.id = e.callee WHERE e.caller NOT IN (SELECT id FROM {roots})")
def one_hop_callers(t):
    units = t["nodes"].select("id").join(t["edges"].groupBy(F.col("caller").alias("id")).agg(F.collect_set("callee").alias("direct_calls")), "id", "left")
    return graph.one_hop_callers(units, t["roots"])


@query(
    """WITH f AS (SELECT s.id, s.finding_id, s.source, s.sink, list_sort(list(c.evidence_id)) AS ev FROM {sources} s JOIN {cited} c ON c.id = s.id GROUP BY ALL),
    one AS (SELECT callee, min(caller) AS caller FROM {source_edges} GROUP BY callee HAVING count(*) = 1),
    m AS (SELECT b.id, b.finding_id, b.ev, o.caller FROM one o JOIN f b ON b.id = o.callee JOIN f a ON a.id = o.caller WHERE a.id <> b.id AND a.source = b.source AND a.sink = b.sink AND a.source <> '' AND a.sink <> '' AND list_has_any(a.ev, b.ev)),
    g AS (SELECT caller, list_sort(list(id)) AS ids, list(finding_id) AS fs, flatten(list(ev)) AS evs FROM m GROUP BY caller)
    SELECT f.id, coalesce(array_to_string(g.ids, ','), '') AS merged_from, CASE WHEN g.caller IS NULL THEN '' ELSE array_to_string(list_sort(list_distinct(list_append(g.fs, f.finding_id))), ',') END AS merged_finding_ids,
    array_to_string(list_sort(list_distinct(list_concat(f.ev, coalesce(g.evs, [])))), ',') AS evidence_ids FROM f LEFT JOIN g ON g.caller = f.id WHERE f.id NOT IN (SELECT id FROM m)"""
)
def caller_callee_dedup(t):
    cited = t["cited"].groupBy("id").agg(F.collect_list("evidence_id").alias("evidence_ids"))
    out = matching.caller_callee_merged(t["sources"].join(cited, "id"), t["source_edges"])
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return out.select("id", text("merged_from"), text("merged_finding_ids"), text("evidence_ids"))


_KEY = "CASE WHEN regexp_full_match(lower(content_hash), '[0-9a-f]{64}') THEN lower(content_hash) ELSE sha256(content) END"


@query(f"SELECT evidence_id, sha256(content) AS content_sha256, {_KEY} AS content_key FROM {{evidence}} WHERE evidence_id <> '' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY pos) = 1".replace("{64}", "{{64}}"))
def evidence_index(t):
    return matching.evidence_index(t["evidence"]).select("evidence_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), "content_key")


@query(
    f"""SELECT evidence_id, rule, count(*) AS n FROM (SELECT evidence_id, unnest(list_filter([CASE WHEN evidence_id = '' OR evidence_id IS NULL THEN 'missing_id' END, CASE WHEN content_hash = 'bad' THEN 'bad_hash' END, CASE WHEN length(content_hash) = 64 AND content_hash <> sha256(content) THEN 'hash_mismatch' END], lambda x: x IS NOT NULL)) AS rule FROM {{evidence}}) r GROUP BY evidence_id, rule
    UNION ALL SELECT evidence_id, 'conflict', count(DISTINCT {_KEY}) FROM {{evidence}} WHERE evidence_id <> '' GROUP BY evidence_id HAVING count(DISTINCT {_KEY}) > 1""".replace("{64}", "{{64}}")
)
def evidence_conflicts(t):
    return matching.evidence_errors(t["evidence"])


@query("SELECT concat(l.doc_id) AS finding_id, CASE WHEN l.doc_id % 3 = 0 THEN '' ELSE concat('d', l.doc_id) END AS resolved, CASE WHEN l.doc_id % 3 = 0 THEN concat('d', l.doc_id, ',zz') ELSE 'zz' END AS missing FROM {labels} l")
def evidence_missing_refs(t):
    index = t["documents"].where("doc_id % 3 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("evidence_id"))
    cited = t["labels"].select(F.col("doc_id").cast("string").alias("finding_id"), F.array(F.concat(F.lit("d"), "doc_id"), F.lit("zz")).alias("evidence_ids"))
    return matching.resolved_evidence(cited, index).select("finding_id", F.array_join("resolved", ",").alias("resolved"), F.array_join("missing", ",").alias("missing"))


_PRINT = """sha256(concat('{{"lang":"', lang, '","n":', n_chars, ',"source":"', source, '"}}'))"""


def _printed(docs, lang="lang"):
    return docs.select(F.col("doc_id").alias("id"), texts.fingerprint(n=F.col("n_chars"), lang=F.col(lang), source=F.col("source")).alias("fingerprint"))


@query(f"SELECT doc_id AS id, {_PRINT} AS fingerprint FROM {{documents}}")
def content_fingerprint(t):
    return _printed(t["documents"])


def _memo(t):
    old = t["documents"].where("doc_id % 2 = 0").withColumn("was", F.when(F.col("doc_id") % 6 == 0, "xx").otherwise(F.col("lang")))
    return _printed(old, "was").withColumn("status", F.when(F.col("id") % 10 == 0, "error").otherwise("ok"))


@query("SELECT doc_id AS id FROM {documents} WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0 AND doc_id % 10 <> 0")
def memo_reuse(t):
    return records.reusable(_printed(t["documents"]), _memo(t)).select("id")


@query("SELECT doc_id AS id FROM {documents} WHERE NOT (doc_id % 2 = 0 AND doc_id % 6 <> 0 AND doc_id % 10 <> 0)")
def memo_recompute(t):
    return records.to_recompute(_printed(t["documents"]), _memo(t)).select("id")


@query(
    """SELECT tp, fp, fn, tn, round_even((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round_even(tp / (tp + fp), 4) AS precision, round_even(tp / (tp + fn), 4) AS recall, round_even(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM
    (SELECT count(*) FILTER (quality = 1 AND n_chars > 1500) AS tp, count(*) FILTER (quality = 0 AND n_chars > 1500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 1500) AS fn, count(*) FILTER (quality = 0 AND n_chars <= 1500) AS tn FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) c"""
)
def confusion_metrics(t):
    return records.confusion(t["documents"].join(t["labels"], "doc_id"), F.col("quality") == 1, F.col("n_chars") > 1500)


@query(
    """SELECT pattern, count(*) AS members, array_to_string(list_sort(list(DISTINCT v)), ',') AS verdicts FROM (SELECT concat(source, '.py:', CASE WHEN doc_id % 4 = 2 THEN '*.' ELSE '*_' END, 'fn', doc_id % 3) AS pattern,
    CASE upper(verdict) WHEN 'BYPASSABLE' THEN 'VULNERABLE' WHEN 'PROTECTED' THEN 'SAFE' ELSE upper(verdict) END AS v FROM {routes}) x GROUP BY pattern HAVING count(*) >= 2 AND count(DISTINCT v) > 1"""
)
def group_consistency(t):
    return records.inconsistent_groups(t["routes"], texts.signature_pattern(F.col("route")), F.col("verdict")).withColumn("verdicts", F.array_join("verdicts", ","))


@query("SELECT user_id, event_id FROM {events} WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_success(t):
    return records.latest(t["events"].select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("SELECT event_id FROM {failures} WHERE kind IN ('rate_limit', 'timeout') OR (kind = 'api_status' AND status >= 500)")
def retry_filter(t):
    return t["failures"].where(verdicts.is_retryable(F.col("kind"), F.col("status"))).select("event_id")


@query("SELECT coalesce(kind, 'unknown') AS error_type, count(*) AS n FROM {failures} WHERE status % 2 = 1 GROUP BY 1")
def error_breakdown(t):
    return records.error_breakdown(t["failures"], F.col("status") % 2 == 0, F.col("kind"))


@query("SELECT count(*) AS calls, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens FROM {calls}")
def usage_totals(t):
    return records.usage(t["calls"])


@query(
    """SELECT model, count(*) AS calls, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens,
    round_even((sum(input_tokens) * CASE WHEN model = 'm-user' THEN 1.0::double ELSE 3.0::double END + sum(output_tokens) * CASE WHEN model = 'm-user' THEN 5.0::double ELSE 15.0::double END) / 1000000, 6) AS cost FROM {calls} GROUP BY model"""
)
def cost_by_model(t):
    prices = t.spark.createDataFrame([("m-user", 1.0, 5.0)], "model string, input_price double, output_price double")
    return records.priced(records.usage(t["calls"], ["model"]), prices, default=(3.0, 15.0))


@query(
    """SELECT part, id AS advisory_id FROM (SELECT p.part, a.id, cast(split_part(version, '.', 1) AS int) * 100 + cast(split_part(version, '.', 2) AS int) AS v, cast(introduced AS int) * 100 AS lo, cast(split_part(fixed, '.', 1) AS int) * 100 + 5 AS hi, cast(last_affected AS int) * 100 AS top
    FROM {packages} p JOIN {advisories} a ON replace(lower(p.name), '_', '-') = a.package) x WHERE v >= lo AND ((hi IS NOT NULL AND v < hi) OR (top IS NOT NULL AND v <= top) OR (hi IS NULL AND top IS NULL))"""
)
def version_affected(t):
    advisories = t["advisories"].select("id", F.lit("pypi").alias("ecosystem"), "package", F.array().cast("array<int>").alias("cwe_ids"), F.array(F.struct("introduced", "fixed", "last_affected")).alias("affected_ranges"))
    return matching.advisory_matches(t["packages"], advisories).select("part", "advisory_id")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)token|licen[cs]e'))) AS lines FROM {documents} WHERE regexp_matches(text, '(?i)token|licen[cs]e')")
def usage_search(t):
    pattern = "(?i)token|licen[cs]e"
    return t["documents"].where(F.col("text").rlike(pattern)).select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(pattern))).cast("bigint").alias("lines"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))[1:3], '|') AS lines FROM {documents}")
def first_k_matches(t):
    return t["documents"].select("doc_id", F.array_join(texts.matching_lines(F.col("text"), "[0-9]", 3), "|").alias("lines"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN props END AS object, event_id % 5 = 3 AS truncated FROM {events}")
def json_extract(t):
    return t["answers"].select("event_id", texts.json_object(F.col("answer")).alias("object"), texts.looks_truncated(F.col("answer")).alias("truncated"))


@query()
def html_sanitize(t):
    return t["pages"].select("page_id", html.sanitize_html("html").alias("html"))


@query("SELECT conv_id, string_agg(text, ' || ' ORDER BY turn) AS text FROM (SELECT conv_id, text, min(turn) AS turn FROM {conversations} GROUP BY conv_id, text) x GROUP BY conv_id")
def ordered_concat(t):
    return records.ordered_text(t["conversations"], "conv_id", "turn", F.col("text"), " || ")


@query(
    """WITH RECURSIVE f AS (SELECT cast(floor(doc_id / 100) AS bigint) AS repo, doc_id AS id, n_chars + length(source) + 50 AS need, row_number() OVER (PARTITION BY floor(doc_id / 100) ORDER BY n_chars, doc_id) AS k FROM {documents}),
    w(repo, id, k, used, bin) AS (SELECT repo, id, k, need, 0 FROM f WHERE k = 1 UNION ALL SELECT f.repo, f.id, f.k, CASE WHEN w.used + f.need > 20000 THEN f.need ELSE w.used + f.need END, CASE WHEN w.used + f.need > 20000 THEN w.bin + 1 ELSE w.bin END FROM w JOIN f ON f.repo = w.repo AND f.k = w.k + 1)
    SELECT repo, id, cast(bin AS int) AS bin FROM w"""
)
def bin_pack(t):
    files = t["documents"].select(F.floor(F.col("doc_id") / 100).alias("repo"), F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("n_chars").alias("size"))
    return records.packed(files, "repo", 20_000)


@query("SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def topk(t):
    return t["customer"].select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("SELECT unit_id FROM {stage1} ORDER BY pos LIMIT 50")
def limit_first(t):
    return t["stage1"].orderBy("pos").limit(50).select("unit_id")


@query("SELECT source, lang, min(doc_id) AS pos FROM {documents} GROUP BY source, lang")
def ordered_distinct_union(t):
    parts = [t["documents"].where(F.col("lang").isin(*langs)).select("source", "lang", F.col("doc_id").alias("pos"), F.length("text").alias("n")) for langs in (("en", "fr"), ("fr", "de", "es"))]
    return matching.first_by(parts[0].unionAll(parts[1]), ["source", "lang"]).select("source", "lang", "pos")


@query(
    """SELECT value, count(*) AS n FROM (SELECT concat('s/', lpad(cast(p_partkey AS varchar), 9, '0')) AS path, CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' END AS value FROM {part}) x WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, min(path) LIMIT 1"""
)
def language_vote(t):
    k = F.col("p_partkey") % 5
    ending = F.when(k == 0, ".py").when(k == 1, ".tsx").when(k == 2, ".PY").when(k == 3, ".js").otherwise(".txt")
    files = t["part"].select(F.concat(F.lit("s/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), ending).alias("path"))
    hidden = t["part"].select(F.concat(F.lit("node_modules/"), F.col("p_partkey"), F.lit(".js")).alias("path"))
    return records.main_language(files.unionAll(hidden))


@query("SELECT unit_type, count(*) AS units, round_even(sum(id % 7) / count(*), 2) AS mean_up, round_even(sum(id % 5) / count(*), 2) AS mean_down FROM {nodes} GROUP BY unit_type")
def unit_statistics(t):
    return records.unit_statistics(t["nodes"], "unit_type", F.col("id") % 7, F.col("id") % 5)


_A = "CASE a WHEN ' Vuln ' THEN 'vulnerable' WHEN 'bypass' THEN 'bypassable' WHEN 'SAFE' THEN 'safe' WHEN 'uncertain' THEN 'inconclusive' ELSE 'error' END"


@query(
    f"""SELECT id, va AS verdict, va IN ('vulnerable', 'bypassable') AS actionable, va = 'safe' AS safe, CASE WHEN va = vb THEN '=' ELSE '~' END AS symbol,
    CASE WHEN va <> vb THEN concat('CHANGED: ', va, ' → ', vb) ELSE concat('CONFIRMED: ', va, CASE WHEN agrees = false THEN ' (reasoning refined)' ELSE '' END) END AS label FROM (SELECT id, agrees, {_A} AS va, coalesce(b, {_A}) AS vb FROM {{words}}) x"""
)
def verdict_transitions(t):
    both = verdicts.transition(F.col("a"), F.col("b"), F.col("agrees"))
    return t["words"].select("id", verdicts.normalized_verdict(F.col("a")).alias("verdict"), verdicts.is_actionable(F.col("a")).alias("actionable"), verdicts.is_safe(F.col("a")).alias("safe"), both["symbol"].alias("symbol"), both["label"].alias("label"))


@query(
    f"""SELECT id, CASE WHEN n1 OR n2 OR n3 THEN 'INCONCLUSIVE' WHEN hit AND (act OR pos) THEN 'VULNERABLE' WHEN act AND dyn IS NULL AND (pos OR stage2 IS NULL) THEN upper(va) ELSE 'INCONCLUSIVE' END AS verdict,
    concat_ws(',', CASE WHEN n1 THEN 'stage2_dynamic_conflict' END, CASE WHEN n2 THEN 'static_positive_dynamic_unconfirmed' END, CASE WHEN n3 THEN 'static_dynamic_conflict' END) AS conflicts FROM
    (SELECT *, neg AND hit AS n1, (act OR pos) AND unsure AS n2, NOT act AND hit AS n3 FROM (SELECT id, dyn, stage2, {_A} AS va, {_A} IN ('vulnerable', 'bypassable') AS act, coalesce(stage2 IN ('Confirmed', 'agreed'), false) AS pos, coalesce(stage2 = 'rejected', false) AS neg, coalesce(dyn = 'confirmed', false) AS hit, coalesce(dyn = 'BLOCKED', false) AS unsure FROM {{words}}) y) x"""
)
def merged_verdicts(t):
    m = verdicts.merged_verdict(F.col("a"), F.col("stage2"), F.col("dyn"))
    return t["words"].select("id", m["verdict"].alias("verdict"), F.array_join(m["conflicts"], ",").alias("conflicts"))


@query("SELECT file, first AS start, first + CASE WHEN k = 1 THEN 3 ELSE 0 END AS stop FROM (SELECT replace(file, './', '') AS file, cast(first AS int) AS first, k FROM {manifest_lines}) x WHERE k <> 0")
def hunk_ranges(t):
    h = texts.hunk_range(F.col("line"))
    return t["manifest_lines"].select(texts.clean_path(F.col("file")).alias("file"), h.alias("h")).where("h is not null").select("file", "h.start", F.col("h.end").alias("stop"))


@query(
    """SELECT id, CASE WHEN k = 0 THEN '/abs/x' WHEN k = 1 THEN 'a/../b' WHEN k = 2 THEN 'C:\\x' WHEN k = 3 THEN 'ok/a..b' ELSE 'src/f.py' END AS path, k < 3 AS unsafe,
    CASE WHEN k = 0 THEN '__abs__x' WHEN k = 1 THEN 'a__..__b' WHEN k = 2 THEN 'C___x' WHEN k = 3 THEN 'ok__a..b' ELSE 'src__f.py' END AS file_name, CASE WHEN k = 4 THEN 'python' END AS language FROM (SELECT o_orderkey AS id, o_orderkey % 5 AS k FROM {orders}) x"""
)
def path_functions(t):
    k, path = F.col("o_orderkey") % 5, F.col("path")
    made = t["orders"].select(F.col("o_orderkey").alias("id"), F.when(k == 0, "/abs/x").when(k == 1, "a/../b").when(k == 2, "C:\\x").when(k == 3, "ok/a..b").otherwise("src/f.py").alias("path"))
    return made.select("id", "path", texts.is_unsafe_path(path).alias("unsafe"), texts.safe_file_name(path).alias("file_name"), texts.language_of(path).alias("language"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
