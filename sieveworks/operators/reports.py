"""What reports show: finding rows, sections, statistics and charts of an artifact, steps and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts, verdicts
from .stages import section_numbers, worst_state_per_file

# States whose section is open in a report, their colours, and how urgent old verdicts are.
OPEN_STATES = ("reproduced", "confirmed_not_dynamically_tested", "confirmed_not_reproduced", "candidate")
VERDICT_PRIORITY = {"vulnerable": 1, "bypassable": 2, "inconclusive": 3, "protected": 4, "safe": 5}
TEXT_LIMIT = 300
#: findings that a row of a report's sections lists at most
PAGE = 10_000


def _filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def finding_place(file: Column, function: Column, unit_id: Column) -> Column:
    """(file, function) of a report's row: those of the location, else the id's parts, else the id itself or `unknown`."""
    at, has = texts.split_id(unit_id), unit_id.contains(":")
    by_id = (F.coalesce(file, F.lit("")) == "") & has
    path = _filled(file, F.when(has, at["file"]).otherwise(unit_id))
    name = _filled(F.when(by_id, at["function"]).otherwise(function), F.when(has, at["function"]).otherwise(unit_id))
    return F.struct(_filled(path, F.lit("unknown")).alias("file"), _filled(name, F.lit("unknown")).alias("function"))


def analysis_text(impacts: list[Column], evidence: list[Column], candidate_type: Column) -> Column:
    """The first impact that isn't blank, else the first evidence's text, else the candidate's type; at most 300 characters."""
    kind = F.trim(F.coalesce(candidate_type, F.lit("")))
    return F.left(_filled(*(F.trim(c) for c in impacts), *evidence, F.when(kind != "", F.concat(F.lit("Candidate type: "), kind))), F.lit(TEXT_LIMIT))


def placed_rows(findings: DataFrame) -> DataFrame:
    """What a report's rows have without their details: number, in_section, unit_id, final_state, label, file, function, open.

    Of the findings only the columns that are shown or ordered by are numbered."""
    rows = section_numbers(findings.select("unit_id", "final_state", "section", "pos", "file", "function"))
    place = finding_place(F.col("file"), F.col("function"), F.col("unit_id"))
    label = F.element_at(F.create_map(*(F.lit(x) for pair in verdicts.STATES.items() for x in pair)), F.col("final_state"))
    return rows.select("number", "in_section", "unit_id", "final_state", label.alias("label"), place["file"].alias("file"), place["function"].alias("function"), F.col("final_state").isin(*OPEN_STATES).alias("open"))


def finding_rows(findings: DataFrame, details: DataFrame) -> DataFrame:
    """A report's rows: number, in_section, final_state, label, file, function, attack_vector, analysis, open.

    findings: the merge's; details: unit_id, source, propagation, sink, impact, candidate_type of the first stage and
    verified_source, propagation2, sink2, impact2 of the second, and evidence_text."""
    vector = texts.attack_vector(_filled(F.col("verified_source"), F.col("source")), _filled(F.col("propagation2"), F.col("propagation")), _filled(F.col("sink2"), F.col("sink")))
    analysis = analysis_text([F.col("impact2"), F.col("impact")], [F.col("evidence_text")], F.col("candidate_type"))
    both = placed_rows(findings).join(details.select("unit_id", vector.alias("attack_vector"), analysis.alias("analysis")), "unit_id", "left")
    told = [F.coalesce(c, F.lit("")).alias(c) for c in ("attack_vector", "analysis")]
    return both.select("number", "in_section", "unit_id", "final_state", "label", "file", "function", *told, "open")


def places(findings: DataFrame) -> DataFrame:
    """(unit_id, file, function): where a report shows each finding, for counts that need neither numbers nor details."""
    place = finding_place(F.col("file"), F.col("function"), F.col("unit_id"))
    return findings.select("unit_id", place["file"].alias("file"), place["function"].alias("function"))


def report_stats(metrics_row: DataFrame, rows: DataFrame) -> DataFrame:
    """The one row of a report's card: total_units, total_files, reproduced, confirmed, candidates, rejected, inconclusive, errors.

    rows: the findings' places, or a report's rows.  Of total_units, the first that isn't 0 counts: the metrics', or the number of findings."""
    shown = rows.agg(F.count("*").alias("n"), F.count_distinct("file").alias("total_files"))
    row = metrics_row.crossJoin(shown)  # two single rows
    return row.select(
        F.coalesce(F.nullif("total_units", F.lit(0)), F.col("n")).alias("total_units"), "total_files", F.col("dynamic_reproduced").alias("reproduced"), F.col("stage2_confirmed").alias("confirmed"), F.col("stage1_candidates").alias("candidates"),
        F.col("stage2_rejected").alias("rejected"), (F.col("stage1_inconclusive") + F.col("stage2_inconclusive")).alias("inconclusive"), (F.col("stage1_errors") + F.col("stage2_failed") + F.col("dynamic_failed")).alias("errors"),
    )


def sections(rows: DataFrame) -> DataFrame:
    """(rank, page, final_state, label, n, open, findings): the sections of the states that occur, in order of rank and page.

    rows: placed ones, or a report's.  findings lists (in_section, unit_id, file, function) in order, n of them: this is the view model that
    a page is made of.  A section of more than PAGE findings goes on in further rows, so that no row grows with the report."""
    listed = F.array_sort(F.collect_list(F.struct("in_section", "unit_id", "file", "function")))
    page = F.floor((F.col("in_section") - 1) / PAGE) + 1
    one = rows.groupBy("final_state", "label", "open", page.alias("page")).agg(listed.alias("findings"))
    return one.select(verdicts.state_rank(F.col("final_state")).alias("rank"), "page", "final_state", "label", F.size("findings").cast("bigint").alias("n"), "open", "findings")


def markdown_lines(rows: DataFrame, cwe: Column) -> DataFrame:
    """(rank, line, text) of a report's tables in Markdown: a header of four lines for each state, then its findings, in order of rank and line."""
    rank = verdicts.state_rank(F.col("final_state"))
    table = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("in_section").cast("string"), F.col("function"), F.concat_ws(":", "file", "function"), F.concat(F.lit("CWE-"), cwe.cast("string")), "final_state"), F.lit(" |"))
    body = rows.select(rank.alias("rank"), (F.col("in_section") + 3).cast("bigint").alias("line"), table.alias("text"))
    heads = F.array(F.concat(F.lit("## "), "label"), F.lit(""), F.lit("| # | Finding | Location | CWE | State |"), F.lit("|---|------|------|-----|------|"))
    head = rows.select(rank.alias("rank"), "label").distinct().select("rank", F.posexplode(heads).alias("line", "text")).select("rank", F.col("line").cast("bigint").alias("line"), "text")
    return head.unionAll(body)


def state_counts(findings: DataFrame) -> DataFrame:
    """(final_state, n) of the states that occur; findings without one don't count."""
    return findings.where("final_state <> ''").groupBy("final_state").agg(F.count("*").alias("n"))


def file_states(rows: DataFrame) -> DataFrame:
    return worst_state_per_file(rows, "file")


def step_rows(steps: DataFrame) -> DataFrame:
    """Steps (step, status, timestamp, duration_seconds, cost_usd) as a report lists them, by their time's text."""
    return steps.select("step", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), texts.duration(F.coalesce("duration_seconds", F.lit(0.0))).alias("duration"), texts.cost_text(F.coalesce("cost_usd", F.lit(0.0))).alias("cost")).orderBy("timestamp", "step")


def step_totals(steps: DataFrame) -> DataFrame:
    """(duration_seconds, cost_usd) of all steps; missing ones are 0."""
    return steps.agg(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("duration_seconds"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def usage_by_step(calls: DataFrame, steps: DataFrame) -> DataFrame:
    """Each step's calls, tokens and cost: those of calls (at, input_tokens, output_tokens, cost) between its begin and end.

    steps: step, began, ended (exclusive); steps don't overlap, and there are a few dozen of them at most, by a run's plan."""
    met = calls.join(F.broadcast(steps), (F.col("at") >= F.col("began")) & (F.col("at") < F.col("ended")))
    sums = met.groupBy("step").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost")))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "input_tokens", "output_tokens", "cost")]
    return steps.select("step").join(sums, "step", "left").select("step", *zero)


def with_prior_usage(calls: DataFrame, prior: DataFrame) -> DataFrame:
    """The calls with those of the run that this one resumes, so that totals go on from there."""
    return calls.unionByName(prior.select(*calls.columns))


def status_counts(results: DataFrame) -> DataFrame:
    """(status, n) of dynamic results, in capitals; a missing status is ERROR."""
    return results.groupBy(F.upper(F.coalesce(F.nullif("status", F.lit("")), F.lit("ERROR"))).alias("status")).agg(F.count("*").alias("n"))


def verdict_summary(results: DataFrame, units: DataFrame) -> DataFrame:
    """Results (unit_id, verdict, attack_vector, reasoning, explanation, pos) with their unit's description, the most urgent first.

    The file is what the id has before its last colon, else the id; unknown verdicts rank with the inconclusive ones."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in VERDICT_PRIORITY.items() for x in pair)), F.col("verdict")), F.lit(3))
    file = F.when(F.col("unit_id").contains(":"), texts.split_id(F.col("unit_id"))["file"]).otherwise(F.col("unit_id"))
    one = units.groupBy("unit_id").agg(F.max_by("description", "pos").alias("description"))
    return results.join(one, "unit_id", "left").select(
        file.alias("file"), "unit_id", "verdict", rank.alias("rank"), "pos", *(F.coalesce(c, F.lit("")).alias(c) for c in ("attack_vector", "reasoning", "explanation")), F.left(F.coalesce("description", F.lit("")), F.lit(TEXT_LIMIT)).alias("description")
    ).orderBy("rank", "pos")


def stage1_records(results: DataFrame) -> DataFrame:
    """Results (unit_id, decision, finding_id, stage2_finding_id, cwe_id, file, function, source, sink, evidence_ids, stage2_evidence_ids)
    as the first stage's records: an id of the second stage, else its own, else `f-` and the unit; a place by the unit's id."""
    none = F.array().cast("array<string>")
    ids = lambda c: F.when(F.size(c) > 0, F.col(c))
    return results.select(
        "unit_id", _filled(F.col("stage2_finding_id"), F.col("finding_id"), F.concat(F.lit("f-"), "unit_id")).alias("finding_id"), "decision", F.coalesce(F.nullif(F.col("cwe_id").cast("string"), F.lit("")), F.lit("0")).alias("cwe_id"),
        _filled(F.col("file"), F.when(F.col("unit_id").contains(":"), F.substring_index("unit_id", ":", 1)).otherwise("unknown")).alias("file"), _filled(F.col("function"), F.when(_filled(F.col("file")) == "", F.col("unit_id"))).alias("function"),
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("sink", F.lit("")).alias("sink"), F.coalesce(ids("evidence_ids"), ids("stage2_evidence_ids"), none).alias("evidence_ids"),
    )


def dynamic_records(results: DataFrame) -> DataFrame:
    """Dynamic results, flat, with what a run that told nothing counts as: failed, inconclusive, no evidence."""
    none = F.array().cast("array<string>")
    return results.select(
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("unit_id", "finding_id", "test_id")), _filled(F.col("execution_state"), F.lit("failed")).alias("execution_state"), _filled(F.col("decision"), F.lit("inconclusive")).alias("decision"), F.coalesce("evidence_ids", none).alias("evidence_ids"),
        _filled(F.col("provenance_reason"), F.col("reason")).alias("reason"),
    )


def testable(findings: DataFrame) -> DataFrame:
    """The findings (decision, execution_state, finding_id, evidence) that the second stage confirmed with evidence: those a dynamic test can be run for."""
    return findings.where(verdicts.is_confirmed(F.col("decision"), F.col("execution_state"), F.col("finding_id"), F.col("evidence")))


def eligible_units(units: DataFrame) -> DataFrame:
    """Units (s1, s2, s2_run, finding_id, evidence) that a run tests: a candidate that was confirmed; cited ids needn't resolve here."""
    return units.where((F.col("s1") == "candidate") & verdicts.is_confirmed(F.col("s2"), F.col("s2_run"), F.col("finding_id"), F.col("evidence")))


def reach_summary(metadata: DataFrame, units: DataFrame, metrics_row: DataFrame) -> DataFrame:
    """One row of total_units, reachable, unreachable, unknown_reachability and missing: the dataset's metadata, else counts of
    its units' tags (reachability; any other word is unknown) if any has one, else the metrics, else zeros, which are marked missing.

    metadata: at most one row (original_units, reachable_units, unreachable_units, unknown_units); nothing is made up."""
    names = ("total_units", "reachable", "unreachable", "unknown_reachability")
    told = metadata.select(*(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(n) for c, n in zip(("original_units", "reachable_units", "unreachable_units", "unknown_units"), names, strict=True))).limit(1).agg(F.first(F.struct(*names)).alias("a"))
    tag = F.col("reachability")
    tags = units.agg(F.count("*").alias(names[0]), F.count_if(tag == "reachable").alias(names[1]), F.count_if(tag == "unreachable").alias(names[2]), F.count_if(F.coalesce(~tag.isin("reachable", "unreachable"), F.lit(True))).alias(names[3]), F.count_if(F.coalesce(tag != "", F.lit(False))).alias("tagged"))
    tags = tags.select(F.when(F.col("tagged") > 0, F.struct(*names)).alias("b"), F.col("total_units").alias("n"))
    known = metrics_row.select(F.when(F.col("reachable").isNotNull() & F.col("unknown_reachability").isNotNull(), F.struct(*(F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names))).alias("c"), F.col("total_units").cast("bigint").alias("t")).limit(1).agg(F.first("c").alias("c"), F.first("t").alias("t"))
    zero = F.lit(0).cast("bigint")
    none = F.struct(F.coalesce("t", "n").alias(names[0]), *(zero.alias(n) for n in names[1:]))
    row = told.crossJoin(tags).crossJoin(known)  # single rows
    return row.select(F.coalesce("a", "b", "c", none).alias("r"), (F.coalesce("a", "b", "c").isNull()).alias("missing")).select("r.*", "missing")


def diff_block(manifest: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of a report's diff: base_sha, head_sha, scope, pr_number, changed_files, units_in_diff, units_total; of a full scan, which has no manifest, none."""
    row = manifest.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("base_sha", "head_sha", "scope")), F.coalesce("pr_number", F.lit(0)).alias("pr_number"), F.size("changed_files").alias("changed_files")).limit(1)
    return row.join(stats.select(F.col("selected").alias("units_in_diff"), F.col("total").alias("units_total")), F.lit(True), "left").fillna(0)  # with a single row


def incremental(units: DataFrame, runs: DataFrame, hunks_of, scope: str = "changed_functions") -> DataFrame:
    """The units of an incremental scan: those that changed since the last successful run (commit, started_at, status), or all without one.

    hunks_of(commit) gives the changed ranges since a commit, as a manifest (file, start, end)."""
    from .matching import diff_selection
    from .records import latest

    last = latest(runs.withColumn("_all", F.lit(0)), ["_all"], "started_at", F.col("status") == "success").select("commit").first()
    return units.withColumn("diff_reason", F.lit("full")).withColumn("diff_selected", F.lit(True)) if last is None else diff_selection(units, hunks_of(last[0]), scope)


def gate(errors: DataFrame) -> None:
    """Raises if there is any row (rule, n): nothing is reported of an artifact that doesn't hold."""
    if found := errors.orderBy("rule").limit(20).collect():
        raise ValueError("the artifact has errors: " + ", ".join(f"{r.rule} ({r.n})" for r in found))


def labelled(findings: DataFrame, labels: DataFrame, language: str = "en") -> DataFrame:
    """The findings with their state's label in a language; labels (final_state, language, label) is a table of seven states a language."""
    mine = labels.where(F.col("language") == language).select("final_state", "label")
    return findings.join(F.broadcast(mine), "final_state", "left").withColumn("label", F.coalesce("label", "final_state"))
