"""The stages' records of a unit, merged into one state; counts, gates, sections and rows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts, verdicts
from ..tables import numbered


# First-stage decisions that make a finding, and states in which a second-stage rejection is a contradiction.
LISTED = ("candidate", "inconclusive", "error")
CONFIRMED_STATES = ("reproduced", "confirmed_not_dynamically_tested", "confirmed_not_reproduced")
_NO_IDS = "array<string>"


def _optional(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def _records(rows: DataFrame, stage: str) -> DataFrame:
    """(key, stage, record, hash): a stage's rows under their unit_id, or their finding_id where that is null
    or empty; rows without either go.  Ids begin alike, so sorts by key go by its hash first, which compares at once."""
    key = F.coalesce(F.nullif(F.col("unit_id").cast("string"), F.lit("")), F.nullif(F.col("finding_id").cast("string"), F.lit("")))
    kinds = {"finding_id": "string", "decision": "string", "execution_state": "string", "file": "string", "function": "string", "evidence_ids": _NO_IDS}
    record = F.struct(F.col("pos").cast("bigint").alias("pos"), *(_optional(rows, c, kind).alias(c) for c, kind in kinds.items()))
    return rows.select(key.alias("key"), F.lit(stage).alias("stage"), record.alias("record")).where("key is not null").withColumn("hash", F.xxhash64("key"))


def merged(stage1: DataFrame, stage2: DataFrame, dynamic: DataFrame) -> DataFrame:
    """The findings: one row for each unit that the stages report on, with what they said and its final state.

    The inputs have unit_id, finding_id, pos, decision, and execution_state but for stage1; file,
    function and evidence_ids are taken where there are any.  A record's key is its unit_id, or its
    finding_id without one; the last record of a key counts, in the place of its first.

    Units come in two groups, in the order of pos: those that the first stage lists (candidate,
    inconclusive or error; if it lists none at all, all but no_finding), and units beyond these that
    the second stage has a record of, whatever it says.  The dynamic record is that of the key; only
    in the first group, a unit without one takes the last dynamic record of the second stage's
    finding_id.

    Columns: unit_id (the key), finding_id, section (0, 1), pos, s1, s2, s2_run, dyn, dyn_run, file,
    function, evidence_ids (all stages', each once, in order), final_state.
    """
    rows = _records(stage1, "one").unionByName(_records(stage2, "two")).unionByName(_records(dynamic, "dyn"))
    own = lambda s: F.when(F.col("stage") == s, F.col("record"))
    units = rows.groupBy("hash", "key").agg(*(F.max(own(s)).alias(s) for s in ("one", "two", "dyn")), *(F.min(own(s)["pos"]).alias(f"{s}_at") for s in ("one", "two")))
    listed = F.coalesce(F.col("one.decision").isin(*LISTED), F.lit(False))
    # of the first stage alone, so that the units are worked out once
    last = rows.where("stage = 'one'").groupBy("hash", "key").agg(F.max(F.struct("record.pos", "record.finding_id", "record.decision")).alias("one"))
    any_listed = last.agg(F.coalesce(F.max(F.col("one.decision").isin(*LISTED)), F.lit(False)).alias("any_listed"))
    first = listed | (~F.col("any_listed") & F.col("one").isNotNull() & ~F.coalesce(F.col("one.decision") == "no_finding", F.lit(False)))
    units = units.crossJoin(F.broadcast(any_listed)).withColumn("first", first).where("first or two is not null")  # with a single row
    # units that look for a dynamic record by the second stage's finding; the others get a key of their own that meets nothing
    looks = F.col("first") & F.col("dyn").isNull() & F.coalesce(F.col("two.finding_id") != "", F.lit(False))
    by_finding = dynamic.where("finding_id <> ''").groupBy(F.col("finding_id").cast("string").alias("f")).agg(F.max(F.struct("pos", "decision", "execution_state", _optional(dynamic, "evidence_ids", _NO_IDS).alias("evidence_ids"))).alias("found"))
    hashed = lambda df, f: df.withColumn("f", f).withColumn("hash", F.xxhash64("f"))
    both = hashed(units, F.when(looks, F.concat(F.lit("f "), "two.finding_id")).otherwise(F.concat(F.lit("u "), "key"))).join(hashed(by_finding, F.concat(F.lit("f "), "f")), ["hash", "f"], "left")
    fields = ("decision", "execution_state", "evidence_ids")
    taken = F.struct(*(F.coalesce(F.col(f"dyn.{f}"), F.col(f"found.{f}")).alias(f) for f in fields))
    own_dyn = F.struct(*(F.col(f"dyn.{f}").alias(f) for f in fields))
    both = both.withColumn("dynamic", F.when(F.col("dyn").isNotNull(), own_dyn).otherwise(taken))
    at = F.when(F.coalesce(F.col("one.file") != "", F.lit(False)), F.struct(F.col("one.file").alias("file"), F.coalesce("one.function", F.lit("")).alias("function")))
    by_id = F.when(F.col("key").contains(":"), texts.split_id(F.col("key")))
    place = F.coalesce(at, by_id, F.struct(F.lit("").alias("file"), F.coalesce("one.function", F.lit("")).alias("function")))
    out = both.select(
        F.col("key").alias("unit_id"), verdicts.first_filled(F.col("two.finding_id"), F.col("one.finding_id"), F.col("key")).alias("finding_id"), F.when(F.col("first"), 0).otherwise(1).alias("section"),
        F.when(F.col("first"), F.col("one_at")).otherwise(F.col("two_at")).alias("pos"), F.col("one.decision").alias("s1"), F.col("two.decision").alias("s2"), F.col("two.execution_state").alias("s2_run"),
        F.col("dynamic.decision").alias("dyn"), F.col("dynamic.execution_state").alias("dyn_run"), place["file"].alias("file"), place["function"].alias("function"),
        texts.ordered_union(F.col("one.evidence_ids"), F.col("two.evidence_ids"), F.col("dynamic.evidence_ids")).alias("evidence_ids"),
    )
    return out.withColumn("final_state", verdicts.final_state(*(F.col(c) for c in ("s1", "s2", "s2_run", "dyn", "dyn_run"))))


def count_by_state(findings: DataFrame) -> DataFrame:
    """(final_state, n) for all seven states, also those without a finding, in their order."""
    states = findings.sparkSession.createDataFrame([(s, k) for k, s in enumerate(verdicts.STATES, 1)], "final_state string, rank int")
    counts = findings.groupBy("final_state").agg(F.count("*").alias("n"))
    return states.join(counts, "final_state", "left").select("final_state", F.coalesce("n", F.lit(0)).alias("n"), "rank").orderBy("rank").drop("rank")


def _count(test: Column, name: str) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False))).alias(name)


def metrics(stage1: DataFrame, stage2: DataFrame, dynamic: DataFrame) -> DataFrame:
    """One row: how many records of each stage came to what; a failed run counts before its decision."""
    d, run = F.col("decision"), F.coalesce("execution_state", F.lit(""))
    one = stage1.agg(*(_count(d == k, f"stage1_{name}") for k, name in (("candidate", "candidates"), ("no_finding", "no_finding"), ("inconclusive", "inconclusive"), ("error", "errors"))))
    two_case = F.when(run == "failed", "failed").when((d == "confirmed") & (run == "succeeded"), "confirmed").when((d == "rejected") & (run == "succeeded"), "rejected").when(d == "inconclusive", "inconclusive")
    two = stage2.agg(*(_count(two_case == k, f"stage2_{k}") for k in ("failed", "confirmed", "rejected", "inconclusive")))
    dyn_case = (
        F.when(run.isin("failed", "blocked", "skipped"), run).when((d == "reproduced") & (run == "succeeded"), "reproduced")
        .when((d == "not_reproduced") & (run == "succeeded"), "not_reproduced").when(d == "inconclusive", "inconclusive")
    )
    dyn = dynamic.agg(*(_count(dyn_case == k, f"dynamic_{k}") for k in ("failed", "blocked", "skipped", "reproduced", "not_reproduced", "inconclusive")))
    return one.crossJoin(two).crossJoin(dyn)  # three single rows


def full_metrics(reach: DataFrame, stage1: DataFrame, stage2: DataFrame, dynamic: DataFrame) -> DataFrame:
    """The one row of all eighteen counters: reach's (total_units, reachable, unreachable, unknown_reachability) and the stages'."""
    return reach.select("total_units", "reachable", "unreachable", "unknown_reachability").crossJoin(metrics(stage1, stage2, dynamic))  # two single rows


def reach_counts(status: DataFrame) -> DataFrame:
    """total_units, reachable, unreachable and unknown_reachability of (id, status)."""
    return status.agg(F.count("*").alias("total_units"), *(F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(name) for s, name in (("reachable", "reachable"), ("unreachable", "unreachable"), ("unknown", "unknown_reachability"))))


def tally(records: DataFrame, positive: str, negative: str) -> DataFrame:
    """One row of a stage's own counts: skipped runs are not attempted; blocked ones are, and inconclusive."""
    run, d = F.coalesce("execution_state", F.lit("failed")), F.coalesce("decision", F.lit("inconclusive"))
    tried = run != "skipped"
    open_ = tried & ((run == "blocked") | ~d.isin(positive, negative))
    return records.agg(
        _count(~tried, "skipped"), _count(tried, "attempted"), _count(run == "succeeded", "succeeded"), _count(run == "failed", "failed"), _count(run == "blocked", "blocked"),
        _count(tried & (run != "blocked") & (d == positive), positive), _count(tried & (run != "blocked") & (d == negative), negative), _count(open_, "inconclusive"),
    )


def gates(metrics_row: DataFrame, findings: DataFrame) -> DataFrame:
    """(level, met): whether anything at each threshold was found, by the metrics or by the final states."""
    seen = findings.agg(*(_count(F.col("final_state") == s, s) for s in verdicts.STATES))
    row = metrics_row.crossJoin(seen)  # two single rows
    errors = F.col("stage1_errors") + F.col("stage2_failed") + F.col("dynamic_failed")
    sure = F.col("reproduced") + F.col("confirmed_not_dynamically_tested") + F.col("confirmed_not_reproduced")
    levels = {"candidate": F.col("stage1_candidates") + F.col("candidate"), "confirmed": F.col("stage2_confirmed") + sure, "reproduced": F.col("dynamic_reproduced") + F.col("reproduced"), "error": errors + F.col("error")}
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), (n > 0).alias("met")) for k, n in levels.items()))).alias("g")).select("g.*")


def metric_errors(metrics_row: DataFrame) -> DataFrame:
    """(rule, ok) of the counters that must agree: total_units, reachable, unreachable, unknown_reachability, stage1_*."""
    reach = F.col("reachable") + F.col("unreachable") + F.col("unknown_reachability") == F.col("total_units")
    first = F.col("stage1_candidates") + F.col("stage1_no_finding") + F.col("stage1_inconclusive") + F.col("stage1_errors") <= F.col("total_units")
    rules = {"reachability_sum": reach, "stage1_sum": first, "not_negative": F.least(*(F.col(c) for c in metrics_row.columns)) >= 0}
    return metrics_row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), ok.alias("ok")) for k, ok in rules.items()))).alias("r")).select("r.*")


def state_errors(findings: DataFrame, known_evidence: DataFrame | None = None) -> DataFrame:
    """(unit_id, rule): findings whose state contradicts their stages, or that cite evidence (evidence_id) which isn't known."""
    s, s2, dyn = F.col("final_state"), F.coalesce("s2", F.lit("")), F.coalesce("dyn", F.lit(""))
    known = F.coalesce(s.isin(*verdicts.STATES), F.lit(False))
    rules = {
        "unknown_state": ~known, "reproduced_without_run": (s == "reproduced") & ((dyn != "reproduced") | (F.coalesce("dyn_run", F.lit("")) != "succeeded")), "reproduced_without_confirmation": (s == "reproduced") & (s2 != "confirmed"),
        "rejected_but_confirmed": s.isin(*CONFIRMED_STATES) & (s2 == "rejected"), "not_reproduced_without_run": (s == "confirmed_not_reproduced") & (dyn != "not_reproduced"),
        "legacy_safe": known & ((F.coalesce("s1", F.lit("")) == "safe") | (s2 == "safe") | (dyn == "safe")),
    }
    named = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(k)) for k, test in rules.items())))
    out = findings.select("unit_id", F.explode(named).alias("rule"))
    if known_evidence is None:
        return out
    cited = findings.where(known).select("unit_id", F.explode("evidence_ids").alias("evidence_id"))
    lost = cited.join(known_evidence.select("evidence_id").distinct(), "evidence_id", "left_anti")
    return out.unionAll(lost.select("unit_id", F.lit("unresolved_evidence").alias("rule")))


def artifact_errors(findings: DataFrame, metrics_row: DataFrame, buckets: DataFrame, summary: DataFrame, known_evidence: DataFrame, partial: bool = False) -> DataFrame:
    """(rule, n): all checks of a finished artifact, n the rows (or 1) that break each; no row, no error.

    buckets: (state, n) of the lists of candidates, rejected, inconclusive and error findings;
    summary: one row of total_units, reachable, unreachable, unknown_reachability; partial: the
    reachability stage said that its counts are incomplete, which excuses their sum."""
    broken = state_errors(findings, known_evidence).groupBy("rule").agg(F.count("*").alias("n"))
    counts = findings.agg(*(_count(F.col("final_state") == s, f"f_{s}") for s in verdicts.STATES))
    lists = buckets.agg(*(F.coalesce(F.max(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(f"b_{s}") for s in ("candidate", "rejected", "inconclusive", "error")))
    row = metrics_row.crossJoin(counts).crossJoin(lists).crossJoin(summary.select(*(F.col(c).alias(f"u_{c}") for c in ("total_units", "reachable", "unreachable", "unknown_reachability"))))  # single rows
    reach = lambda p: F.col(f"{p}reachable") + F.col(f"{p}unreachable") + F.col(f"{p}unknown_reachability")
    tests = {f"bucket_{s}": F.col(f"b_{s}") != F.col(f"f_{s}") for s in ("candidate", "rejected", "inconclusive", "error")}
    tests |= {
        "stage1_sum": F.col("stage1_candidates") + F.col("stage1_no_finding") + F.col("stage1_inconclusive") + F.col("stage1_errors") > F.col("total_units"),
        "not_reproduced_exceeds": (F.col("dynamic_not_reproduced") > 0) & (F.col("f_confirmed_not_reproduced") > F.col("dynamic_not_reproduced")), "reproduced_differs": F.col("dynamic_reproduced") != F.col("f_reproduced"),
    }
    if not partial:
        tests |= {"reachability_sum": reach("") != F.col("total_units"), "summary_sum": (F.col("u_total_units") > 0) & (reach("u_") != F.col("u_total_units"))}
    one = row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.when(test, 1).otherwise(0).cast("bigint").alias("n")) for k, test in tests.items()))).alias("r")).select("r.*").where("n > 0")
    return broken.unionByName(one)


def csv_rows(findings: DataFrame) -> DataFrame:
    """Report rows with the fixed columns, nulls empty, evidence ids joined by semicolons; `rank`, `section` and `pos` give their order."""
    label = F.element_at(F.create_map(*(F.lit(x) for pair in verdicts.STATES.items() for x in pair)), F.col("final_state"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return findings.select(
        verdicts.state_rank(F.col("final_state")).alias("rank"), "section", "pos", "final_state", label.alias("section_label"), "finding_id", "unit_id", "file", "function", empty(F.col("s1")).alias("stage1_decision"),
        empty(F.col("s2")).alias("stage2_decision"), empty(F.col("s2_run")).alias("stage2_execution_state"), empty(F.col("dyn")).alias("dynamic_decision"), empty(F.col("dyn_run")).alias("dynamic_execution_state"),
        F.array_join("evidence_ids", ";").alias("evidence_ids"),
    )


def section_numbers(findings: DataFrame) -> DataFrame:
    """The findings with their number in the report and in their section: by state, then in the order of the merge."""
    placed = numbered(findings.withColumn("rank", verdicts.state_rank(F.col("final_state"))), [F.col("rank"), F.col("section"), F.col("pos"), F.col("unit_id")])
    begins = placed.groupBy("rank").agg(F.min("number").alias("begin"))  # one row for each state
    return placed.join(F.broadcast(begins), "rank").withColumn("in_section", F.col("number") - F.col("begin") + 1).drop("begin", "rank")


def worst_state_per_file(findings: DataFrame, file: str) -> DataFrame:
    """(final_state, files): of each file its first state in report order, and how many files have each."""
    worst = findings.groupBy(file).agg(F.min(verdicts.state_rank(F.col("final_state"))).alias("rank"))
    return worst.groupBy(F.element_at(F.array(*map(F.lit, verdicts.STATES)), F.col("rank").cast("int")).alias("final_state")).agg(F.count("*").alias("files"))


def reduction(before: DataFrame, kept: DataFrame) -> DataFrame:
    """(total, kept, percent removed to one place, half to even)."""
    row = before.agg(F.count("*").alias("total")).crossJoin(kept.agg(F.count("*").alias("kept")))  # two single rows
    percent = F.when(F.col("total") > 0, F.bround((1 - F.col("kept") / F.col("total")) * 100, 1)).otherwise(0.0)
    return row.select("total", "kept", percent.alias("percent"))
