"""Decisions of the stages, and what they amount to together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Final states in report order, with their labels.
STATES = {
    "reproduced": "Reproduced",
    "confirmed_not_dynamically_tested": "Confirmed, not dynamically tested",
    "confirmed_not_reproduced": "Confirmed, not reproduced",
    "candidate": "Candidate",
    "rejected": "Rejected",
    "inconclusive": "Inconclusive",
    "error": "Error",
}
# Spellings of verdicts.
ALIASES = {
    "candidate": "candidate", "vuln": "vulnerable", "vulnerability": "vulnerable", "vulnerable": "vulnerable", "bypass": "bypassable",
    "bypassable": "bypassable", "inconclusive": "inconclusive", "uncertain": "inconclusive", "protected": "protected", "safe": "safe",
    "no_finding": "no_finding", "nofinding": "no_finding", "error": "error",
}
ACTIONABLE = ("vulnerable", "bypassable", "candidate")
SAFE = ("safe", "protected", "no_finding")
TRANSIENT = ("rate_limit", "connection", "timeout")
TRANSIENT_TEXTS = (*TRANSIENT, "500", "502", "503", "504")


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty; the last one as it is."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values[:-1]), values[-1])


def state_rank(state: Column) -> Column:
    """A state's place in reports, from 1."""
    return F.array_position(F.array(*map(F.lit, STATES)), state)


def _is(value: Column, *options: str) -> Column:
    return F.coalesce(value.isin(*options), F.lit(False))


def final_state(s1: Column, s2: Column, s2_run: Column, dyn: Column, dyn_run: Column) -> Column:
    """One state of a unit's stage decisions and execution states; null means that a stage has no record."""
    fine2, fine_dyn = _is(s2_run, "succeeded"), _is(dyn_run, "succeeded")
    s2_open, untested = s2_run.isNull() | _is(s2_run, "pending", "running"), dyn_run.isNull() | _is(dyn_run, "skipped", "blocked", "pending", "running")
    sure = fine2 & _is(s2, "confirmed")
    rules = [
        (_is(s1, "error") | _is(s2_run, "failed") | _is(dyn_run, "failed"), "error"),
        (fine_dyn & _is(dyn, "reproduced"), "reproduced"),
        (fine2 & _is(s2, "rejected"), "rejected"),
        (sure & fine_dyn & _is(dyn, "not_reproduced"), "confirmed_not_reproduced"),
        (sure & untested, "confirmed_not_dynamically_tested"),
        (sure & _is(dyn, "inconclusive"), "inconclusive"),
        (_is(s1, "candidate") & s2_open, "candidate"),
        (_is(s1, "inconclusive") | _is(s2, "inconclusive") | _is(dyn, "inconclusive"), "inconclusive"),
        (_is(s1, "candidate"), "candidate"),
    ]
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in rules), F.lit("inconclusive"))


def _alias(value: Column) -> Column:
    key = F.lower(F.trim(value))
    return reduce(lambda case, pair: case.when(key == pair[0], pair[1]), ALIASES.items(), F.when(F.lit(False), ""))


def normalized_verdict(value: Column, default: Column | str = "error") -> Column:
    return F.coalesce(_alias(value), default if isinstance(default, Column) else F.lit(default))


def canonical_verdict(value: Column) -> Column:
    """Like normalized_verdict, but what is unknown stays."""
    return F.coalesce(_alias(value), value)


def is_actionable(value: Column) -> Column:
    return normalized_verdict(value).isin(*ACTIONABLE)


def is_safe(value: Column) -> Column:
    return normalized_verdict(value).isin(*SAFE)


def transition(stage1: Column, final: Column, agrees: Column) -> Column:
    """(symbol, label) of how a verdict went from the first stage to the last."""
    a = normalized_verdict(stage1)
    b = normalized_verdict(final, a)
    kept = F.concat(F.lit("CONFIRMED: "), b, F.when(F.coalesce(~agrees, F.lit(False)), " (reasoning refined)").otherwise(""))
    return F.when(a != b, F.struct(F.lit("~").alias("symbol"), F.concat(F.lit("CHANGED: "), a, F.lit(" → "), b).alias("label"))).otherwise(F.struct(F.lit("=").alias("symbol"), kept.alias("label")))


def merged_verdict(stage1: Column, stage2: Column, dynamic: Column) -> Column:
    """(verdict, evidence_status, conflicts) of three stages' words."""
    one, two, dyn = normalized_verdict(stage1), F.lower(F.coalesce(stage2, F.lit(""))), F.upper(F.coalesce(dynamic, F.lit("")))
    static, hit = one.isin(*ACTIONABLE), dyn == "CONFIRMED"
    positive, negative = two.isin("confirmed", "agreed"), two.isin("rejected", "inconclusive")
    unsure = dyn.isin("NOT_REPRODUCED", "BLOCKED", "INCONCLUSIVE", "ERROR")
    named = F.array(
        F.when(negative & hit, "stage2_dynamic_conflict"), F.when((static | positive) & unsure, "static_positive_dynamic_unconfirmed"), F.when(~static & hit, "static_dynamic_conflict")
    )
    conflicts = F.array_compact(named)
    verdict = F.when(F.size(conflicts) > 0, "inconclusive").when(hit & (static | positive), "vulnerable").when(static & (dyn == "") & (positive | (two == "")), one).otherwise("inconclusive")
    return F.struct(F.upper(verdict).alias("verdict"), F.when(verdict == "inconclusive", "incomplete").otherwise("complete").alias("evidence_status"), conflicts.alias("conflicts"))


def verification_status(stage1: Column, verified: Column, explanation: Column, agree: Column, correct: Column, has_path: Column, sink_reached: Column, broken_at: Column, control: Column) -> Column:
    """How far a verification went.  verified: whether there is any record; has_path: any exploit path."""
    said, control = F.trim(F.coalesce(explanation, F.lit(""))), F.coalesce(control, F.lit("unknown"))
    sink, yes = F.coalesce(sink_reached, F.lit(True)), F.coalesce(agree, F.lit(False))
    blocked = ~sink | F.coalesce(broken_at != "", F.lit(False)) | (control == "none")
    proven = is_actionable(correct) & has_path & sink & ~control.isin("none", "unknown")
    return (
        F.when(said == "Max iterations reached", "max_iterations").when(F.lower(said).contains("timeout"), "timeout")
        .when(~verified, F.when(is_safe(stage1), "protected").otherwise("uncertain"))
        .when(is_safe(correct), "protected").when(agree.isNotNull() & ~yes, "disagreed")
        .when(blocked, F.when(is_actionable(stage1), "likely").otherwise("protected"))
        .when(yes & proven, "confirmed").when(yes, "likely").otherwise("uncertain")
    )


def oracle_decision(**checks: Column) -> Column:
    """(execution_state, decision, reason) of a dynamic run's checks, which are booleans by name:
    blocked, build_ok, infra_error, parse_ok, harness_ok, marker_ok, begun, harness_begun, same_target,
    resolvable, preconditions, success_run, success_hit, negative_run, negative_pass."""
    c = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    steps = [
        (c["blocked"], "blocked", "inconclusive", "target_unresolvable"),
        (~c["build_ok"] | c["infra_error"], "failed", "inconclusive", "build_or_infra_error"),
        (~c["parse_ok"], "failed", "inconclusive", "harness_json_invalid"),
        (~c["harness_ok"], "failed", "inconclusive", "harness_invalid"),
        (~c["marker_ok"] | ~c["begun"], "succeeded", "inconclusive", "target_call_not_begun"),
        (~c["harness_begun"] | ~c["same_target"], "succeeded", "inconclusive", "identity_or_call_mismatch"),
        (~c["resolvable"], "failed", "inconclusive", "execution_evidence_unresolvable"),
        (c["success_hit"] & c["success_run"] & c["preconditions"], "succeeded", "reproduced", "success_oracle_hit"),
        (c["preconditions"] & c["success_run"] & ~c["success_hit"] & c["negative_run"] & c["negative_pass"], "succeeded", "not_reproduced", "success_miss_negative_pass"),
    ]
    made = lambda run, decision, reason: F.struct(F.lit(run).alias("execution_state"), F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))
    return F.coalesce(*(F.when(test, made(*rest)) for test, *rest in steps), made("succeeded", "inconclusive", "oracle_incomplete"))


def is_confirmed(decision: Column, run: Column, finding_id: Column, evidence: Column) -> Column:
    """Confirmed by the second stage: succeeded, with an id and at least one evidence that has one."""
    cited = F.exists(F.coalesce(evidence, F.array().cast("array<struct<evidence_id:string,kind:string>>")), lambda e: F.coalesce(e["evidence_id"] != "", F.lit(False)))
    return _is(decision, "confirmed") & _is(run, "succeeded") & F.coalesce(finding_id != "", F.lit(False)) & cited


def dynamic_eligibility(s1: Column, confirmed: Column, cited: Column, known: Column) -> Column:
    """Why a finding can't be tested dynamically, or "eligible"."""
    return F.when(~_is(s1, "candidate"), "not_a_candidate").when(~confirmed, "not_confirmed").when(F.size(F.array_except(cited, known)) > 0, "unresolved_evidence").otherwise("eligible")


def is_rate_limited(kind: Column, text: Column) -> Column:
    return F.when(kind.isNotNull(), kind == "rate_limit").otherwise(F.coalesce(F.lower(text).contains("rate_limit"), F.lit(False)))


def is_retryable(kind: Column, status: Column, text: Column | None = None) -> Column:
    """Transient failures: by kind and status where there is a kind, else by words of the text."""
    by_kind = kind.isin(*TRANSIENT) | ((kind == "api_status") & (F.coalesce(status, F.lit(0)) >= 500))
    by_text = F.lit(False) if text is None else reduce(lambda a, b: a | b, (F.coalesce(F.lower(text).contains(t), F.lit(False)) for t in TRANSIENT_TEXTS))
    return F.when(kind.isNotNull(), by_kind).otherwise(by_text)
