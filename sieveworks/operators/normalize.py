"""What a model or a harness answered, brought to a stage's fixed record.

Answers are JSON texts.  They are parsed as variants, so that a field of the wrong type is told from one
that is missing; every rule is a column expression, and the first that applies decides.  Nothing is ever
made stronger: an answer that breaks a rule comes out as inconclusive, with the kind of its fault.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import texts
from .checks import STAGE1_DECISIONS, STAGE2_DECISIONS

# Keys that a stage's answer must not have, verdicts of old answers, roles that a confirmation needs
# evidence for, and what counts as the reason of a rejection.
STAGE1_FORBIDDEN = ("confirmed", "verdict", "finding", "security_classification", "classification_reasoning", "vulnerable", "exploitable", "vulnerable_internal", "agree", "correct_finding")
STAGE2_FORBIDDEN = ("agree", "correct_finding", "stage1_finding", "verification_note", "finding", "verdict", "attack_vector", "reasoning")
ENHANCEMENT_FORBIDDEN = (
    "security_classification", "classification_reasoning", "exploitable", "vulnerable_internal", "additional_callers", "verdict", "finding", "confirmed", "decision", "cwe_id", "cwe_name",
    "attack_vector", "vulnerabilities", "severity", "why_vulnerable", "not_a_vulnerability",
)
LEGACY_VERDICTS = ("vulnerable", "bypassable", "safe", "protected")
ROLES = ("impact", "propagation", "sink", "source")
EVIDENCE = "array<struct<evidence_id:string,kind:string,roles:array<string>,refutes:boolean>>"

_NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*|BOOLEAN)$"


def _ids() -> Column:
    return F.array().cast("array<string>")


def _field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _type(value: Column) -> Column:
    """The type of a variant, in capitals; VOID for JSON's null, null for a missing one."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(_type(value).isin(*kinds), F.lit(False))


def _is_number(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(_NUMBERS), F.lit(False))


def _absent(value: Column) -> Column:
    return value.isNull() | _is(value, "VOID")


def _text(v: Column, name: str) -> Column:
    """A field as text; null, false and missing ones are empty."""
    field = _field(v, name)
    return F.when(_absent(field), "").otherwise(F.coalesce(field.try_cast("string"), F.lit("")))


def _id_list(v: Column, name: str) -> Column:
    """A list of ids as strings: empty without the field, null if it is no list of strings and integers; nulls in it go."""
    field = _field(v, name)
    items = F.filter(field.try_cast("array<variant>"), lambda x: ~_absent(x))
    good = F.forall(items, lambda x: _is(x, "STRING", "BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN"))
    return F.when(_absent(field), _ids()).when(_is(field, "ARRAY") & good, F.transform(items, lambda x: x.cast("string")))


def _list_or_absent(v: Column, name: str) -> Column:
    """Whether a field is a list, or isn't there at all."""
    field = _field(v, name)
    return field.isNull() | _is(field, "ARRAY")


def _has_key(raw: Column, *keys: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(raw), F.array(*map(F.lit, keys))), F.lit(False))


def _known(ids: Column, known: Column) -> Column:
    return F.filter(ids, lambda i: F.array_contains(known, i))


def _cases(*rules: tuple[Column, Column]) -> Column:
    """The value of the first rule that holds."""
    out = F.when(F.lit(False), rules[0][1])
    for test, value in rules[:-1]:
        out = out.when(F.coalesce(test, F.lit(False)), value)
    return out.otherwise(rules[-1][1])


def detection_result(raw: Column, known: Column) -> Column:
    """The first stage's record of an answer: decision, candidate_type, cwe_id, file, function, source, propagation,
    sink, impact, evidence_ids, counter_evidence_ids, confidence, and the kinds of its faults.

    known: the evidence ids that exist.  Answers that aren't objects, claim a confirmation, have no
    valid decision, cite unknown evidence, or have fields of wrong types come out as inconclusive and
    without content (of unknown evidence, the known rest and the confidence stay); so does a candidate
    without evidence, with its content.  An unsafe file of the location is dropped."""
    v = F.try_parse_json(raw)
    decision, conf, cwe = _field(v, "decision"), _field(v, "confidence"), _field(v, "cwe_id")
    said = F.when(_is(decision, "STRING"), decision.cast("string"))
    evid, counter = _id_list(v, "evidence_ids"), _id_list(v, "counter_evidence_ids")
    legacy = F.lower(F.coalesce(F.nullif(_field(v, "finding", "string"), F.lit("")), _field(v, "verdict", "string")))
    number = F.when(_is_number(conf), F.when(_is(conf, "BOOLEAN"), conf.cast("boolean").cast("int").cast("double")).otherwise(conf.cast("double"))).otherwise(0.0)
    at = _field(v, "location")
    file = F.when(_is(at, "OBJECT"), _field(at, "file"))
    unsafe = F.coalesce(~_absent(file) & (~_is(file, "STRING") | texts.is_unsafe_path(file.cast("string"))), F.lit(False))

    def made(decision, fault, full, evid=None, counter=None, confidence=None):
        fields = {
            "decision": decision, "candidate_type": _text(v, "candidate_type"), "cwe_id": F.when(_absent(cwe), "0").otherwise(cwe.cast("string")), "file": F.when(unsafe, "").otherwise(F.coalesce(file.cast("string"), F.lit(""))),
            "function": F.when(_is(at, "OBJECT"), F.coalesce(_field(at, "function", "string"), F.lit(""))).otherwise(""), **{c: _text(v, c) for c in ("source", "propagation", "sink", "impact")},
        }
        blank = {"cwe_id": "0"}
        columns = [(value if full or k == "decision" else F.lit(blank.get(k, ""))).alias(k) for k, value in fields.items()]
        ids = [(x if x is not None else _ids()).alias(k) for k, x in (("evidence_ids", evid), ("counter_evidence_ids", counter))]
        return F.struct(*columns, *ids, (confidence if confidence is not None else F.lit(0.0)).alias("confidence"), fault.alias("faults"))

    empty = lambda kind: made(F.lit("inconclusive"), F.array(F.lit(kind)), False)
    unknown = F.size(F.array_except(F.concat(evid, counter), known)) > 0
    bare = (said == "candidate") & (F.size(evid) == 0)
    faults = F.array_compact(F.array(F.when(unsafe, F.lit("invalid_location_file")), F.when(bare, F.lit("missing_evidence"))))
    return _cases(
        (v.isNull() | ~_is(v, "OBJECT"), empty("invalid_payload")), (_has_key(raw, "confirmed") | (said == "confirmed"), empty("forbidden_field")),
        (~F.coalesce(said.isin(*STAGE1_DECISIONS), F.lit(False)) & legacy.isin(*LEGACY_VERDICTS), empty("legacy_verdict_rejected")), (~F.coalesce(said.isin(*STAGE1_DECISIONS), F.lit(False)), empty("invalid_decision")),
        (evid.isNull() | counter.isNull(), empty("invalid_type")), (unknown, made(F.lit("inconclusive"), F.array(F.lit("unknown_evidence_id")), False, _known(evid, known), _known(counter, known), number)),
        (conf.isNotNull() & ~_is_number(conf), empty("invalid_type")), (~_list_or_absent(v, "guards") | ~_list_or_absent(v, "preconditions"), empty("invalid_type")),
        (~_absent(cwe) & ~_is(cwe, "STRING", "BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN"), empty("invalid_type")), (F.lit(True), made(F.when(bare, "inconclusive").otherwise(said), faults, True, evid, counter, number)),
    )


def evidence_entry(raw: Column) -> Column:
    """(evidence_id, kind, roles, refutes) of an evidence's JSON: the roles that it covers, by its own role, covers
    and evidence_role, its content's role and covers, and its kind's name; and whether it refutes a finding."""
    v = F.try_parse_json(raw)
    content, kind = _field(v, "content"), F.lower(F.coalesce(_field(v, "kind", "string"), F.lit("")))
    listed = [(v, c) for c in ("role", "covers", "evidence_role")] + [(content, c) for c in ("role", "covers")]
    words = F.flatten(F.array(*(F.coalesce(_field(x, c, "array<string>"), F.when(_is(_field(x, c), "STRING"), F.array(_field(x, c, "string"))), _ids()) for x, c in listed)))
    named = F.filter(F.array(*map(F.lit, ROLES)), lambda r: kind.contains(r))
    roles = F.array_intersect(F.array(*map(F.lit, ROLES)), F.concat(F.transform(words, lambda w: F.lower(w)), named))
    return F.struct(_field(v, "evidence_id", "string").alias("evidence_id"), kind.alias("kind"), roles.alias("roles"), _refutes(content, kind).alias("refutes"))


# Parts of a kind or a reason that make counter-evidence.
REJECT_REASONS = ("path_break", "broken_path", "valid_guard", "guard", "precondition_failure", "precondition", "unreachable")


def _refutes(content: Column, kind: Column) -> Column:
    reason = F.lower(F.coalesce(*(F.nullif(_field(content, c, "string"), F.lit("")) for c in ("reject_reason", "reason_kind", "reason")), F.lit("")))
    flags = [F.coalesce(_field(content, c, "boolean"), F.lit(False)) for c in ("path_broken", "guard_valid", "precondition_failed", "precondition_unmet")]
    out = F.lit(False)
    for token in REJECT_REASONS:
        out = out | kind.contains(token) | reason.contains(token)
    for flag in flags:
        out = out | flag
    return out


def cited(table: Column, ids: Column) -> Column:
    """The entries of an evidence array that ids name, in the ids' order; ids without an entry go."""
    return F.filter(F.transform(ids, lambda i: F.get(F.filter(table, lambda e: e["evidence_id"] == i), F.lit(0))), lambda e: e.isNotNull())


def verification_result(raw: Column, run: Column, table: Column) -> Column:
    """The second stage's record of an answer: execution_state, decision, verified_source, propagation, sink, impact,
    evidence_ids, counter_evidence_ids, confidence, and the kinds of its faults.

    run: how the run ended; table: the evidence (EVIDENCE, see evidence_entry).  A confirmation needs
    evidence, all four fields of the path, and evidence that covers each role; a rejection needs
    counter-evidence that breaks the path, proves a guard or fails a precondition.  What falls short is
    inconclusive."""
    v = F.try_parse_json(raw)
    decision, conf = _field(v, "decision"), _field(v, "confidence")
    said = F.when(_is(decision, "STRING"), decision.cast("string"))
    evid, counter = _id_list(v, "evidence_ids"), _id_list(v, "counter_evidence_ids")
    known = F.transform(table, lambda e: e["evidence_id"])
    number = F.when(_is_number(conf), F.when(_is(conf, "BOOLEAN"), conf.cast("boolean").cast("int").cast("double")).otherwise(conf.cast("double"))).otherwise(0.0)
    path = {c: _text(v, c) for c in ("verified_source", "propagation", "sink", "impact")}
    mapped = _field(v, "evidence_roles")
    by_map = F.filter(F.array(*map(F.lit, ROLES)), lambda r: F.array_contains(F.transform(F.coalesce(F.json_object_keys(F.when(_is(mapped, "OBJECT"), F.to_json(mapped))), _ids()), lambda k: F.lower(F.trim(k))), r))
    covered = F.array_union(by_map, F.flatten(F.transform(cited(table, evid), lambda e: e["roles"])))
    missing = F.size(F.array_except(F.array(*map(F.lit, ROLES)), covered)) > 0
    no_path = F.lit(False)
    for field in path.values():
        no_path = no_path | (F.trim(field) == "")
    refuted = F.exists(cited(table, counter), lambda e: F.coalesce(e["refutes"], F.lit(False)))
    fault = (
        F.when((said == "confirmed") & (F.size(evid) == 0), "missing_evidence").when((said == "confirmed") & no_path, "missing_path_fields").when((said == "confirmed") & missing, "missing_role_evidence")
        .when((said == "rejected") & (F.size(counter) == 0), "missing_counter_evidence").when((said == "rejected") & ~refuted, "insufficient_counter_evidence")
    )

    def made(state, decision, faults, full, evid=None, counter=None, confidence=None):
        fields = [(value if full else F.lit("")).alias(k) for k, value in path.items()]
        ids = [(x if x is not None else _ids()).alias(k) for k, x in (("evidence_ids", evid), ("counter_evidence_ids", counter))]
        return F.struct(state.alias("execution_state"), decision.alias("decision"), *fields, *ids, (confidence if confidence is not None else F.lit(0.0)).alias("confidence"), faults.alias("faults"))

    state = F.when(run.isin("pending", "running", "succeeded", "failed", "skipped"), run).otherwise("failed")
    empty = lambda kind, s=None: made(s if s is not None else state, F.lit("inconclusive"), F.array(F.lit(kind)), False)
    ended = made(run, F.lit("inconclusive"), F.when(_text(v, "reason") != "", F.array(F.lit("termination"))).otherwise(_ids()), False)
    unknown = F.size(F.array_except(F.concat(evid, counter), known)) > 0
    return _cases(
        (run.isin("failed", "skipped"), ended), (v.isNull() | ~_is(v, "OBJECT"), empty("invalid_payload", F.lit("failed"))), (_has_key(raw, *STAGE2_FORBIDDEN), empty("forbidden_fields", F.lit("succeeded"))),
        (~F.coalesce(said.isin(*STAGE2_DECISIONS), F.lit(False)), empty("invalid_decision")), (evid.isNull() | counter.isNull(), empty("invalid_type")),
        (unknown, made(state, F.lit("inconclusive"), F.array(F.lit("unknown_evidence_id")), False, _known(evid, known), _known(counter, known), number)), (conf.isNotNull() & ~_is_number(conf), empty("invalid_type")),
        (~_list_or_absent(v, "guards") | ~_list_or_absent(v, "missing_evidence"), empty("invalid_type")),
        (F.lit(True), made(F.lit("succeeded"), F.when(fault.isNotNull(), "inconclusive").otherwise(said), F.array_compact(F.array(fault)), True, evid, counter, number)),
    )


def dynamic_result(**checks: Column) -> Column:
    """(execution_state, decision) of a dynamic run's checks, whatever it claimed: unsupported, build_ok, timed_out,
    harness_ok, evidence_ok, target_reached, preconditions, success_hit, positive_done, negative_done."""
    c = {k: F.coalesce(x, F.lit(False)) for k, x in checks.items()}
    fine = c["target_reached"] & c["preconditions"] & c["positive_done"]
    pair = lambda run, decision: F.struct(F.lit(run).alias("execution_state"), F.lit(decision).alias("decision"))
    return _cases(
        (c["unsupported"], pair("skipped", "inconclusive")), (~c["build_ok"] | c["timed_out"], pair("failed", "inconclusive")), (~c["harness_ok"] | ~c["evidence_ok"], pair("failed", "inconclusive")),
        (fine & c["success_hit"], pair("succeeded", "reproduced")), (fine & c["negative_done"] & ~c["success_hit"], pair("succeeded", "not_reproduced")), (F.lit(True), pair("succeeded", "inconclusive")),
    )


def oracle_hit(spec: Column, begun: Column, exit_code: Column, stdout: Column, stderr: Column, harness: Column) -> Column:
    """Whether an oracle holds.  spec: its JSON, an object or a text, which is a marker; harness: JSON of what the
    harness reported (return_repr, call_completed, exception_type), or null.

    Types: exit_code, signal, sanitizer, http_status, file_contains, return_value, exception and marker (stdout_contains,
    stderr_contains), each with its other names; unknown types never hold, and none does before the call has begun."""
    v, h = F.try_parse_json(spec), F.try_parse_json(harness)
    out, err = F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit(""))
    both = F.concat(out, F.lit("\n"), err)
    kind = F.when(_is(v, "STRING"), "marker").otherwise(F.lower(F.coalesce(F.nullif(_field(v, "type", "string"), F.lit("")), F.nullif(_field(v, "kind", "string"), F.lit("")), F.lit("marker"))))
    word = lambda *names: F.when(_is(v, "STRING"), v.cast("string")).otherwise(F.coalesce(*(F.nullif(_field(v, n, "string"), F.lit("")) for n in names), F.lit("")))
    inside = lambda needle, text: (needle != "") & text.contains(needle)
    expected = F.coalesce(_field(v, "value", "string"), _field(v, "equals", "string"))
    number = F.when(expected.isNull(), 0).otherwise(expected.try_cast("int"))
    status = word("value", "status")
    no_harness = h.isNull() | ~_is(h, "OBJECT")
    thrown, wanted = F.coalesce(_field(h, "exception_type", "string"), F.lit("")), word("value", "exception_type")
    actual = _field(h, "return_repr", "string")
    returned = F.when(expected.isNull(), actual.isNotNull() & F.coalesce(_field(h, "call_completed", "boolean"), F.lit(False))).otherwise(F.coalesce(actual, F.lit("None")) == expected)
    hit = (
        F.when(kind.isin("exit_code", "exit"), exit_code == number).when(kind == "signal", inside(F.upper(word("value", "signal")), F.upper(both)))
        .when(kind.isin("sanitizer", "asan", "ubsan"), both.contains("AddressSanitizer") | both.contains("UndefinedBehaviorSanitizer"))
        .when(kind == "http_status", both.contains(F.concat(F.lit("HTTP "), status)) | both.contains(F.concat(F.lit('"status": '), status))).when(kind.isin("file_contains", "file_change"), inside(word("value", "contains"), both))
        .when(kind.isin("return_value", "return_equals"), ~no_harness & returned).when(kind.isin("exception", "raises"), ~no_harness & F.when(wanted == "", thrown != "").otherwise(thrown.contains(wanted)))
        .when(kind == "stderr_contains", inside(word("value", "marker"), err)).when(kind.isin("marker", "stdout_contains"), inside(word("value", "marker"), both)).otherwise(False)
    )
    given = F.when(_is(v, "STRING"), v.cast("string") != "").otherwise(_is(v, "OBJECT") & (F.size(F.coalesce(F.json_object_keys(spec), _ids())) > 0))
    return F.coalesce(begun & given & hit, F.lit(False))


def precondition_states(items: Column, known: Column) -> Column:
    """(satisfied, states): of each precondition (precondition_id, supporting_evidence_ids, status; null for one that
    was only text) whether it is satisfied, unsatisfied or unknown, and whether all are.

    It is satisfied if it cites evidence and all of it is known, unknown if it cites none; a status of its
    own can only make it weaker.  Without preconditions all is satisfied."""
    support = lambda p: F.coalesce(p["supporting_evidence_ids"], _ids())
    own = lambda p: F.when(p["status"].isin("unsatisfied", "unknown"), p["status"])
    found = lambda p: F.when(p.isNull() | (F.size(support(p)) == 0), "unknown").when(F.size(F.array_except(support(p), known)) > 0, "unsatisfied").otherwise("satisfied")
    states = F.transform(F.coalesce(items, F.array().cast("array<struct<precondition_id:string,supporting_evidence_ids:array<string>,status:string>>")), lambda p: F.coalesce(own(p), found(p)))
    return F.struct(F.forall(states, lambda s: s == "satisfied").alias("satisfied"), states.alias("states"))


def enhancement_result(raw: Column) -> Column:
    """(related_units, relation_type, notes, observations, faults) of an enhancement's answer.

    related_units are those of the answer, or of include_functions in old ones; items that aren't objects
    go.  The relation type is the answer's, else that which all units share, or mixed.  Notes are the
    call context's, or the old usage context; observations (kind, value) are the old data flow's inputs, outputs
    and tainted variables where the answer has no list of its own."""
    v = F.try_parse_json(raw)
    none = F.array().cast("array<struct<id:string,relation_type:string,reason:string>>")
    new, old = _field(v, "related_units"), _field(v, "include_functions")
    text = lambda x, *names: F.coalesce(*(F.nullif(_field(x, n, "string"), F.lit("")) for n in names), F.lit(""))
    unit = lambda x: F.struct(text(x, "id").alias("id"), F.coalesce(F.nullif(text(x, "relation_type", "type"), F.lit("")), F.lit("related")).alias("relation_type"), text(x, "reason").alias("reason"))
    units = lambda list_: F.transform(F.filter(F.coalesce(list_.try_cast("array<variant>"), F.array().cast("array<variant>")), lambda x: _is(x, "OBJECT")), unit)
    related = F.when(_absent(new), F.when(_is(old, "ARRAY"), units(old)).otherwise(none)).when(_is(new, "ARRAY"), units(new)).otherwise(none)
    kinds = F.array_distinct(F.transform(related, lambda u: u["relation_type"]))
    said = _field(v, "relation_type")
    relation = F.when(_is(said, "STRING"), said.cast("string")).when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(F.size(kinds) > 1, "mixed").otherwise("")
    context, usage, flow = _field(v, "call_context"), _field(v, "usage_context"), _field(v, "data_flow")
    notes = F.when(_is(context, "OBJECT"), F.coalesce(_field(context, "notes", "array<string>"), _ids())).when(_is(usage, "STRING") & (usage.cast("string") != ""), F.array(usage.cast("string"))).otherwise(_ids())
    seen = lambda kind, name: F.transform(F.coalesce(_field(flow, name, "array<string>"), _ids()), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    observed, listed = _field(v, "dataflow_observations"), "array<struct<kind:string,value:string>>"
    observations = (
        F.when(_is(observed, "ARRAY"), F.coalesce(_field(v, "dataflow_observations", listed), F.array().cast(listed)))
        .when(_absent(observed) & _is(flow, "OBJECT"), F.concat(seen("input", "inputs"), seen("output", "outputs"), seen("tainted_variable", "tainted_variables"))).otherwise(F.array().cast(listed))
    )
    bad = v.isNull() | ~_is(v, "OBJECT")
    pick = lambda value, blank: F.when(bad, blank).otherwise(value)
    return F.struct(
        pick(related, none).alias("related_units"), pick(relation, F.lit("")).alias("relation_type"), pick(notes, _ids()).alias("notes"), pick(observations, F.array().cast(listed)).alias("observations"),
        F.when(bad, F.array(F.lit("invalid_payload"))).otherwise(_ids()).alias("faults"),
    )
