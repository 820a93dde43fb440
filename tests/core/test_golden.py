"""Operators against small tables of cases that fix their rules."""

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import html, texts, verdicts
from sieveworks.operators import graph, matching, records, reports, stages

S1 = "unit_id string, finding_id string, decision string, pos int, file string, function string, evidence_ids array<string>"
S2 = "unit_id string, finding_id string, decision string, execution_state string, pos int, evidence_ids array<string>"
MERGES = [
    ("candidate", ("confirmed", "succeeded"), ("reproduced", "succeeded"), "reproduced"), ("candidate", ("confirmed", "succeeded"), None, "confirmed_not_dynamically_tested"),
    ("candidate", ("confirmed", "succeeded"), ("not_reproduced", "succeeded"), "confirmed_not_reproduced"), ("candidate", None, None, "candidate"), ("candidate", ("rejected", "succeeded"), None, "rejected"), ("inconclusive", None, None, "inconclusive"),
    ("candidate", ("inconclusive", "succeeded"), None, "inconclusive"), ("candidate", ("confirmed", "succeeded"), ("inconclusive", "succeeded"), "inconclusive"), ("error", None, None, "error"), ("candidate", ("inconclusive", "failed"), None, "error"),
    ("candidate", ("confirmed", "succeeded"), ("inconclusive", "failed"), "error"), ("candidate", ("confirmed", "succeeded"), ("reproduced", "skipped"), "confirmed_not_dynamically_tested"), ("candidate", ("confirmed", "succeeded"), ("reproduced", "blocked"), "confirmed_not_dynamically_tested"),
]


def test_merge_table(spark):
    one = [(f"u{k}", f"F{k}", d, k, None, None, None) for k, (d, *_) in enumerate(MERGES)]
    two = [(f"u{k}", f"F{k}", *s2, k, None) for k, (_, s2, *_) in enumerate(MERGES) if s2]
    dyn = [(f"u{k}", f"F{k}", *x, k, None) for k, (_, _, x, _) in enumerate(MERGES) if x]
    got = stages.merged(spark.createDataFrame(one, S1), spark.createDataFrame(two, S2), spark.createDataFrame(dyn, S2))
    assert {r.unit_id: r.final_state for r in got.collect()} == {f"u{k}": m[3] for k, m in enumerate(MERGES)}


def test_merge_groups(spark):
    one = [
        ("nf", "f0", "no_finding", 1, None, None, ["a"]), ("nf2", "f1", "no_finding", 2, None, None, []), ("c", "f2", "candidate", 3, "x.py", "g", ["a", "b"]), ("c", "f2", "inconclusive", 9, None, None, ["c"]), (None, "fx", "candidate", 4, None, None, None),
        ("", "", "candidate", 5, None, None, None), ("p.py:q", "f4", "error", 6, "", "z", None),
    ]
    two = [("nf2", "f1", "inconclusive", "skipped", 1, None), ("only", "f5", "confirmed", "succeeded", 2, ["e"]), ("c", "f2", "confirmed", "succeeded", 3, ["b", "d"])]
    dyn = [(None, "f5", "reproduced", "succeeded", 1, None), ("other", "f2", "reproduced", "succeeded", 2, ["z"]), ("nf", "f0", "reproduced", "succeeded", 3, None)]
    rows = stages.merged(spark.createDataFrame(one, S1), spark.createDataFrame(two, S2), spark.createDataFrame(dyn, S2)).orderBy("section", "pos").collect()
    got = [(r.unit_id, r.finding_id, r.section, r.final_state, r.file, r.function, ",".join(r.evidence_ids)) for r in rows]
    assert got == [
        ("c", "f2", 0, "reproduced", "", "", "c,b,d,z"), ("fx", "fx", 0, "candidate", "", "", ""), ("p.py:q", "f4", 0, "error", "p.py", "q", ""), ("nf2", "f1", 1, "inconclusive", "", "", ""), ("only", "f5", 1, "confirmed_not_dynamically_tested", "", "", "e"),
    ]
    odd = spark.createDataFrame([("a", "f", None, 1, None, None, None), ("b", "f", "no_finding", 2, None, None, None)], S1)
    assert [r.unit_id for r in stages.merged(odd, spark.createDataFrame([], S2), spark.createDataFrame([], S2)).collect()] == ["a"]


UNITS = "id string, file string, lo int, hi int, direct_calls array<string>"


def selected(spark, units, manifest, scope):
    rows = matching.diff_selection(spark.createDataFrame(units, UNITS), spark.createDataFrame(manifest, "file string, start int, end int"), scope)
    return {r.id: r.diff_reason for r in rows.collect()}


def test_diff_scopes(spark):
    units = [("a", "./x.py", 1, 5, []), ("b", "x.py", 10, 20, []), ("c", "x.py", None, None, []), ("d", "y.py", 1, 9, ["b"]), ("e", "y.py", None, 3, ["d"]), ("z.py:f", "", 1, 2, []), ("g", "w.py", 1, 2, ["c"]), ("big", "x.py", 1, 900_000, [])]
    manifest = [("./x.py", 20, 30), ("z.py", None, None)]
    none = dict.fromkeys([u[0] for u in units])
    assert selected(spark, units, manifest, "changed_files") == none | dict.fromkeys(("a", "b", "c", "z.py:f", "big"), "changed")
    functions = none | {"b": "changed", "c": "fallback", "big": "changed"}
    assert selected(spark, units, manifest, "changed_functions") == functions
    assert selected(spark, units, manifest, "callers") == functions | {"d": "caller", "g": "caller"}
    marked = matching.diff_selection(spark.createDataFrame(units, UNITS), spark.createDataFrame(manifest, "file string, start int, end int"), "callers")
    assert tuple(matching.diff_statistics(marked, spark.createDataFrame(manifest, "file string, start int, end int")).first()) == (8, 5, 1, 2, 2)
    with pytest.raises(ValueError):
        selected(spark, units, manifest, "all")


def test_diff_units(spark):
    raw = ['{"id": "a.py:f", "code": {"primary_origin": {"file_path": "./b.py", "start_line": 1, "end_line": 2}}, "metadata": {"directCalls": ["x"]}}', '{"id": "d/c.py:g", "metadata": {"start_line": 3, "end_line": 4, "direct_calls": []}}', '{"id": "plain", "code": {"primary_origin": {"start_line": 1}}}']
    schema = "id string, code struct<primary_origin:struct<file_path:string,start_line:int,end_line:int>>, metadata struct<start_line:int,end_line:int,direct_calls:array<string>,directCalls:array<string>>"
    rows = spark.createDataFrame([(r,) for r in raw], "v string").select(F.from_json("v", schema).alias("u")).select("u.*")
    assert [tuple(r) for r in matching.diff_units(rows).collect()] == [("a.py:f", "b.py", 1, 2, ["x"]), ("d/c.py:g", "d/c.py", 3, 4, []), ("plain", None, None, None, [])]


def test_findings_in_functions(spark):
    functions = spark.createDataFrame([("f1", "src/a.js", 10, 20, 2), ("f2", "a.js", 1, 50, 1), ("f3", "lib/b.js", 1, 9, 3), ("f4", "lib/b.js", 100, 100_000, 4)], "id string, file string, lo int, hi int, pos int")
    points = spark.createDataFrame([("p1", "repo/src/a.js", 20, 30), ("p2", "b.js", 5, 5), ("p3", "b.js", 0, 200_000), ("p4", "b.js", 50_000, 50_001), ("p5", "no.js", 1, 1)], "point_id string, path string, start int, end int")
    assert {tuple(r) for r in matching.containing(points, functions).collect()} == {("p1", "f2"), ("p2", "f3"), ("p4", "f4")}


def test_scoped_names(spark):
    nodes = spark.createDataFrame(
        [("r1", "f", None, "a.py", None, "python"), ("r2", "g", None, "b.py", None, "python"), ("d1", "h", None, "p\\x.py", None, "python"), ("d2", "g", "C.g", "p/y.py", None, "python"), ("d3", "k", "g", "p/z.py", None, "python"), ("go1", "m", None, "x/1.go", "pk", "go"), ("go2", "n", None, "y/2.go", "pk", "go"), ("d4", "q", "M.run", "p/x.py", None, "python")],
        "id string, name string, qualified_name string, file_path string, package string, language string",
    )
    asked = spark.createDataFrame([("r1", "g"), ("d1", "g"), ("d1", "o.g"), ("d1", "x.run"), ("go1", "n"), ("d1", "<lambda>"), ("p/new.py:z", "h")], "caller string, callee_name string")
    got = {(r.caller, r.callee_name): list(r.candidates) for r in graph.scoped_candidates(asked, nodes).collect()}
    assert got == {("r1", "g"): [], ("d1", "g"): ["d2", "d3"], ("d1", "o.g"): ["d2"], ("d1", "x.run"): ["d4"], ("go1", "n"): ["go2"], ("d1", "<lambda>"): [], ("p/new.py:z", "h"): ["d1"]}


def test_reachability_cases(spark):
    nodes = spark.createDataFrame([(k,) for k in "abcdefg"], "id string")
    edges = spark.createDataFrame([("a", "b", None), ("b", "c", "low"), ("c", "d", "exact"), ("a", "a", "exact"), ("e", "f", "exact"), ("a", "zz", "exact"), ("d", "b", "exact")], "caller string, callee string, confidence string")
    roots = spark.createDataFrame([("a",), ("nowhere",)], "id string")
    states = lambda **more: {r.id: r.status for r in graph.reachability(nodes, edges, more.get("roots", roots), more.get("open")).collect()}
    base = {"a": "reachable", "b": "reachable", "c": "unknown", "d": "unknown", "e": "unreachable", "f": "unreachable", "g": "unreachable"}
    assert states() == base and set(states(roots=roots.limit(0)).values()) == {"unknown"}
    calls = spark.createDataFrame([("d", ["e"]), ("f", [])], "caller string, candidates array<string>")
    assert states(open=calls) == base | dict.fromkeys("efg", "unknown")
    long = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "exact") for k in range(30)], "caller string, callee string, confidence string")
    far = graph.closure(spark.createDataFrame([("n0",)], "id string"), long.selectExpr("caller as at", "callee as id"))
    assert far.count() == 31


def test_consistency_folds_only_two_pairs(spark):
    rows = spark.createDataFrame([("p", "vulnerable"), ("p", "Bypassable"), ("q", "safe"), ("q", "protected"), ("r", "vuln"), ("r", "vulnerable"), ("s", None), ("s", "safe"), ("t", "safe")], "pattern string, verdict string")
    got = {r.pattern: list(r.verdicts) for r in records.inconsistent_groups(rows, F.col("pattern"), F.col("verdict")).collect()}
    assert got == {"r": ["VULN", "VULNERABLE"], "s": ["", "SAFE"]}


def test_evidence_of_a_finding_without_any(spark):
    findings = spark.createDataFrame([("a", []), ("b", None), ("c", ["x", "y", "x"])], "finding_id string, evidence_ids array<string>")
    got = {r.finding_id: (list(r.resolved), list(r.missing)) for r in matching.resolved_evidence(findings, spark.createDataFrame([("x",)], "evidence_id string")).collect()}
    assert got == {"a": ([], []), "b": ([], []), "c": (["x", "x"], ["y"])}


def test_bins(spark):
    rows = spark.createDataFrame([("g", k, "p", s) for k, s in enumerate([10, 400, 30, 900, 5])] + [("h", 9, "p", 5000)], "repo string, id int, path string, size int")
    got = {(r.repo, r.id): r.bin for r in records.packed(rows, "repo", 300, overhead=50).collect()}
    assert got == {("g", 4): 0, ("g", 0): 0, ("g", 2): 0, ("g", 1): 1, ("g", 3): 2, ("h", 9): 0}


def test_html():
    clean = html.sanitized
    assert clean('<p onclick="x">a<script>bad()</script><b class="k$ j">c</p>d') == '<p>a<b class="k j">c</b></p>d'
    assert clean('<a href="#f" id="1">x</a><a href="javascript:1">y</a><img src=x onerror=1>') == '<a href="#f">x</a><a>y</a>'
    assert clean("<ul><li>1<li>2</ul></ul>&lt;i&gt; & <br/><hr>") == "<ul><li>1<li>2</li></li></ul>&lt;i&gt; &amp; <br /><hr>"
    assert clean("<style>x</style><iframe>y<p>z</p></iframe>w</script>v") == "wv" and clean(None) == clean("") == ""
    html_events = html._events
    try:
        html._events = lambda _: 1 / 0
        assert clean("<p>x</p>") == "<p>&lt;p&gt;x&lt;/p&gt;</p>"
    finally:
        html._events = html_events


def test_unused_before(spark):
    rows = spark.createDataFrame([("vuln",), ("odd",), (None,)], "v string")
    assert [r[0] for r in rows.select(verdicts.canonical_verdict(F.col("v"))).collect()] == ["vulnerable", "odd", None]
    memo = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, records.upserted(memo, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "caller string, callee string")
    assert matching.same_edges(edges, edges.unionAll(edges)) and not matching.same_edges(edges, edges.limit(1))
    near, open_ = graph.neighbourhood("b", edges, spark.createDataFrame([("x", "n", ["b"]), ("y", "n", ["c"])], "caller string, callee_name string, candidates array<string>"))
    assert near.count() == 2 and [r.caller for r in open_.collect()] == ["x"]
    calls = spark.createDataFrame([("f", "m1", "p1"), ("g", "m1", "p1"), ("h", "m9", "p9")], "name string, module string, package string")
    targets = spark.createDataFrame([("t1", "f", "m1", "p1"), ("t2", "g", "m2", "p1"), ("t3", "g", "m3", "p2"), ("t4", "h", "m1", "p1"), ("t5", "h", "m1", "p1")], "target string, name string, module string, package string")
    assert {r.name: r.target for r in graph.resolve_unique(calls, targets, ["module", "package"]).collect()} == {"f": "t1", "g": "t2", "h": None}
    units = spark.createDataFrame([(1, True), (2, False)], "id int, diff_selected boolean")
    assert matching.selected_only(units).count() == 1 and matching.selected_only(units.drop("diff_selected")).count() == 2
    ids = spark.range(1).select(texts.ordered_union(F.array(F.lit("b"), F.lit("")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b"))).alias("u"))
    assert list(ids.first().u) == ["b", "a"]
    lang = spark.createDataFrame([("JS", None, ""), (None, "a/b.TSX:f", ""), (None, None, "package main"), (None, None, "std::x"), (None, "x", "")], "l string, r string, c string")
    assert [r[0] for r in lang.select(texts.language_hint(F.col("l"), F.col("r"), F.col("c"))).collect()] == ["javascript", "typescript", "go", "cpp", "unknown"]
    urls = spark.createDataFrame([("https://h/r.git/", "s", "a.py"), ("", "s", "a")], "u string, s string, f string")
    assert [r[0] for r in urls.select(texts.file_url(F.col("u"), F.col("s"), F.col("f"))).collect()] == ["https://h/r/blob/s/a.py", ""]
    runs = spark.createDataFrame([("ok-1.2",), ("../x",), ("",), ("a" * 129,)], "r string")
    assert [r[0] for r in runs.select(texts.is_valid_run_id(F.col("r"))).collect()] == [True, False, False, False]


def test_reach_summary_sources(spark):
    meta = spark.createDataFrame([(9, 4, None, 5)], "original_units bigint, reachable_units bigint, unreachable_units bigint, unknown_units bigint")
    units = spark.createDataFrame([("reachable",), ("odd",), (None,)], "reachability string")
    known = spark.createDataFrame([(7, 1, 2, 4)], "total_units bigint, reachable bigint, unreachable bigint, unknown_reachability bigint")
    none = spark.createDataFrame([(3, None, None, None)], known.schema)
    assert tuple(reports.reach_summary(meta, units, known).first()) == (9, 4, 0, 5, False)
    assert tuple(reports.reach_summary(meta.limit(0), units, known).first()) == (3, 1, 0, 2, False)
    assert tuple(reports.reach_summary(meta.limit(0), units.where("false"), known).first()) == (7, 1, 2, 4, False)
    assert tuple(reports.reach_summary(meta.limit(0), units.where("false"), none).first()) == (3, 0, 0, 0, True)


STATUS = "stage1 string, verified boolean, explanation string, agree boolean, correct string, has_path boolean, sink boolean, broken string, control string"
STATUSES = [
    (("vulnerable", True, "Max iterations reached", None, "", False, None, None, None), "max_iterations"), (("safe", True, " a Timeout here ", True, "safe", False, None, None, None), "timeout"),
    (("safe", False, None, None, "", False, None, None, None), "protected"), (("vulnerable", False, None, None, "vulnerable", False, None, None, None), "uncertain"), (("vulnerable", True, "", False, "protected", False, None, None, None), "protected"),
    (("vulnerable", True, "", False, "vulnerable", False, None, None, None), "disagreed"), (("vulnerable", True, "", True, "vulnerable", True, False, None, "full"), "likely"), (("safe", True, "", True, "vulnerable", True, True, "guard", "full"), "protected"),
    (("vulnerable", True, "", True, "vulnerable", True, True, None, "full"), "confirmed"), (("vulnerable", True, "", True, "vulnerable", True, True, "", "unknown"), "likely"), (("vulnerable", True, "", True, "inconclusive", False, None, None, None), "likely"),
    (("vulnerable", True, "", None, "vulnerable", True, True, None, "full"), "uncertain"), (("bypassable", True, "", None, "vulnerable", True, True, None, "none"), "likely"),
]


def test_verification_status(spark):
    df = spark.createDataFrame([(k, *row) for k, (row, _) in enumerate(STATUSES)], "k int, " + STATUS)
    columns = ("stage1", "verified", "explanation", "agree", "correct", "has_path", "sink", "broken", "control")
    got = df.select("k", verdicts.verification_status(*(F.col(c) for c in columns)).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [s for _, s in STATUSES]


def test_roots_without_a_kind(spark):
    rows = spark.createDataFrame([("a", "f", None, "module_level"), ("b", "main", "", "function"), ("c", "g", "lambda", "module_level")], "id string, name string, kind string, unit_type string")
    none = {c: F.lit(None).cast("string") for c in ("code", "visibility", "package", "file_path")}
    got = graph.structural_roots(rows.withColumns(none | {"is_exported": F.lit(False), "language": F.lit("python")}))
    assert {r.id: r.kind for r in got.collect()} == {"a": "module_init", "b": "program_entry"}


def test_calls_of_a_name_share_what_it_means(spark):
    """One row for a node of a scope's name, however many calls ask for it; the caller itself is left aside."""
    nodes = spark.createDataFrame([(k, "f", "m.f", "src/a.py" if k < 4 else "src/b.py" if k == 4 else "src/c.py", None) for k in range(6)], "id bigint, name string, qualified_name string, file_path string, package string")
    asked = spark.createDataFrame([(k, "x.f") for k in range(6)], "caller bigint, callee_name string")
    open_, named = graph.scoped_names(asked, nodes, "python")
    names = {r.caller: r.open_name for r in open_.collect()}
    assert len({names[k] for k in range(4)}) == 1 and names[4] == names[5] and None not in names.values()
    assert named.groupBy("name", "id").count().where("count > 1").isEmpty() and named.count() == 4 + 1 + 1 + 6
    roots, edges = spark.createDataFrame([(4,)], "id bigint"), spark.createDataFrame([], "caller bigint, callee bigint, confidence string")
    calls = open_.where("caller = 4").selectExpr("*", "cast(array() AS array<bigint>) AS candidates")
    assert {r.id: r.status for r in graph.reachability(nodes, edges, roots, calls, named).collect()} == {4: "reachable"} | {k: "unknown" for k in (0, 1, 2, 3, 5)}


def test_ranges_that_overlap_are_one(spark):
    """Merged ranges hold the same lines; what meets them is what meets any range, also where ends are the wrong way round."""
    ranges = [("a", k, k + 3) for k in range(0, 30, 2)] + [("a", 100, 90), ("a", 50, 60), ("b", 5, 5), ("b", None, 7)]
    units = [(f"{f}{lo}-{hi}", f, lo, hi) for f in "ab" for lo in range(0, 110, 5) for hi in (lo - 7, lo, lo + 4)]
    table = spark.createDataFrame(ranges, "file string, start int, end int")
    assert sorted(tuple(r) for r in matching.merged_ranges(table).select("file", "start", "end").collect()) == [("a", 0, 31), ("a", 50, 60), ("b", 5, 5)]
    got = {r.id for r in matching.overlapping(spark.createDataFrame(units, "id string, file string, lo int, hi int"), table).collect()}
    assert got == {i for i, f, lo, hi in units if any(f == g and s is not None and lo <= e and hi >= s for g, s, e in ranges)}
