"""What is worked out once and not for each pair."""

import ast
import textwrap

from pyspark.sql import functions as F

from sieveworks.functions import texts
from sieveworks.operators import code, matching, reports, resolve, units
from sieveworks.plans.queries import QUERIES
from sieveworks.tables import numbered


def test_versions_are_read_before_packages_meet_advisories(spark):
    packages = spark.createDataFrame([("PyPI", "a_b", "1.2"), ("pypi", "a-b", "3"), ("pypi", "a-b", "none")], "ecosystem string, name string, version string")
    advisories = spark.createDataFrame([("X", "PyPI", "A.B", [], [("1", "2.0", None)])], "id string, ecosystem string, package string, cwe_ids array<int>, affected_ranges array<struct<introduced: string, fixed: string, last_affected: string>>")
    found = matching.advisory_matches(packages, advisories)
    assert sorted((r.version, r.affected) for r in found.collect()) == [("1.2", True), ("none", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join Inner")[0] + plan.split("Join Inner")[1].split("\n")[0]
    assert "exists(" in above and "regexp_extract_all" not in above


def test_calls_of_a_common_name_are_listed_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CALLS_A_LIST", 2)
    calls = spark.createDataFrame([(f"c{k}", "common", "ambiguous", [], "common") for k in range(60)] + [("c", "x.y", "no_type", ["T"], None), ("d", "lone", "unresolved", [], "lone")], "caller string, callee_name string, reason string, candidates array<string>, open_name string")
    named = spark.createDataFrame([("common", "b"), ("common", "a"), ("other", "o")], "name string, id string")
    found = resolve.with_candidates(resolve.CallGraph(None, calls, named)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.caller, list(r.candidates)) for r in found) == sorted([(f"c{k}", ["a", "b"]) for k in range(60)] + [("c", ["T"]), ("d", [])])
    assert len({r.task for r in found if r.callee_name == "common"}) > 4


def test_a_file_is_parsed_once(monkeypatch):
    """Functions, calls and imports come from one tree; a function's text is parsed by itself only where it may not parse to the same."""
    parsed = []
    real = ast.parse
    monkeypatch.setattr(ast, "parse", lambda text, *a, **b: parsed.append(text) or real(text, *a, **b))
    text = "from a import b\nimport c as b\n\nclass A:\n    @p(1)\n    def f(self):\n        def g():\n            k()\n        x = B()\n        x.m(self.g(h(1)))\n\nasync def z(q=w()):\n    return [y() for y in u() if v(y)]\n"
    rows = list(code._all_of("m.py", text))
    assert parsed == [text]
    calls = {(r["call"]["caller"], r["call"]["kind"], r["call"]["name"], *r["call"]["types"]) for r in rows if r["what"] == "call"}
    assert calls == {
        *((f"m.py:A.f{g}", "name", "k") for g in ("", ".g")), ("m.py:A.f", "name", "p"), ("m.py:A.f", "name", "B"), ("m.py:A.f", "name", "h"), ("m.py:A.f", "attribute", "m", "B"), ("m.py:A.f", "own", "g"), *(("m.py:z", "name", n) for n in "wyuv"),
    }
    assert [(r["import"]["name"], r["import"]["target"]) for r in rows if r["what"] == "import"] == [("b", "c")]


def test_texts_that_do_not_parse_alone_are_parsed_alone():
    """A text whose lines aren't all as far in as its first, that ends in a line's continuation, or that begins inside its decorator, isn't that of the file's tree."""
    for text in (
        "class A:\n  def f(self):\n    x = '''\na'''\n    g(x)\n", "class A:\n  def f(self):\n    # c\n# low\n    g()\n", "def f():\n    return g() \\\n\n", "class A:\n  @(\n  b)\n  def f(self): self.g()\n", "class A:\n\tdef f(self):\n\t\tg()\n",
        "class A:\n  def f(self):\n    x = '''\n\xa0\n'''\n    g()\n", "def f():\n  g()\r  h()\n", "\ufeffdef f():\n g()\n", "@(\na)\ndef f():\n  g()\n",
    ):
        rows = list(code._all_of("m.py", text))
        for f in (r["function"] for r in rows if r["what"] == "function"):
            again = list(code._calls_of(f["id"], "m.py", f["class_name"], f["code"]))
            assert [r["call"] for r in rows if r["what"] == "call" and r["call"]["caller"] == f["id"]] == again, text
            assert any(c["kind"] == "parse_failure" for c in again) == (code._tree(textwrap.dedent(f["code"])) is None)


def test_import_paths_are_looked_up_once(spark):
    """What no file has is known from one stored table, not by the search again for each step behind it."""
    functions = spark.createDataFrame([("a/b.py:f", "f", "a/b.py"), ("x/mod.py:g", "g", "x/mod.py")], "id string, name string, file_path string")
    asks = spark.createDataFrame([("a.b", "f"), ("mod.g", "h"), ("no.where", "z")], "target string, name string")
    found = resolve.resolved_targets(asks, functions)
    assert sorted(map(tuple, found.collect())) == [("a.b", "f", "a/b.py:f"), ("mod.g", "h", "x/mod.py:g")]
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_marks_of_a_diff_are_worked_out_once(spark):
    """Callers and the result read the marks from a table; ranges don't meet units again for each."""
    units = spark.createDataFrame([("a:f", "a", 1, 5, ["a:g"]), ("a:g", "a", 7, 9, []), ("a:h", "a", None, None, []), ("b:k", "b", 1, 2, ["a:h", "a:g"]), ("b:m", "b", 5, 9, ["b:k"])], "id string, file string, lo int, hi int, direct_calls array<string>")
    manifest = spark.createDataFrame([("a", 8, 8), ("a", 8, 20)], "file string, start int, end int")
    found = matching.diff_selection(units, manifest, "callers")
    assert {r.id: r.diff_reason for r in found.collect()} == {"a:f": "caller", "a:g": "changed", "a:h": "fallback", "b:k": "caller", "b:m": None}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_a_reports_card_needs_no_numbers(spark, sf_dir):
    """Its counts come from the findings' places; nothing is sorted, numbered or written for them."""
    plan = QUERIES["report_stats"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "candidate_type" not in plan


def test_an_artifacts_findings_are_merged_once(spark, sf_dir):
    """Its checks and its lists read the findings from a table."""
    plan = QUERIES["artifact_violations"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


def test_rows_are_worked_out_once_to_be_numbered(spark):
    """A sort by ranges reads its rows twice, for the bounds and to deal them; they are a table by then."""
    seen = spark.sparkContext.accumulator(0)
    marked = F.udf(lambda k: seen.add(1) or k, "bigint").asNondeterministic()
    rows = numbered(spark.range(20, numPartitions=3).select(marked("id").alias("k")).repartition(2), [-F.col("k")])
    assert {r.k: r.number for r in rows.collect()} == {k: 20 - k for k in range(20)}
    assert seen.value == 20


def test_a_sections_rows_are_bounded(spark, monkeypatch):
    """A section of many findings is listed in several rows, in order, and what details say isn't asked for."""
    monkeypatch.setattr(reports, "PAGE", 2)
    findings = spark.createDataFrame([(f"a.py:f{k}", "candidate" if k else "error", 0, -k, "", "", ["e"]) for k in range(6)], "unit_id string, final_state string, section int, pos bigint, file string, function string, evidence_ids array<string>")
    rows = reports.placed_rows(findings)
    assert "evidence_ids" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(reports.sections(rows).collect(), key=lambda r: (r.rank, r.page))
    assert [(r.rank, r.page, r.label, r.n, r.open, [(f.in_section, f.function) for f in r.findings]) for r in found] == [
        (4, 1, "Candidate", 2, True, [(1, "f5"), (2, "f4")]), (4, 2, "Candidate", 2, True, [(3, "f3"), (4, "f2")]), (4, 3, "Candidate", 1, True, [(5, "f1")]), (7, 1, "Error", 1, False, [(1, "f0")]),
    ]


def test_a_units_neighbours_are_worked_out_once(spark):
    """Texts, files and counts of units come from one table of them; own texts come first, files by name or in the order in which they come."""
    nodes = spark.createDataFrame([(k, "function", f, f"t{k % 3}" if k else None) for k, f in enumerate(("b", "a", "c", "", None))], "id long, unit_type string, file_path string, code string")
    seen = spark.sparkContext.accumulator(0)
    marked = F.udf(lambda k: seen.add(1) or k, "bigint").asNondeterministic()
    near = spark.createDataFrame([(1, s, 1, [p], i, None, f) for s, p, i, f in (("up", 2, 0, "b"), ("up", 1, 2, "c"), ("down", 1, 4, None), ("down", 2, 3, ""), ("up", 3, 3, ""))] + [(4, "down", 1, [1], 2, None, "c")], "seed long, side string, depth int, path array<int>, id long, name string, file_path string")
    near = near.withColumn("seed", marked("seed"))
    made = {s: {r.id: (r.code.split(units.BOUNDARIES["python" if s == "python" else "javascript"]), list(r.files), r.total_up, r.total_down) for r in units.assembled(nodes, near, s).collect()} for s in ("python", "javascript", "go")}
    assert seen.value == 3 * 6
    assert made["python"][1] == (["t1", "t2", "t0"], ["a", "b", "c"], 3, 2) and made["python"][4] == (["t1", "t2"], ["c", None], 0, 1)
    assert made["javascript"][1] == (["t1", "t2", "t0"], ["a", "c", "b"], 3, 2) and made["javascript"][0] == ([""], ["b"], 0, 0)
    assert made["go"][1] == (["t1", "t2", "t0"], ["a", "c", "b"], 3, 2) and made["go"][4] == (["t1"], [None], 0, 1)


def test_ids_are_cut_at_their_last_colon(spark):
    ids = ["a:b", "a::b", ":x", "x:", ":", "none", "", "é:ü\n", "a\n:b:\r\n", "a\U0001f600:\U0001f600b", None]
    cut = spark.createDataFrame([(i,) for i in ids], "i string").select("i", texts.split_id(F.col("i")).alias("at")).collect()
    assert [(r["at"]["file"], r["at"]["function"]) for r in cut] == [tuple(r.i.rsplit(":", 1)) if r.i and ":" in r.i else ("", "") for r in cut]


def test_a_reports_tables_ask_for_no_details(spark, sf_dir):
    """Markdown shows places and states: behind the numbered findings nothing is joined to its lines."""
    for name in ("report_markdown", "report_sections"):
        assert not any("orders" in f for f in QUERIES[name](spark, sf_dir).inputFiles())
