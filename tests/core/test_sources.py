"""Sources, sinks and streams, each written to a folder and read back."""

import json

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import reports
from sieveworks.sources import files, published
from sieveworks.streaming import live


def tree(root, **texts):
    for path, text in texts.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_source_files(spark, tmp_path):
    deep = "/".join("d" * 1 for _ in range(34))
    tree(tmp_path, **{"a.py": "x", "src/b.py": "y" * 9, "src/test_b.py": "t", "node_modules/c.py": "t", ".git/d.py": "t", "e.txt": "t", "big.py": "z" * (files.MAX_FILE_BYTES + 1), f"{deep}/f.py": "t", "g.go": "t", "g_test.go": "t", "h.spec.ts": "t", "h.ts": "t", "i.hpp": "t", "none.py": ""})
    got = [tuple(r) for r in files.source_files(spark, str(tmp_path)).collect()]
    assert got == [("a.py", 1), ("src/b.py", 9)]
    assert {r.reason: r.n for r in files.skipped_files(spark, str(tmp_path)).collect()} == {"test": 1, "folder": 1, "ending": 6, "size": 1, "depth": 1}
    for language, want in (("go", ["g.go"]), ("javascript", ["h.ts"]), ("c", ["i.hpp"])):
        assert [r.path for r in files.source_files(spark, str(tmp_path), language).collect()] == want
    assert {r.path for r in files.source_files(spark, str(tmp_path), with_tests=True).collect()} == {"a.py", "src/b.py", "src/test_b.py"}
    assert {(r.path, r.text) for r in files.whole_texts(spark, str(tmp_path)).collect()} == {("a.py", "x"), ("src/b.py", "y" * 9)}
    more = spark.createDataFrame([("a.py", 99), ("extra.py", 3)], "path string, size bigint")
    assert {tuple(r) for r in files.with_supplement(files.source_files(spark, str(tmp_path)), more).collect()} == {("a.py", 1), ("src/b.py", 9), ("extra.py", 3)}


def test_records_lines_and_checkpoints(spark, tmp_path):
    tree(tmp_path, **{"stage1.json": json.dumps({"results": [{"unit_id": "u1", "decision": "candidate", "evidence_ids": ["e"]}, {"unit_id": "u2"}]}, indent=2), "l/x.jsonl": '{"unit_id": "a"}\n\n{"unit_id": "b"}\n', "c/u1.json": '{"unit_id": "u1"}', "c/u2.json": "{broken", "c/_summary.json": '{"unit_id": "no"}', "c/x_summary.json": '{"unit_id": "no"}'})
    assert [(r.pos, r.unit_id, r.decision) for r in files.read_records(spark, f"{tmp_path}/stage1.json", files.STAGE1, "results").collect()] == [(0, "u1", "candidate"), (1, "u2", None)]
    assert sorted(r.unit_id for r in files.read_lines(spark, f"{tmp_path}/l", "unit_id string").collect()) == ["a", "b"]
    assert files.read_lines(spark, f"{tmp_path}/nothing", "unit_id string").count() == 0
    assert [r.unit_id for r in files.read_checkpoints(spark, f"{tmp_path}/c", "unit_id string").collect()] == ["u1"]


def test_sarif(spark, tmp_path):
    at = {"physicalLocation": {"artifactLocation": {"uri": "a.js"}, "region": {"startLine": 3, "endLine": 5}}}
    run = {"results": [{"ruleId": "r1", "level": "error", "message": {"text": "m"}, "locations": [at, {"physicalLocation": {"artifactLocation": {"uri": "b.js"}, "region": {"startLine": 7}}}]}, {"locations": []}]}
    tree(tmp_path, **{"s.sarif": json.dumps({"runs": [run]})})
    assert sorted(tuple(r) for r in files.sarif_findings(spark, f"{tmp_path}/s.sarif").collect()) == [("r1", "error", "m", "a.js", 3, 5), ("r1", "error", "m", "b.js", 7, 7), ("unknown", "warning", "", "", 0, 0)]


def test_runs_steps_truth_advisories_manifests(spark, tmp_path):
    tree(tmp_path, **{
        "runs/r1/meta.json": '{"commit": "c1", "status": "success", "started_at": "2024-01-01T00:00:00Z"}', "runs/r2/meta.json": '{"commit": "c2", "status": "failed", "started_at": "2024-02-01T00:00:00Z"}',
        "steps/a.report.json": '{"step": "parse", "timestamp": "2", "duration_seconds": 1.5, "cost_usd": 0.5}', "steps/b.report.json": '{"step": "detect", "timestamp": "1", "duration_seconds": 70}', "steps/c.report.json": "{no", "steps/d.json": "{}",
        "truth.json": '{"true_positives": ["a", "b"], "true_negatives": ["c"]}', "adv1.json": '[{"id": "A1", "ecosystem": "npm", "package": "p"}, {"id": "A2", "package": "q"}]', "adv2.json": '{"advisories": [{"id": "A1", "ecosystem": "npm", "package": "p2"}]}',
        "repos/one/package.json": '{"name": "n", "version": "1"}', "repos/two/go.mod": "module m/x\n", "repos/two/README.md": "",
    })
    runs = files.read_runs(spark, f"{tmp_path}/runs")
    assert {(r.run, r.commit) for r in runs.collect()} == {("r1", "c1"), ("r2", "c2")}
    steps = files.read_steps(spark, f"{tmp_path}/steps")
    assert [(r.step, r.duration, r.cost, r.status) for r in reports.step_rows(steps).collect()] == [("detect", "1m 10s", "$0.0000", "unknown"), ("parse", "1.5s", "$0.50", "unknown")]
    assert tuple(reports.step_totals(steps).first()) == (71.5, 0.5)
    good, bad = files.read_ground_truth(spark, f"{tmp_path}/truth.json")
    assert [r.unit_id for r in good.collect()] == ["a", "b"] and [r.unit_id for r in bad.collect()] == ["c"]
    assert [(r.id, r.package) for r in files.read_advisories(spark, [f"{tmp_path}/adv1.json", f"{tmp_path}/adv2.json"]).collect()] == [("A1", "p2")]
    assert sorted((r.repo, r.file) for r in files.read_manifests(spark, f"{tmp_path}/repos").collect()) == [("one", "package.json"), ("two", "go.mod")]
    units = spark.createDataFrame([("f.py:a", "f.py", 1, 5, []), ("g.py:b", "g.py", 1, 5, [])], "id string, file string, lo int, hi int, direct_calls array<string>")
    asked = []
    hunks = lambda c: asked.append(c) or spark.createDataFrame([("f.py", 2, 3)], "file string, start int, end int")
    assert {r.id: r.diff_selected for r in reports.incremental(units, runs, hunks).collect()} == {"f.py:a": True, "g.py:b": False} and asked == ["c1"]
    assert all(r.diff_selected for r in reports.incremental(units, runs.limit(0), hunks).collect())


def test_line_ranges(spark):
    rows = spark.createDataFrame([("a.py", "1\n2\n3\n4"), ("../x", "1\n2"), ("/etc/x", "1\n2"), ("b", "")], "path string, text string")
    assert {(r.path, r.text) for r in files.file_lines(rows, 2, 3).collect()} == {("a.py", "2\n3"), ("b", "")}
    assert files.file_lines(rows, 0, 1).where("path = 'a.py'").first().text == "1" and files.file_lines(rows, 9, 12).where("path = 'a.py'").first().text == ""
    assert rows.select(files.limited_text(F.col("text"), 3)).first()[0] == "1\n2"


def test_report_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0, 1, "b", ["x", "y"]), (1, 0, 2, "a,\"q\"", []), (1, 0, 1, "c", ["z"])], "rank int, section int, pos int, unit_id string, evidence_ids array<string>")
    files.write_report(rows, f"{tmp_path}/r")
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/r").collect()] == [("c", "z"), ('a,"q"', None), ("b", "x;y")]
    said = spark.createDataFrame(files.write_with_manifest({"t": rows}, f"{tmp_path}/m").collect())
    assert files.manifest_errors(said, said).count() == 0
    assert files.manifest_errors(said, said.withColumn("sha256", F.lit("0"))).count() == said.count() > 0
    assert files.appended(said, said.union(spark.createDataFrame([("v", "f", "h")], said.schema)), ["table", "file"]).count() == said.count() + 1
    with pytest.raises(ValueError):
        reports.gate(spark.createDataFrame([("bad", 2)], "rule string, n bigint"))
    reports.gate(spark.createDataFrame([], "rule string, n bigint"))


def test_graph_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "exact"), ("a", "b", "low")], "caller string, callee string, confidence string")
    tables = {"nodes": spark.createDataFrame([("a",), ("b",)], "id string"), "edges": edges, "unresolved": spark.createDataFrame([], "caller string, callee_name string, candidates array<string>"), "roots": spark.createDataFrame([("a",)], "id string")}
    files.write_graph(tables, f"{tmp_path}/g")
    assert files.read_graph(spark, f"{tmp_path}/g", edges.limit(1))["edges"].count() == 2
    with pytest.raises(ValueError, match="different edges"):
        files.read_graph(spark, f"{tmp_path}/g", edges.limit(0))
    files.write_graph(tables | {"nodes": tables["nodes"].withColumnRenamed("id", "key")}, f"{tmp_path}/h")
    with pytest.raises(ValueError, match="nodes lack"):
        files.read_graph(spark, f"{tmp_path}/h")


def events(spark, tmp_path, *parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "id string, fingerprint string, status string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema("id string, fingerprint string, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drained(df, mode, tmp_path, name):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    import datetime as d

    at = lambda m: d.datetime(2024, 1, 1, 0, 0) + d.timedelta(minutes=m)
    one, two = [("a", "1", "ok", at(0)), ("b", "1", "error", at(5)), ("a", "1", "ok", at(6))], [("a", "1", "ok", at(7)), ("b", "2", "ok", at(200)), ("c", "1", "ok", at(400))]
    stream = events(spark, tmp_path, one, two)
    assert sorted((r.id, r.fingerprint) for r in drained(live.first_results(stream, ["id", "fingerprint"], "ts"), "append", tmp_path, "firsts").collect()) == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]
    assert {r.id: (r.results, r.errors) for r in drained(live.running_counts(stream, ["id"]), "complete", tmp_path, "counts").collect()} == {"a": (3, 0), "b": (2, 1), "c": (1, 0)}
    windows = drained(live.windowed_counts(stream, "ts", ["id"]), "append", tmp_path, "windows").collect()
    assert {(r.id, r.results) for r in windows} >= {("a", 3), ("b", 1)}
    # the second run has a checkpoint of its own and counts its batches from 0: nothing is lost, and older rows don't win
    store = published.KeyedStore(spark, f"{tmp_path}/out", buckets=4)
    for checkpoint in ("cp", "cp", "cp2"):
        live.upsert_batches(stream, store, f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        assert {r.id: (r.fingerprint, r.status) for r in store.read().collect()} == {"a": ("1", "ok"), "b": ("2", "ok"), "c": ("1", "ok")}
    spark.createDataFrame([("d", "9", "ok", at(1))], "id string, fingerprint string, status string, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
    live.upsert_batches(stream, store, f"{tmp_path}/cp3").trigger(availableNow=True).start().awaitTermination()
    assert {r.id for r in store.read().collect()} == {"a", "b", "c", "d"}


def test_keyed_store(spark, tmp_path):
    """Only touched buckets are written; a batch counts once; replaced folders go when they are cleaned."""
    table = lambda rows: spark.createDataFrame(rows, "id bigint, v string, ts bigint")
    store = published.KeyedStore(spark, f"file://{tmp_path}/s", buckets=8)
    assert store.read() is None and store.cleaned() == 0
    first = store.upsert(table([(k, "a", 1) for k in range(200)] + [(None, "null", 1)]), "s1", 0)
    assert first == list(range(8)) and store.read().count() == 201
    before = store.read()
    touched = store.upsert(table([(3, "b", 2), (3, "c", 3), (4, "old", 0), (None, "null2", 1)]), "s1", 1)
    assert len(touched) <= 3 and before.where("id = 3").first().v == "a"  # who began to read goes on with the old rows
    now = {r.id: r.v for r in store.read().collect()}
    assert now[3] == "c" and now[4] == "a" and now[None] == "null2" and len(now) == 201
    assert store.upsert(table([(3, "again", 9)]), "s1", 1) == [] and store.upsert(table([(3, "other", 9)]), "s2", 0) != [] and store.read().where("id = 3").first().v == "other"
    assert published.KeyedStore(spark, f"file://{tmp_path}/s", buckets=99).buckets == 8 and store.upsert(table([])) == []
    assert store.cleaned() > 0 and store.cleaned() == 0 and store.read().count() == 201


def test_published_artifacts(spark, tmp_path):
    """What doesn't hold never replaces what does; a changed file is found."""
    table = lambda rows: spark.createDataFrame(rows, "id bigint, v string")
    path, seen = f"file://{tmp_path}/a", []

    def check(tables):
        seen.append(tables["t"].count())
        return tables["t"].where("v is null").agg(F.count("*").alias("n")).select(F.lit("null_value").alias("rule"), "n")

    said = spark.createDataFrame([("u", "f", "1")], "table string, file string, sha256 string")
    assert published.published(spark, path) is None
    assert published.publish({"t": table([(1, None)]), "e": table([])}, path, [check]) == [("null_value", 1)] and published.published(spark, path) is None
    assert published.publish({"t": table([(1, "a")]), "e": table([])}, path, [check], (said, said)) == []
    old = published.published(spark, path)
    assert published.publish({"t": table([(2, None), (3, None)])}, path, [check], (said, said.withColumn("sha256", F.lit("2")))) == [("null_value", 2), ("upstream_hash", 1)]
    again = published.published(spark, path)
    assert again.folder == old.folder and [tuple(r) for r in again.tables["t"].collect()] == [(1, "a")] and again.tables["e"].count() == 0
    assert len(list((tmp_path / "a").glob("version-*"))) == 1 and seen == [1, 1, 2]
    assert published.publish({"t": table([(2, "b")])}, path, [check]) == []
    new = published.published(spark, path)
    assert new.tables["t"].first().v == "b" and old.tables["t"].first().v == "a" and set(new.tables) == {"t"} and not list((tmp_path / "a").glob("draft-*"))
    file, *_ = [f for f in (tmp_path / "a" / new.folder.rsplit("/", 1)[1] / "t").glob("part-*") if f.stat().st_size]
    file.write_bytes(file.read_bytes() + b" ")
    (file.parent / f".{file.name}.crc").unlink()  # else the file system finds the change first
    with pytest.raises(ValueError, match="differ from its manifest"):
        published.published(spark, path)
