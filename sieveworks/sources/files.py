"""Readers of stage outputs, graphs, source trees and reports, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts

STAGE1 = "unit_id string, decision string, finding_id string, candidate_type string, cwe_id string, location struct<file:string,function:string>, source string, sink string, impact string, evidence_ids array<string>"
STAGE2 = "unit_id string, finding_id string, decision string, execution_state string, evidence_ids array<string>, evidence array<struct<evidence_id:string,kind:string>>"
DYNAMIC = "unit_id string, finding_id string, decision string, execution_state string, evidence_ids array<string>"
NODE = "id string, name string, qualified_name string, file_path string, start_line int, end_line int, kind string, visibility string, is_exported boolean, package string, language string, unit_type string, code string"
EDGE = "caller string, callee string, kind string, confidence string"
UNRESOLVED = "caller string, callee_name string, reason string, candidates array<string>"
RUN = "kind string, commit string, branch string, started_at timestamp, finished_at timestamp, status string, language string, base string, scope string"
STEP = "step string, status string, timestamp string, duration_seconds double, cost_usd double, cost_currency string"
SARIF = (
    "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,"
    "region:struct<startLine:int,endLine:int>>>>>>>>"
)
MAX_FILE_BYTES, MAX_DEPTH, MAX_TEXT = 1 << 20, 32, 50_000


def read_records(spark: SparkSession, path: str, schema: str, array: str) -> DataFrame:
    """The rows of an array in whole-file JSON documents, with their position."""
    docs = spark.read.schema(f"`{array}` array<struct<{_struct(schema)}>>").json(path, multiLine=True)
    return docs.select(F.posexplode(array).alias("pos", "r")).select("pos", "r.*")


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped; a path without files gives no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # the analyser's own error for a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_checkpoints(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document a key; summaries and documents that can't be read are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.where(~F.col("_metadata.file_name").endswith("_summary.json")).where("_corrupt_record is null").drop("_corrupt_record")


# Folders that every scan leaves out, and those of a language; endings of a language's sources; names of tests.
SKIPPED_FOLDERS = ("node_modules", "vendor", "dist", "build", "target", "venv", "env", "__pycache__", "site-packages", "third_party", "coverage", "htmlcov", "eggs")
ENDINGS = {
    "python": ("py",), "c": ("c", "h", "cc", "cpp", "cxx", "hpp", "hxx", "hh"), "javascript": ("js", "jsx", "mjs", "cjs", "ts", "tsx"), "go": ("go",),
}
TESTS = {
    "python": r"(^test_.*|.*_test|^conftest)\.py$", "c": r"(^test_.*|.*_test)\.[a-z]+$", "javascript": r".*\.(test|spec)\.[a-z]+$", "go": r".*_test\.go$",
}


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of the files under a folder: their metadata alone, no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.select(F.regexp_replace("path", rf"^\w*:?/*\Q{base}\E/", "").alias("path"), F.col("length").alias("size"))


def _reason(path: Column, size: Column, language: str, with_tests: bool) -> Column:
    """Why a scan leaves a file out, null for one that it takes."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return (
        F.when(F.exists(folders, lambda p: p.startswith(".") | p.isin(*SKIPPED_FOLDERS)), "folder").when(F.size(folders) > MAX_DEPTH, "depth").when(~ending.isin(*ENDINGS[language]), "ending")
        .when(F.element_at(parts, -1).rlike(TESTS[language]) & F.lit(not with_tests), "test").when(size > MAX_FILE_BYTES, "size")
    )


def source_files(spark: SparkSession, root: str, language: str = "python", with_tests: bool = False) -> DataFrame:
    """(path, size): a language's source files under a folder, in order of their path, without hidden and generated folders, tests,
    files over 1 MiB and very deep ones.  Paths are relative to the folder.  Spark's readers list neither hidden files nor files
    without a byte."""
    rows = _listed(spark, root)
    return rows.where(_reason(F.col("path"), F.col("size"), language, with_tests).isNull()).orderBy("path")


def skipped_files(spark: SparkSession, root: str, language: str = "python", with_tests: bool = False) -> DataFrame:
    """(reason, n): how many files a scan leaves out, and why."""
    rows = _listed(spark, root)
    return rows.select(_reason(F.col("path"), F.col("size"), language, with_tests).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def with_supplement(files: DataFrame, more: DataFrame) -> DataFrame:
    """The files and those listed elsewhere, each path once, the first ones first."""
    both = files.withColumn("_o", F.lit(0)).unionByName(more.withColumn("_o", F.lit(1)))
    rest = [c for c in files.columns if c != "path"]
    return both.groupBy("path").agg(F.min_by(F.struct(*rest), "_o").alias("r")).select("path", "r.*")


def whole_texts(spark: SparkSession, root: str, language: str = "python") -> DataFrame:
    """(path, text) of the source files of at most MAX_TEXT characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(ENDINGS[language]) + "}").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rows = files.where(F.col("length") <= MAX_FILE_BYTES).select(F.regexp_replace("path", rf"^\w*:?/*\Q{base}\E/", "").alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(_reason(F.col("path"), F.col("size"), language, False).isNull() & (F.length("text") <= MAX_TEXT)).select("path", "text")


def limited_text(text: Column, characters: int) -> Column:
    """A text's first characters; null is empty."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(characters))


def file_lines(files: DataFrame, first: int, last: int) -> DataFrame:
    """(path, text): lines first..last of each file, from 1, ends included; paths that lead out of the folder are left out."""
    lines = F.split("text", "\n")
    files = files.where(~texts.is_unsafe_path(F.col("path")))
    return files.select("path", F.array_join(F.slice(lines, max(first, 1), max(0, last - max(first, 1) + 1)), "\n").alias("text"))


def sarif_findings(spark: SparkSession, path: str) -> DataFrame:
    """(rule, level, message, file, start, end): a row for each location of each result."""
    rows = spark.read.schema(SARIF).json(path, multiLine=True).select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    at = rows.select("r.ruleId", "r.level", "r.message.text", F.explode_outer("r.locations").alias("l"))
    start = F.coalesce("l.physicalLocation.region.startLine", F.lit(0))
    return at.select(
        F.coalesce("ruleId", F.lit("unknown")).alias("rule"), F.coalesce("level", F.lit("warning")).alias("level"), F.coalesce("text", F.lit("")).alias("message"),
        F.coalesce("l.physicalLocation.artifactLocation.uri", F.lit("")).alias("file"), start.alias("start"), F.coalesce("l.physicalLocation.region.endLine", start).alias("end"),
    )


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each run's meta.json in its own folder, with the folder's name as `run`."""
    rows = spark.read.schema(RUN).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(folder)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The step reports of a folder (*.report.json); what can't be read is left out."""
    rows = spark.read.schema(f"{STEP}, _corrupt_record string").option("multiLine", True).option("pathGlobFilter", "*.report.json").json(folder)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positives, negatives): the unit ids that a truth file lists as vulnerable and as safe."""
    rows = spark.read.schema("true_positives array<string>, true_negatives array<string>").json(path, multiLine=True)
    return tuple(rows.select(F.explode(c).alias("unit_id")) for c in ("true_positives", "true_negatives"))


ADVISORY = "id string, ecosystem string, package string, cwe_ids array<string>, affected_ranges array<struct<introduced:string,fixed:string,last_affected:string>>"


def read_advisories(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The advisories of caches, in their order: each a list, or an object with a list of advisories; see packages.advisories."""
    from ..operators.packages import advisories

    rows = None
    item = "struct<" + ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in ADVISORY.split(", ")) + ">"
    for k, path in enumerate(paths):
        raw = spark.read.text(path, wholetext=True)
        held = F.coalesce(F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<{item}>")), F.from_json("value", f"advisories array<{item}>")["advisories"])
        own = raw.select(F.posexplode(held).alias("at", "a")).select((F.lit(k).cast("bigint") * (1 << 40) + F.col("at")).alias("pos"), "a.*")
        rows = own if rows is None else rows.unionByName(own)
    return advisories(rows)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(repo, file, text) of package manifests in the folders under a root; a repository is a folder."""
    from ..operators.packages import MANIFESTS

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(MANIFESTS) + "}").load(root)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("repo"), F.element_at(parts, -1).alias("file"), F.decode("content", "UTF-8").alias("text"))


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Writes a call graph's tables (nodes, edges, unresolved, roots), each to a folder of its own."""
    for name in ("nodes", "edges", "unresolved", "roots"):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, legacy: DataFrame | None = None) -> dict[str, DataFrame]:
    """A call graph's tables.  legacy: the edges (caller, callee) of an older export of the same graph, if there is one: the two
    must have the same set of edges, since it can't be told which is right."""
    from ..operators.matching import same_edges

    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "unresolved", "roots")}
    missing = {"nodes": {"id"}, "edges": {"caller", "callee", "confidence"}, "unresolved": {"caller", "callee_name", "candidates"}, "roots": {"id"}}
    for name, wanted in missing.items():
        if lost := wanted - set(tables[name].columns):
            raise ValueError(f"the graph's {name} lack {sorted(lost)}")
    if legacy is not None and not same_edges(tables["edges"], legacy):
        raise ValueError("the graph and its older export have different edges")
    return tables


def diff_hunks(diff_lines: DataFrame) -> DataFrame:
    """(file, start, end) of `@@` header lines (file, line); hunks without new lines go."""
    return diff_lines.select("file", texts.hunk_range(F.col("line")).alias("h")).where("h is not null").select("file", "h.*")


def manifest_ranges(manifest: DataFrame) -> DataFrame:
    """(file, start, end) of a manifest's changed_files and hunks; a file without hunks has nulls."""
    files = manifest.select("hunks", F.explode("changed_files").alias("file"))
    return files.select("file", F.explode_outer(F.element_at("hunks", F.col("file"))).alias("h")).select("file", F.get("h", F.lit(0)).alias("start"), F.get("h", F.lit(1)).alias("end"))


def write_report(rows: DataFrame, path: str) -> None:
    """CSV with a header, in report order; arrays are joined by semicolons."""
    flat = [F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    rows.orderBy("rank", "section", "pos").select(*flat).drop("rank", "section", "pos").write.mode("overwrite").option("header", True).option("escape", "\"").option("emptyValue", "").csv(path)


def write_with_manifest(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as JSON lines, and returns (table, file, sha256) of what was written."""
    spark, rows = next(iter(tables.values())).sparkSession, None
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{name}")
        own = files.select(F.lit(name).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
        rows = own if rows is None else rows.unionAll(own)
    return rows


def manifest_errors(said: DataFrame, found: DataFrame) -> DataFrame:
    """(table, file) whose hash differs or is missing on either side."""
    both = said.join(found.withColumnRenamed("sha256", "now"), ["table", "file"], "full_outer")
    return both.where(~F.col("sha256").eqNullSafe(F.col("now"))).select("table", "file")


def appended(manifest: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The manifest with the new rows that it hasn't yet."""
    return manifest.unionByName(new.join(manifest.select(*keys), keys, "left_anti"))
