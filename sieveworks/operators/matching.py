"""Joins on ranges, names, evidence and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..tables import stored

#: lines that one bucket of a file covers in range joins, and lines of a coarse one, for very long ranges
BUCKET, COARSE = 256, 1 << 16


def _dealt(rows: DataFrame, lo: str, hi: str, keep: list[str]) -> DataFrame:
    """The rows with the buckets (level, b) of their lines: fine ones of a short range, coarse ones of a long
    one, and, so that the two meet, the coarse ones of a short range too (own false)."""
    low, high = F.least(lo, hi), F.greatest(lo, hi)
    buckets = lambda size: F.sequence(F.floor(low / size).cast("bigint"), F.floor(high / size).cast("bigint"))
    made = lambda size, level, own: F.transform(buckets(size), lambda b: F.struct(F.lit(level).alias("level"), b.alias("b"), F.lit(own).alias("own")))
    short = high - low < COARSE
    every = F.when(short, F.concat(made(BUCKET, 0, True), made(COARSE, 1, False))).otherwise(made(COARSE, 1, True))
    return rows.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*keep, F.explode(every).alias("_d")).select(*keep, "_d.*")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """The ranges (file, start, end; ends included) with those that overlap made one; a line is in some range before exactly if it is in one after."""
    before = Window.partitionBy("file").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    marked = ranges.where("start <= end").select("file", "start", "end").distinct().withColumn("fresh", fresh.cast("int"))
    return marked.withColumn("run", F.sum("fresh").over(upto)).groupBy("file", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def overlapping(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """The units (id, file, lo, hi; ends included) that meet any range (file, start, end).

    Both sides are dealt to buckets of lines, so a large file isn't one task and each pair meets
    in a bucket of either.  A file's ranges that overlap are one, so that a unit meets few, however many there are; ranges and units whose
    ends are the wrong way round are compared as they stand.  Units or ranges without both lines meet nothing."""
    return units.join(_overlapping_ids(units, ranges), "id", "left_semi")


def _overlapping_ids(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """The different ids of these units."""

    def met(units, ranges):
        left = _dealt(units, "lo", "hi", ["id", "file", "lo", "hi"])
        right = _dealt(ranges, "start", "end", ["file", "start", "end"]).withColumnRenamed("own", "own_too")
        return left.join(right, ["file", "level", "b"]).where("lo <= end and hi >= start and (own or own_too)").select("id")

    every = ranges.select("file", "start", "end").distinct()
    found = met(units.where("lo <= hi"), merged_ranges(every).unionByName(every.where("start > end"))).unionAll(met(units.where("lo > hi"), every))
    return found.distinct()


def file_matches(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): of each distinct path the first file (by pos) that it ends in, or that ends in it.

    Each side's endings are joined with the other side's whole names, so no path is compared with every
    file; paths and files are distinct ones, not findings and functions."""
    endings = lambda c: F.explode(F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda k: F.substr(F.col(c), k)), F.lit("")))
    paths = paths.select("path").distinct()
    one = paths.select("path", endings("path").alias("file")).join(files, "file")
    two = files.select("file", "pos", endings("file").alias("path")).join(paths, "path")
    both = one.select("path", "file", "pos").unionAll(two.select("path", "file", "pos"))
    return both.groupBy("path").agg(F.min_by("file", F.struct("pos", "file")).alias("file"))


def containing(points: DataFrame, functions: DataFrame) -> DataFrame:
    """(point_id, id): findings (point_id, path, start, end) with functions (id, file, lo, hi, pos) of
    the file that their path matches, either end of the finding inside the function.

    Of several files that match, that of the first function counts (see file_matches).  A finding that
    strictly contains a function has no end inside and doesn't match."""
    files = functions.groupBy("file").agg(F.min("pos").alias("pos"))
    found = points.join(file_matches(points, files), "path")
    ends = found.select("point_id", "file", F.explode(F.array_distinct(F.array("start", "end"))).alias("line"))
    left = _dealt(functions, "lo", "hi", ["id", "file", "lo", "hi"]).where("own")
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("line") / size).cast("bigint").alias("b")) for k, size in enumerate((BUCKET, COARSE)))))
    dealt = ends.select("point_id", "file", "line", level.alias("_d")).select("point_id", "file", "line", "_d.*")
    return dealt.join(left, ["file", "level", "b"]).where("line between lo and hi").select("point_id", "id").distinct()


def diff_units(units: DataFrame) -> DataFrame:
    """(id, file, lo, hi, direct_calls) of parsers' units, which tell their place in one of several ways.

    The file is that of code.primary_origin, else of primary_origin, else what the id has before its
    last colon; the lines are those of the first of code.primary_origin, primary_origin and metadata
    that has both; calls are metadata.direct_calls, or directCalls.  Columns that a table lacks
    are skipped."""
    has = lambda path: _has_field(units, path)
    origins = [o for o in ("code.primary_origin", "primary_origin") if has(o)]
    named = [F.nullif(F.col(f"{o}.file_path"), F.lit("")) for o in origins if has(f"{o}.file_path")]
    by_id = F.when(F.col("id").contains(":"), F.regexp_extract("id", r"(?s)^(.*):", 1))
    lines = [F.when(F.col(f"{o}.start_line").isNotNull() & F.col(f"{o}.end_line").isNotNull(), F.struct(F.col(f"{o}.start_line").alias("lo"), F.col(f"{o}.end_line").alias("hi"))) for o in [*origins, "metadata"] if has(f"{o}.start_line") and has(f"{o}.end_line")]
    span = F.coalesce(*lines) if lines else F.struct(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    calls = [F.col(f"metadata.{c}") for c in ("direct_calls", "directCalls") if has(f"metadata.{c}")]
    none = F.array().cast("array<string>")
    return units.select("id", texts.diff_path(F.coalesce(*named, by_id)).alias("file"), span["lo"].alias("lo"), span["hi"].alias("hi"), F.coalesce(*calls, none).alias("direct_calls"))


def _has_field(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for name in path.split("."):
        if not hasattr(kind, "fieldNames") or name not in kind.fieldNames():
            return False
        kind = kind[name].dataType
    return True


def diff_selection(units: DataFrame, manifest: DataFrame, scope: str = "changed_functions") -> DataFrame:
    """The units with diff_selected and diff_reason (changed, fallback, caller), for a scope.

    units: id, file, lo, hi, direct_calls (see diff_units); manifest: file, start, end, a row with
    nulls for a changed file without hunks.  changed_files takes all units of the files;
    changed_functions those that meet a hunk, and, since no change may be lost, those of changed files
    that have no lines (fallback); callers also those that call one of these directly."""
    if scope not in ("changed_files", "changed_functions", "callers"):
        raise ValueError(f"unknown scope {scope!r}")
    from .graph import one_hop_callers

    by_id = F.when(F.col("id").contains(":"), F.regexp_extract("id", r"(?s)^(.*):", 1))
    clean = units.withColumn("file", texts.diff_path(F.coalesce(F.nullif("file", F.lit("")), by_id)))
    changed = manifest.withColumn("file", texts.diff_path(F.col("file")))
    in_files = clean.join(changed.select("file").distinct(), "file", "left_semi")
    reason = lambda rows, why: rows.select("id", F.lit(why).alias("diff_reason"))
    if scope == "changed_files":
        marked = reason(in_files, "changed")
    else:
        blind = in_files.where("lo is null or hi is null")
        marked = reason(blind, "fallback").unionAll(reason(_overlapping_ids(clean.select("id", "file", "lo", "hi"), changed.select("file", "start", "end")), "changed"))
    if scope == "callers":
        marked = stored(marked)  # three steps read it: whom they call, who they are, and the result
        marked = marked.unionAll(reason(one_hop_callers(clean, marked.select("id")), "caller"))
    return units.join(marked, "id", "left").withColumn("diff_selected", F.col("diff_reason").isNotNull())


def diff_statistics(marked: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of what diff_selection marked: total, selected, fallback, callers_added, changed_files."""
    count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    why = F.col("diff_reason")
    row = marked.agg(F.count("*").alias("total"), count(F.col("diff_selected"), "selected"), count(why == "fallback", "fallback"), count(why == "caller", "callers_added"))
    return row.crossJoin(manifest.agg(F.count_distinct(texts.diff_path(F.col("file"))).alias("changed_files")))  # two single rows


def selected_only(units: DataFrame) -> DataFrame:
    """The units that a diff selected, where there was a diff at all."""
    return units.where("diff_selected") if "diff_selected" in units.columns else units


def caller_callee_merged(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """The findings without those that their only caller's finding covers; callers get the ids.

    findings: id, finding_id, source, sink, evidence_ids.  A callee merges if exactly one edge
    row points to it, both have the same source and sink, neither empty, and they share an
    evidence id.  Merging is one hop: of a chain, each link is judged alone, and what merged
    into a removed finding goes with it.  Adds merged_from, merged_finding_ids."""
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda e: F.coalesce(e != "", F.lit(False)))
    clean = findings.withColumn("evidence_ids", F.array_distinct(filled(F.col("evidence_ids"))))
    only = edges.groupBy(F.col("callee").alias("id")).agg(F.count("*").alias("n"), F.min("caller").alias("caller")).where("n = 1").drop("n")
    small = clean.where("source <> '' and sink <> ''").select("id", "finding_id", "source", "sink", "evidence_ids")
    callers = small.select(F.col("id").alias("caller"), "source", "sink", F.col("evidence_ids").alias("caller_evidence"))
    merges = small.join(only, "id").where("id <> caller").join(callers, ["caller", "source", "sink"]).where(F.arrays_overlap("evidence_ids", "caller_evidence"))
    taken = merges.groupBy("caller").agg(
        F.array_sort(F.collect_list("id")).alias("merged_from"), F.array_sort(F.collect_set("finding_id")).alias("_findings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("_evidence")
    )
    kept = clean.join(merges.select("id"), "id", "left_anti").join(taken.withColumnRenamed("caller", "id"), "id", "left")
    has = F.col("merged_from").isNotNull()
    every = F.array_sort(F.array_union("evidence_ids", F.coalesce("_evidence", F.array().cast("array<string>"))))
    return kept.withColumn("evidence_ids", F.when(has, every).otherwise(F.array_sort("evidence_ids"))).withColumn("merged_finding_ids", F.when(has, F.array_sort(F.array_union("_findings", F.array("finding_id"))))).drop("_findings", "_evidence")


def evidence_index(evidence: DataFrame) -> DataFrame:
    """(evidence_id, content, content_key): the first row of each id (by pos); rows without an id go."""
    keyed = evidence.where("evidence_id <> ''").withColumn("content_key", texts.content_key(F.col("content"), F.col("content_hash")))
    first = keyed.groupBy("evidence_id").agg(F.min(F.struct("pos", "content_key", "content")).alias("f"))
    return first.select("evidence_id", "f.content", "f.content_key")


def evidence_errors(evidence: DataFrame) -> DataFrame:
    """(evidence_id, rule, n): missing ids, declared hashes that are none or don't fit, ids with several contents."""
    real, said = F.sha2(F.col("content").cast("binary"), 256), F.lower("content_hash")
    is_hash = said.rlike("^[0-9a-f]{64}$")
    row_rules = {"missing_id": F.coalesce(F.col("evidence_id") == "", F.lit(True)), "bad_hash": F.coalesce(~is_hash, F.lit(False)), "hash_mismatch": F.coalesce(is_hash & (said != real), F.lit(False))}
    named = F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in row_rules.items())))
    rows = evidence.select("evidence_id", F.explode(named).alias("rule")).groupBy("evidence_id", "rule").agg(F.count("*").alias("n"))
    keyed = evidence.where("evidence_id <> ''").groupBy("evidence_id").agg(F.count_distinct(texts.content_key(F.col("content"), F.col("content_hash"))).alias("n")).where("n > 1")
    return rows.unionByName(keyed.select("evidence_id", F.lit("conflict").alias("rule"), "n"))


def resolved_evidence(findings: DataFrame, index: DataFrame) -> DataFrame:
    """(finding_id, resolved, missing): the evidence ids that the index has, and those it lacks, in the cited order; a finding that cites nothing has two empty lists."""
    cited = findings.select("finding_id", F.posexplode_outer("evidence_ids").alias("pos", "evidence_id"))
    marked = cited.join(index.select("evidence_id", F.lit(True).alias("known")), "evidence_id", "left").groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("pos", "evidence_id", "known"))).alias("all"))
    ids = lambda known: F.transform(F.filter("all", lambda e: e["pos"].isNotNull() & (e["known"].isNotNull() if known else e["known"].isNull())), lambda e: e["evidence_id"])
    return marked.select("finding_id", ids(True).alias("resolved"), ids(False).alias("missing"))


def advisory_matches(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages (ecosystem, name, version) with the advisories of their name, and whether the version is
    affected (null: can't be told); versions that aren't are left out.

    Names are equal after folding, so the join is on equal keys; the ranges only filter.  Versions are read into numbers once for
    each package and advisory, before they meet, and not for each pair."""
    key = lambda c: texts.package_name(F.col(c))
    left = packages.withColumn("_e", F.lower("ecosystem")).withColumn("_n", key("name")).withColumn("_version", texts.version_parts(F.col("version")))
    right = advisories.select(F.lower("ecosystem").alias("_e"), key("package").alias("_n"), F.col("id").alias("advisory_id"), "cwe_ids", texts.range_parts(F.col("affected_ranges")).alias("_ranges"))
    both = left.join(right, ["_e", "_n"]).withColumn("affected", texts.version_inside(F.col("_version"), F.col("_ranges")))
    return both.where("affected is null or affected").drop("_e", "_n", "_version", "_ranges")


def first_by(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_f")).select(*keys, "_f.*")


def same_edges(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge tables hold the same set."""
    a, b = a.select("caller", "callee"), b.select("caller", "callee")
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()
