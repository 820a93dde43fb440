"""Package identities, advisories, and fingerprints of vulnerable and patched code."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts

#: bytes of a file that is looked at, and lines of evidence that a result carries
FILE_BYTES, EVIDENCE = 1 << 20, 20
#: manifests that name a package, by their file's name
MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml")


def _section_value(text: Column, section: str, key: str) -> Column:
    """The text value of a key in a section of a TOML file."""
    body = F.regexp_extract(text, rf"(?ms)^\s*\[\Q{section}\E\]\s*$(.*?)(?=^\s*\[|\z)", 1)
    return F.nullif(F.regexp_extract(body, rf"(?m)^\s*{key}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def identities(files: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, version, source) of manifests (repo, file, text), one for each package; of equal ones the
    last counts, in the order of the manifests.  A package.json without a name has its repository's."""
    text, file = F.col("text"), F.col("file")
    as_json = F.try_parse_json(text)
    project = lambda k: F.when(_section_value(text, "project", "name").isNotNull(), _section_value(text, "project", k)).otherwise(_section_value(text, "tool.poetry", k))
    named = lambda ecosystem, name, version: F.struct(F.lit(ecosystem).alias("ecosystem"), name.alias("name"), F.coalesce(version, F.lit("")).alias("version"))
    found = (
        F.when((file == "package.json") & as_json.isNotNull(), named("npm", F.coalesce(F.nullif(F.try_variant_get(as_json, "$.name", "string"), F.lit("")), F.col("repo")), F.try_variant_get(as_json, "$.version", "string")))
        .when(file == "pyproject.toml", named("pypi", project("name"), project("version"))).when(file == "go.mod", named("go", F.nullif(F.regexp_extract(text, r"(?m)^\s*module\s+(\S+)", 1), F.lit("")), F.lit("")))
        .when(file == "Cargo.toml", named("cargo", _section_value(text, "package", "name"), _section_value(text, "package", "version")))
    )
    rows = files.withColumn("_found", found).where("_found.name is not null").select("repo", "_found.*", file.alias("source"), F.array_position(F.array(*map(F.lit, MANIFESTS)), file).alias("_pos"))
    one = rows.groupBy("repo", "ecosystem", texts.package_name(F.col("name")).alias("_key")).agg(F.max_by(F.struct("name", "version", "source"), "_pos").alias("p"))
    return one.select("repo", "ecosystem", "p.*")


def advisories(cached: DataFrame) -> DataFrame:
    """The advisories of caches (id, ecosystem, package and more, pos), each id once, the last; rows without one of the three are left out."""
    rest = [c for c in cached.columns if c not in ("id", "pos")]
    good = cached.where("id <> '' and package <> '' and ecosystem <> ''")
    return good.groupBy("id").agg(F.max(F.struct("pos", *rest)).alias("a")).select("id", *(F.col(f"a.{c}").alias(c) for c in rest))


def fingerprint_states(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(advisory_id, state, evidence): what an advisory's patterns of vulnerable and patched code say of the files (path, text).

    patterns: advisory_id, kind (vulnerable_regex, patched_regex), pattern.  An advisory without patterns is not in the
    result (not_checked).  Hidden paths and files over 1 MiB aren't looked at; the others all are.
    patterns is a table of advisories that a package matched, so it is small by its making; it is
    collected in blocks and each block is one pass over the files, whose matches are counted before
    they are shuffled."""
    seen = files.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")) & (F.octet_length("text") <= FILE_BYTES))
    rows = patterns.select("advisory_id", "kind", "pattern").distinct()
    found = None
    todo = rows.orderBy("advisory_id", "kind", "pattern").collect()
    for at in range(0, len(todo), 200):
        tests = [F.when(F.col("text").rlike("(?m)" + r.pattern), F.struct(F.lit(r.advisory_id).alias("advisory_id"), F.lit(r.kind).alias("kind"))) for r in todo[at : at + 200]]
        hits = seen.select("path", F.explode(F.array_compact(F.array(*tests))).alias("h")).select("h.*", "path")
        found = hits if found is None else found.unionAll(hits)
    every = patterns.select("advisory_id").distinct()
    if found is None:
        return every.select("advisory_id", F.lit("unknown").alias("state"), F.array().cast("array<string>").alias("evidence"))
    has = lambda kind: F.coalesce(F.max(F.col("kind") == kind), F.lit(False))
    lines = F.slice(F.array_sort(F.collect_set(F.concat("kind", F.lit(" matched "), "path"))), 1, EVIDENCE)
    one = found.groupBy("advisory_id").agg(has("vulnerable_regex").alias("v"), has("patched_regex").alias("p"), lines.alias("evidence"))
    state = F.when(F.col("v") & F.col("p"), "conflict").when(F.col("v"), "vulnerable_pattern_present").when(F.col("p"), "patched_pattern_present").otherwise("unknown")
    return every.join(one, "advisory_id", "left").select("advisory_id", state.alias("state"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
