"""Functions of ids, paths, versions, JSON in prose, hashes, costs and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION_PARTS = 4
# Prefixes that a function's pattern leaves out, and reserved file names.
ACTION_PREFIXES = ("build", "get", "create", "make", "init", "setup", "default", "cached", "new")
RESERVED_STEMS = ("CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10)))
NAME_LIMIT = 233
# File endings by language.
LANGUAGE_OF = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "javascript", "tsx": "javascript", "go": "go", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c"}


# Symbols of currencies, other names of languages, and languages by ending where a unit's is inferred.
CURRENCY_SYMBOLS = {"USD": "$", "CNY": "¥", "EUR": "€"}
LANGUAGE_NAMES = {"c++": "cpp", "cxx": "cpp", "py": "python", "golang": "go", "js": "javascript", "ts": "typescript", "node": "javascript"}
ENDING_LANGUAGES = {"c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}


def version_parts(version: Column) -> Column:
    """The first four numbers of a version, padded with zeros; null without a number."""
    numbers = F.slice(F.regexp_extract_all(version, F.lit(r"([0-9]+)"), F.lit(1)), 1, VERSION_PARTS)
    return F.when(F.size(numbers) > 0, F.concat(F.transform(numbers, lambda n: n.cast("bigint")), F.slice(F.array_repeat(F.lit(0).cast("bigint"), VERSION_PARTS), 1, VERSION_PARTS - F.size(numbers))))


def range_parts(ranges: Column) -> Column:
    """Ranges (introduced, fixed, last_affected) with the numbers of their versions, for `version_inside`."""
    return F.transform(ranges, lambda r: F.struct(*(version_parts(r[c]).alias(c) for c in ("introduced", "fixed", "last_affected"))))


def version_inside(now: Column, ranges: Column) -> Column:
    """Whether a version lies in any of the ranges, both by their numbers (`version_parts`, `range_parts`); null if the version has none or there are no ranges."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), VERSION_PARTS)

    def inside(r):
        fixed, last = r["fixed"], r["last_affected"]
        below = F.when(fixed.isNotNull() & (now < fixed), True).when(last.isNotNull() & (now <= last), True).otherwise(fixed.isNull() & last.isNull())
        return (now >= F.coalesce(r["introduced"], zero)) & below

    return F.when(now.isNull() | ranges.isNull() | (F.size(ranges) == 0), F.lit(None)).otherwise(F.exists(ranges, inside))


def version_affected(version: Column, ranges: Column) -> Column:
    """Whether a version lies in any of the ranges (introduced, fixed, last_affected); null if
    the version has no number or there are no ranges."""
    return version_inside(version_parts(version), range_parts(ranges))


def package_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")


def cwe_number(text: Column) -> Column:
    """The number in a CWE id, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text.cast("string"), r"([0-9]+)", 1).try_cast("int"), F.lit(0))


def advisory_applies(cwe: Column, cwes: Column) -> Column:
    """An unknown weakness, or an advisory without any, matches all."""
    return (cwe == 0) | F.coalesce(F.size(cwes) == 0, F.lit(True)) | F.coalesce(F.array_contains(cwes, cwe), F.lit(False))


def split_id(unit_id: Column) -> Column:
    """(file, function) of `file:function`, cut at the last colon."""
    has, name = unit_id.contains(":"), F.substring_index(unit_id, ":", -1)
    return F.struct(F.when(has, F.left(unit_id, F.length(unit_id) - F.length(name) - 1)).otherwise("").alias("file"), F.when(has, name).otherwise("").alias("function"))


def signature_pattern(route: Column) -> Column:
    """`file name:*_core` of a route, without leading underscores and action words; methods keep their name."""
    at = split_id(route)
    name = F.element_at(F.split(at["file"], "/"), -1)
    core = F.regexp_replace(F.regexp_replace(at["function"], "^_+", ""), f"^(?:(?:{'|'.join(ACTION_PREFIXES)})_)+", "")
    pattern = F.when(at["function"].contains("."), F.concat(F.lit("*."), F.element_at(F.split(at["function"], r"\."), -1))).otherwise(F.concat(F.lit("*_"), core))
    return F.when(~route.contains(":"), route).otherwise(F.concat(name, F.lit(":"), pattern))


def safe_file_name(unit_id: Column) -> Column:
    """A file name of an id; long ones are cut and end in a piece of their hash."""
    safe = F.translate(F.regexp_replace(unit_id, r"[/\\]", "__"), ": ", "__")
    cut = F.when(F.length(safe) > NAME_LIMIT, F.concat(F.left(safe, F.lit(NAME_LIMIT)), F.lit("_"), F.left(F.sha2(unit_id.cast("binary"), 256), F.lit(16)))).otherwise(safe)
    stem = F.upper(F.regexp_replace(F.substring_index(cut, ".", 1), "[ .]+$", ""))
    return F.when(stem.isin(*RESERVED_STEMS), F.concat(F.lit("_"), cut)).otherwise(cut)


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer, as text: fences go, then all from the first brace to the last; else null."""
    clean = F.trim(F.regexp_replace(F.trim(text), r"(?is)^```(?:json)?\s*(.*?)\s*```\s*$", "$1"))
    inner = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.json_object_keys(c).isNotNull()
    return F.when(valid(clean), clean).when(valid(inner), inner)


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def looks_truncated(text: Column) -> Column:
    """No JSON object, and open braces or brackets or a first brace."""
    trimmed = F.trim(text)
    unbalanced = (count_of(trimmed, "{") > count_of(trimmed, "}")) | (count_of(trimmed, "[") > count_of(trimmed, "]"))
    return F.coalesce((trimmed != "") & json_object(text).isNull() & (unbalanced | trimmed.startswith("{")), F.lit(False))


def is_unsafe_path(path: Column) -> Column:
    """Absolute (of any system), under a home folder, or with a parent segment."""
    flat = F.translate(path, "\\", "/")
    return F.coalesce(flat.startswith("/") | path.startswith("~") | path.rlike(r"^[A-Za-z]:") | F.array_contains(F.split(flat, "/"), ".."), F.lit(False))


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def diff_path(path: Column) -> Column:
    """A path without one leading `./`."""
    return F.regexp_replace(path, r"^\./", "")


def hunk_range(header: Column) -> Column:
    """(start, end) of the new side of `@@ -a,b +c,d @@`; null for a hunk without lines."""
    pattern = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
    first, n = F.regexp_extract(header, pattern, 1).try_cast("int"), F.regexp_extract(header, pattern, 2)
    count = F.when(n == "", 1).otherwise(n.try_cast("int"))
    return F.when(first.isNotNull() & (count > 0), F.struct(first.alias("start"), (first + count - 1).alias("end")))


def content_key(content: Column, declared: Column) -> Column:
    """A declared hash, if it is one, else the content's."""
    return F.when(F.lower(declared).rlike("^[0-9a-f]{64}$"), F.lower(declared)).otherwise(F.sha2(content.cast("binary"), 256))


def fingerprint(**fields: Column) -> Column:
    """A hash of named fields as canonical JSON: keys sorted, no blanks, nulls kept."""
    made = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(made, {"ignoreNullFields": "false"}).cast("binary"), 256)


def spaced_json(*fields: tuple[str, Column]) -> Column:
    """Canonical JSON with blanks after commas and colons, of named JSON values (see json_text), keys sorted."""
    inner = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(fields, key=lambda f: f[0])))
    return F.concat(F.lit("{"), inner, F.lit("}"))


def json_text(value: Column, kind: str = "string") -> Column:
    """A value as JSON: a string, a number or boolean, or a list of strings; null is null."""
    quoted = lambda x: F.get(F.split(F.to_json(F.struct(x.alias("v"))), '^\\{"v":'), F.lit(1))
    if kind == "list":
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.regexp_replace(quoted(x), r"\}$", "")), ", "), F.lit("]")), F.lit("null"))
    text = F.regexp_replace(quoted(value), r"\}$", "") if kind == "string" else value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)


def evidence_id(kind: Column, source: Column, tool: Column, content_hash: Column) -> Column:
    """An id that follows from the kind, the source, the tool and the whole content's hash; what is missing keeps its place."""
    text = F.concat_ws("|", kind, *(F.coalesce(c, F.lit("")) for c in (source, tool, content_hash)))
    return F.concat(F.lit("ev_"), kind, F.lit("_"), F.left(F.sha2(text.cast("binary"), 256), F.lit(16)))


def dynamic_evidence_id(kind: Column, content: Column) -> Column:
    """The id of a run's evidence: its content's JSON, hashed."""
    return F.concat(F.lit("ev_dyn_"), kind, F.lit("_"), F.left(F.sha2(content.cast("binary"), 256), F.lit(16)))


def finding_id(unit_id: Column, input_fingerprint: Column, candidate: dict[str, Column], evidence_ids: Column, location: Column) -> Column:
    """A finding's id: the hash of its unit, of what the first stage saw, and of the candidate's body.  candidate: its
    decision, candidate_type, cwe_id (a number), source, propagation, sink and impact; location: JSON of its place."""
    body = [(k, json_text(v, "number" if k == "cwe_id" else "string")) for k, v in candidate.items()]
    core = spaced_json(*body, ("evidence_ids", json_text(F.coalesce(evidence_ids, F.array().cast("array<string>")), "list")), ("location", F.coalesce(location, F.lit("{}"))))
    whole = spaced_json(("unit_id", json_text(unit_id)), ("detection_input_fingerprint", json_text(input_fingerprint)), ("stage1_candidate", core))
    return F.sha2(whole.cast("binary"), 256)


def stage_fingerprint(stage: str, versions: dict[str, str], **fields: Column) -> Column:
    """A stage's memo key: the hash of its input's fields with the versions of its record, prompt and tools, and its model
    and settings, so that a change of any of these makes old results unusable.  Nulls count."""
    fixed = {"stage": F.lit(stage), **{f"{k}_version": F.lit(v) for k, v in versions.items()}}
    return fingerprint(**fixed, **fields)


def language_of(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return F.element_at(table, ending)


def preview(text: Column, limit: int = 800) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Of tokens at prices for a million, to six places, half to even."""
    return F.bround((input_tokens * input_price + output_tokens * output_price) / 1_000_000, 6)


def cost_text(amount: Column, currency: Column | None = None, places: int | None = None) -> Column:
    """An amount for people, to some places: if not said, four below a cent, else two; with two, thousands apart from ten on.
    With the currency's symbol, or its name behind where it has none.  Null stays null."""
    code = F.lit("USD") if currency is None else F.coalesce(F.nullif(F.upper(currency), F.lit("")), F.lit("USD"))
    symbol = F.element_at(F.create_map(*(F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair)), code)
    to = lambda form: F.format_string(form, amount.cast("double"))
    plain = F.when(amount < 0.01, to("%.4f")).otherwise(to("%.2f")) if places is None else to(f"%.{places}f")
    large = to("%,.2f") if places in (None, 2) else plain
    shown = F.when(symbol.isNull(), F.concat(plain, F.lit(" "), code)).when(amount >= 10, F.concat(symbol, large)).otherwise(F.concat(symbol, plain))
    return F.when(amount.isNotNull(), shown)


def duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %02ds", (whole / 60).cast("int"), whole % 60))
        .otherwise(F.format_string("%dh %02dm", (whole / 3600).cast("int"), ((whole % 3600) / 60).cast("int")))
    )


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, elapsed / done * (total - done))


def short_sha(sha: Column) -> Column:
    return F.left(F.coalesce(sha, F.lit("")), F.lit(8))


def is_valid_ref(ref: Column) -> Column:
    return F.coalesce(ref.rlike(r"^[A-Za-z0-9_][A-Za-z0-9._/-]*$") & ~ref.contains(".."), F.lit(False))


def diff_range(base: Column, head: Column) -> Column:
    """`base..head` in short hashes."""
    return F.concat(short_sha(base), F.lit(".."), short_sha(head))


def file_url(repository: Column, sha: Column, file: Column) -> Column:
    """A link to a file in a hosted repository; empty without a repository or hash."""
    base = F.regexp_replace(F.regexp_replace(repository, "/+$", ""), r"\.git$", "")
    return F.when((repository != "") & (sha != ""), F.concat(base, F.lit("/blob/"), sha, F.lit("/"), file)).otherwise("")


def is_valid_run_id(run_id: Column) -> Column:
    """Letters, digits, dots, dashes and underscores, at most 128, beginning with a letter or digit; blanks around it don't count."""
    return F.coalesce(F.trim(run_id).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def language_hint(explicit: Column, route: Column, code: Column) -> Column:
    """A unit's language: what is said, else its file's ending, else what its code looks like, else unknown."""
    said = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    said = F.coalesce(F.element_at(table(LANGUAGE_NAMES), said), F.nullif(said, F.lit("")), F.lit("unknown"))
    ending = F.regexp_extract(F.lower(F.substring_index(F.coalesce(route, F.lit("")), ":", 1)), r"\.([a-z]+)$", 1)
    code = F.coalesce(code, F.lit(""))
    looks = (
        F.when(code.rlike(r"(?m)^\s*package\s+\w+"), "go").when(code.rlike(r"(?m)^\s*(?:def|class)\s+\w+"), "python").when(code.rlike(r"\b(?:const|let|var)\s+\w+|=>|require\s*\("), "javascript")
        .when(code.rlike(r"#\s*include|std::|(?:^|\s)(?:char|void|int)\s+\w+\s*\("), F.when(code.contains("std::"), "cpp").otherwise("c")).otherwise("unknown")
    )
    return F.when(said != "unknown", said).otherwise(F.coalesce(F.element_at(table(ENDING_LANGUAGES), ending), looks))


def attack_vector(source: Column, sink: Column, impact: Column) -> Column:
    return F.concat_ws(" → ", *(F.nullif(c, F.lit("")) for c in (source, sink, impact)))


def matching_lines(text: Column, pattern: str, most: int) -> Column:
    """The first lines that match."""
    return F.slice(F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern)), 1, most)


def ordered_union(*ids: Column) -> Column:
    """All ids once, in the order of their first appearance; nulls and empty ones go."""
    return F.array_distinct(F.filter(F.flatten(F.array(*(F.coalesce(i, F.array().cast("array<string>")) for i in ids))), lambda x: F.coalesce(x != "", F.lit(False))))
