"""Call-graph tables brought to one form, and the units that analysis works on, made of functions and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored
from .graph import adjacency, depth_first, discovered, first_visits, steps_of, structural_roots, to_edges

# Marks between the texts of different files, by the comment sign of the language.
BOUNDARIES = {"python": "\n\n# ========== File Boundary ==========\n\n", "javascript": "\n\n// ========== File Boundary ==========\n\n"}
NESTED = ("lambda", "nested_function", "closure")


def _first(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of the columns that a table has which is neither null nor empty."""
    have = [F.nullif(F.col(n).cast(kind), F.lit("").cast(kind)) if kind == "string" else F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def nodes_of(functions: DataFrame, language: str) -> DataFrame:
    """A graph's nodes of a parser's functions (id, and any of name, file_path, class_name, unit_type, is_exported, kind,
    parent_id, package, is_static, code, lines; also in camel case), with their kind, visibility and language.

    Kinds: the function's own, else program_entry for main, module_init, the unit types of nested ones, callable, method, or
    the unit type.  Public are what a language takes as such: in Python top-level functions without a leading underscore, in Go capitals, in C
    what isn't static, else what is exported."""
    df, get = functions, lambda *names, kind="string": _first(functions, *names, kind=kind)
    name = F.coalesce(get("name"), F.element_at(F.split("id", ":"), -1))
    file = F.coalesce(get("file_path", "filePath"), F.when(F.col("id").contains(":"), F.substring_index("id", ":", 1)), F.lit(""))
    owner, parent = get("class_name", "className", "receiver"), get("parent_id", "parentId")
    unit = F.coalesce(get("unit_type", "unitType"), F.lit("function"))
    exported, static = F.coalesce(get("is_exported", "isExported", kind="boolean"), F.lit(False)), F.coalesce(get("is_static", kind="boolean"), F.lit(False))
    go = F.lit(language == "go")
    kind = (
        F.when(get("kind").isNotNull(), get("kind")).when(name == "main", "program_entry").when((name == "init") & go, "module_init").when(unit == "module_level", "module_init").when(unit.isin(*NESTED), unit)
        .when(owner.isNotNull() & (name == "__call__"), "callable").when(owner.isNotNull(), "method").otherwise(unit)
    )
    public = {
        "python": owner.isNull() & parent.isNull() & ~name.startswith("_") & ~unit.isin(*NESTED, "module_level"), "go": name.rlike(r"^\p{Lu}"), **dict.fromkeys(("c", "cpp", "c++"), ~static),
    }.get(language, F.lit(False))
    shown = exported | F.coalesce(public, F.lit(False))
    whole = F.coalesce(get("qualified_name", "qualifiedName"), F.when(owner.isNotNull(), F.concat(owner, F.lit("."), name)).otherwise(name))
    lines = [F.coalesce(get(*pair, kind="int"), F.lit(0)).alias(c) for c, pair in (("start_line", ("start_line", "startLine")), ("end_line", ("end_line", "endLine")))]
    return df.select(
        "id", name.alias("name"), whole.alias("qualified_name"), file.alias("file_path"), *lines, kind.alias("kind"), F.when(shown, "public").otherwise("private").alias("visibility"), shown.alias("is_exported"), owner.alias("receiver_type"),
        parent.alias("parent_id"), F.lit(language).alias("language"), unit.alias("unit_type"), F.coalesce(get("code"), F.lit("")).alias("code"), F.coalesce(get("package"), F.lit("")).alias("package"), static.alias("is_static"),
    )


def graph_tables(functions: DataFrame, language: str, edges: DataFrame | None = None, lists: DataFrame | None = None, unresolved: DataFrame | None = None, roots: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges, unresolved and roots of what a parser gave: nodes as they are (with a visibility) or functions, edges or
    adjacency lists (id, neighbours), whose edges are exact, and its roots or those that the nodes show to be roots."""
    nodes = functions if "visibility" in functions.columns else nodes_of(functions, language)
    none = functions.sparkSession.createDataFrame([], "caller string, callee_name string, reason string, candidates array<string>")
    kept = edges if edges is not None else to_edges(lists).withColumn("kind", F.lit("call"))
    return {"nodes": nodes, "edges": kept, "unresolved": none if unresolved is None else unresolved, "roots": structural_roots(nodes) if roots is None else roots}


def graph_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: nodes, resolved_edges, structural_roots, unresolved."""
    rows = [tables[t].agg(F.count("*").alias(n)) for t, n in (("nodes", "nodes"), ("edges", "resolved_edges"), ("roots", "structural_roots"), ("unresolved", "unresolved"))]
    out = rows[0]
    for row in rows[1:]:
        out = out.crossJoin(row)  # single rows
    return out


def neighbours(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3, ups: DataFrame | None = None, downs: DataFrame | None = None) -> DataFrame:
    """(seed, side, depth, path, id, name, file_path): what each seed calls (up) and what calls it (down), with the nodes' own
    columns; ids without a node go.  By depth and path they are in the order in which a breadth-first search finds them.

    ups, downs: the steps of both sides (`graph.steps_of`), where a parser has lists of its own for them."""
    steps = {"up": steps_of(edges) if ups is None else ups, "down": steps_of(edges, reverse=True) if downs is None else downs}
    sides = [discovered(seeds, rows, depth).withColumn("side", F.lit(side)) for side, rows in steps.items()]
    return sides[0].unionByName(sides[1]).join(nodes.select("id", "name", "file_path"), "id").select("seed", "side", "depth", "path", "id", "name", "file_path")


def _placed(near: DataFrame) -> DataFrame:
    return near.select("seed", F.struct(F.when(F.col("side") == "up", 0).otherwise(1).alias("s"), "depth", "path").alias("order"), "id", "file_path", "side")


def _digest(code: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(code, F.lit("")), 256))


def _marked(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(seed, order, id, file_path, of): the neighbours with the digest of their text; blank texts have none."""
    digests = nodes.select("id", F.when(F.col("code") != "", _digest(F.col("code"))).alias("of"))
    return _placed(near).join(digests, "id", "left").select("seed", "order", "id", "file_path", "of")


def _pieces(nodes: DataFrame, marked: DataFrame, style: str) -> DataFrame:
    used = marked.where("of is not null" + (" and order.s = 0" if style == "go" else ""))
    own = nodes.select(F.col("id").alias("seed"), F.lit(None).cast(used.schema["order"].dataType).alias("order"), "id", _digest(F.col("code")).alias("of"))
    known = own.unionAll(used.select("seed", "order", "id", "of"))
    if style != "go":
        known = known.groupBy("seed", "of").agg(F.min(F.struct("order", "id")).alias("m")).select("seed", "m.order", "m.id")
    return known.join(nodes.select("id", "file_path", F.coalesce("code", F.lit("")).alias("code")), "id").select("seed", "order", "id", "file_path", "code")


def unit_pieces(nodes: DataFrame, near: DataFrame, style: str = "python") -> DataFrame:
    """(seed, order, id, file_path, code): the texts of each unit in order: the function's own, then its callees', then its
    callers', each text once.  go takes callees alone and repeats equal texts.

    A text is a row, so a function with very many callers has many rows and not one long one; of equal texts the first is
    kept by their digest, and texts are joined to what is kept alone."""
    return _pieces(nodes, _marked(nodes, near), style)


def unit_sizes(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(id, unit_type, total_up, total_down): how many neighbours each node has, without their texts."""
    up, down = F.count_if(F.col("side") == "up"), F.count_if(F.col("side") == "down")
    counts = near.groupBy(F.col("seed").alias("id")).agg(up.alias("total_up"), down.alias("total_down"))
    return nodes.select("id", "unit_type").join(counts, "id", "left").select("id", "unit_type", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total_up", "total_down")))


def assembled(nodes: DataFrame, near: DataFrame, style: str = "python") -> DataFrame:
    """The units in a row each: id, unit_type, code (the texts of `unit_pieces` with a mark between), files, total_up, total_down,
    original_length, enhanced_length.

    style: python sorts the files; javascript keeps them in the order in which they come; go takes callees alone and repeats
    equal texts.  A row holds all of a unit's texts, as its readers want it; for graphs with hubs use `unit_pieces`."""
    boundary = BOUNDARIES.get("python" if style == "python" else "javascript")
    marked = stored(_marked(nodes, near))  # two steps read it: texts, and files with counts
    # nulls come first, and the function's own text has no order
    pieces = _pieces(nodes, marked, style).groupBy(F.col("seed").alias("id")).agg(F.sort_array(F.collect_list(F.struct("order", "code")))["code"].alias("l"))
    up, down = (F.count_if(F.col("order.s") == k) for k in (0, 1))
    first = [] if style == "python" else [F.min("order").alias("order")]
    by_file = marked.groupBy(F.col("seed").alias("id"), "file_path").agg(up.alias("up"), down.alias("down"), *first)
    shown = (F.col("file_path") != "") & ((F.col("up") > 0) if style == "go" else F.lit(True))
    named = F.sort_array(F.collect_list(F.when(shown, F.col("file_path") if style == "python" else F.struct("order", "file_path"))))
    near_files = named if style == "python" else named["file_path"]
    files = by_file.groupBy("id").agg(near_files.alias("near_files"), F.sum("up").alias("total_up"), F.sum("down").alias("total_down"))
    both = nodes.select("id", "unit_type", "file_path", F.length("code").alias("original_length")).join(pieces, "id").join(files, "id", "left")
    every = F.array_distinct(F.concat(F.array("file_path"), F.coalesce("near_files", F.array().cast("array<string>"))))
    if style == "python":  # a missing name comes last
        none = F.when(F.col("file_path").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
        every = F.concat(F.sort_array(F.array_compact(every)), none)
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total_up", "total_down")]
    made = both.select("id", "unit_type", F.array_join("l", boundary).alias("code"), every.alias("files"), *counts, "original_length")
    return made.withColumn("enhanced_length", F.length("code"))


def unit_totals(units: DataFrame, style: str = "python") -> DataFrame:
    """One row: units, with_up, with_down, enhanced, and mean_up and mean_down, to two places, or as they are for Go; JavaScript has no means."""
    up, down, n = F.col("total_up"), F.col("total_down"), F.count("*")
    counts = [n.alias("units"), F.count_if(up > 0).alias("with_up"), F.count_if(down > 0).alias("with_down"), F.count_if((up > 0) | (down > 0)).alias("enhanced")]
    mean = lambda c: F.when(n > 0, F.sum(c) / n).otherwise(0.0)
    means = [] if style == "javascript" else [(mean(c) if style == "go" else F.bround(mean(c), 2)).alias(k) for c, k in ((up, "mean_up"), (down, "mean_down"))]
    return units.agg(*counts, *means)


def bundle(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, dependencies): the functions that each seed reaches, as (depth, path, id, name, file_path, code), in the order of discovery; a seed without any has an empty list."""
    near = discovered(seeds, steps_of(edges), depth).join(nodes.select("id", "name", "file_path", "code"), "id")
    listed = near.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("depth", "path", "id", "name", "file_path", "code"))).alias("dependencies"))
    return seeds.select(F.col("id").alias("seed")).distinct().join(listed, "seed", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast(listed.schema["dependencies"].dataType)))


def degree_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean_out and mean_in as texts of two places, and a count for each unit type."""
    from .graph import degree_stats

    row = degree_stats(nodes, edges)
    kinds = nodes.groupBy("unit_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit_type", "n")))).alias("by_type"))
    fixed = lambda c: F.format_string("%.2f", F.col(c).cast("double")).alias(c)
    return row.crossJoin(kinds).select("nodes", "edges", fixed("mean_out"), fixed("mean_in"), "max_out", "max_in", "isolated", "by_type")  # two single rows


def import_closure(seeds: DataFrame, imports: DataFrame, depth: int = 5, budget: int = 20) -> DataFrame:
    """(seed, number, path): the files that each file (id) draws in by imports (path, imported, and place in the file), depth first.

    A file is visited once, and its own imports right after it; `depth` imports lie between the seed and a file at most, and
    each seed visits `budget` files at most, itself among them, as number 0."""
    place = "place" if "place" in imports.columns else "imported"
    steps = imports.select(F.col("path").alias("at"), F.col(place).alias("place"), F.col("imported").alias("id"))
    return first_visits(seeds, steps, depth, max(budget, 1)).select("seed", "number", F.col("id").alias("path"))


def imported_dependencies(seeds: DataFrame, refs: DataFrame, functions: DataFrame, depth: int = 4) -> DataFrame:
    """(seed, path, ref, id, file_path, appended): the functions that each seed draws in by the names that it calls, depth first.

    refs: (at, place, ref, id): what a function calls by which name, and the imported function that this is, if it is known.
    A name is followed once for each seed, on whatever branch it comes first, in path order.  appended: the first
    dependency of its file, other than the seed's own file: only those texts are put behind the seed's."""
    found = depth_first(seeds, refs, depth).where("id is not null").join(functions.select("id", "file_path"), "id")
    home = functions.select(F.col("id").alias("seed"), F.col("file_path").alias("home"))
    first = found.groupBy("seed", "file_path").agg(F.min("path").alias("path"), F.lit(True).alias("first"))
    told = found.join(first, ["seed", "file_path", "path"], "left").join(home, "seed", "left")
    return told.select("seed", "path", "ref", "id", "file_path", (F.coalesce("first", F.lit(False)) & ~F.col("file_path").eqNullSafe(F.col("home"))).alias("appended"))


def with_dependencies(seeds: DataFrame, functions: DataFrame, found: DataFrame) -> DataFrame:
    """(id, combined, files): each seed's text and the appended ones, every file with its name above, in order."""
    titled = lambda file, code: F.concat(F.lit("# File: "), file, F.lit("\n"), F.coalesce(code, F.lit("")))
    texts = functions.select("id", "file_path", "code")
    more = found.where("appended").select("seed", "path", "id").join(texts, "id").groupBy(F.col("seed").alias("id")).agg(F.array_sort(F.collect_list(F.struct("path", "file_path", "code"))).alias("l"))
    rest = F.coalesce("l", F.array().cast(more.schema["l"].dataType))
    one = seeds.select("id").distinct().join(texts, "id").join(more, "id", "left")
    combined = F.array_join(F.concat(F.array(titled(F.col("file_path"), F.col("code"))), F.transform(rest, lambda x: titled(x["file_path"], x["code"]))), "\n\n")
    return one.select("id", combined.alias("combined"), F.concat(F.array("file_path"), F.transform(rest, lambda x: x["file_path"])).alias("files"))


def analyzer_rows(functions: DataFrame, language: str) -> DataFrame:
    """Functions under the names that the analyser reads; of Python, all count as exported."""
    exported = F.lit(True) if language == "python" else F.coalesce(_first(functions, "is_exported", kind="boolean"), F.lit(False))
    return functions.select("id", "name", F.col("unit_type").alias("unitType"), "code", F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), exported.alias("isExported"), F.col("class_name").alias("className"))


def graph_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, calls, callers): the adjacency lists of all nodes, in both directions; nodes without neighbours have empty ones."""
    none = F.array().cast("array<string>")
    out = nodes.select("id").distinct()
    for name, reverse in (("calls", False), ("callers", True)):
        out = out.join(adjacency(edges, reverse).withColumnRenamed("neighbours", name), "id", "left").withColumn(name, F.coalesce(F.col(name).cast("array<string>"), none))
    return out
