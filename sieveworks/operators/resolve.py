"""Call graphs of Python functions, imports and calls (`code.sources`), by joins.

What a call may mean is a relation (call, function); a call with exactly one function in it is an edge, any other
is unresolved, with a reason.  Nothing is guessed by a name that is unique in the repository: what bears an unresolved
name anywhere is only what the call may mean, kept as a relation of its own (`named`), so that a name which
thousands of files share is listed once and not for each call.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored

# Names whose calls are no edges: builtins and modules of the standard library.
BUILTINS = tuple(
    """print len range str int float bool list dict set tuple type isinstance issubclass hasattr getattr setattr delattr callable super next iter enumerate zip map filter sorted reversed min max sum abs
    round pow divmod hex oct bin ord chr ascii repr format hash id input open eval exec compile globals locals vars dir help exit quit staticmethod classmethod property object Exception BaseException ValueError
    TypeError KeyError IndexError AttributeError RuntimeError StopIteration NotImplementedError json os sys re datetime time math random collections itertools functools operator copy pickle shelve sqlite3
    csv io pathlib shutil subprocess threading multiprocessing asyncio socket http urllib email html xml logging unittest typing dataclasses contextlib abc inspect traceback""".split()
)
# Methods that any object may have; on a receiver of no known type they say nothing.
COMMON_METHODS = tuple(
    """strip split join replace lower upper format startswith endswith find index count encode decode append extend insert remove pop clear copy keys values items get update setdefault close read write seek
    flush readline readlines send recv connect bind listen accept __iter__ __next__ __enter__ __exit__""".split()
)


class CallGraph(NamedTuple):
    """edges: caller, callee, kind, confidence.  unresolved: caller, callee_name, reason, candidates, and open_name, under which
    `named` (name, id) lists what the call may mean as well."""

    edges: DataFrame
    unresolved: DataFrame
    named: DataFrame


def _module(path: Column) -> Column:
    return F.replace(F.translate(path, "/", "."), F.lit(".py"), F.lit(""))


def _suffixes(text: Column) -> Column:
    """All endings of a text, itself and the empty one among them."""
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda k: F.substring(text, k, F.length(text)))


def resolved_targets(asks: DataFrame, functions: DataFrame) -> DataFrame:
    """(target, name, callee): the function that a name is by an import path; asks: (target, name).

    The path's longest beginning that is a file with such a function counts: there, `Class.name` with the path's next
    part as the class, or the name itself.  Else it is the first function of the path's last part whose module is an ending of
    the rest of the path, or the other way round; endings are keys of a join, so a name that many files define is met
    only where the module fits."""
    parts = F.split("target", r"\.")
    asks = asks.select("target", "name").distinct()
    step = F.explode(F.sequence(F.lit(1), F.size(parts)))
    heads = asks.select("target", "name", step.alias("n")).withColumn("file", F.concat(F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/"), F.lit(".py:"))).withColumn("rest", F.get(parts, F.col("n")))
    both = F.array(F.concat("file", "rest", F.lit("."), "name"), F.concat("file", "name"))
    tried = heads.select("target", "name", "n", F.posexplode(both).alias("k", "callee")).where("callee is not null")
    in_file = tried.join(functions.select(F.col("id").alias("callee")), "callee", "left_semi").groupBy("target", "name").agg(F.min_by("callee", F.struct(-F.col("n"), "k")).alias("callee"))
    told = stored(asks.join(in_file, ["target", "name"], "left"))  # three steps read it
    by_file, rest_of = told.where("callee is not null"), told.where("callee is null").select("target", "name")
    last, rest = F.element_at(parts, -1), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")
    left = rest_of.select("target", last.alias("last"), rest.alias("rest")).distinct()
    own = functions.select(F.col("name").alias("last"), F.col("id").alias("callee"), _module(F.col("file_path")).alias("module")).join(left.select("last").distinct(), "last", "left_semi")
    deep = left.where("rest <> ''")
    by_module = [
        left.where("rest = ''").join(own.groupBy("last").agg(F.min("callee").alias("callee")), "last").select("target", "callee"),
        deep.join(own.select("last", "callee", F.explode(_suffixes(F.col("module"))).alias("rest")), ["last", "rest"]).select("target", "callee"),
        deep.select("target", "last", F.explode(_suffixes(F.col("rest"))).alias("module")).join(own, ["last", "module"]).select("target", "callee"),
    ]
    one = by_module[0].unionAll(by_module[1]).unionAll(by_module[2]).groupBy("target").agg(F.min("callee").alias("callee"))
    return by_file.unionByName(rest_of.join(one, "target").select("target", "name", "callee"))


def resolved_imports(imported: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, name, target, function): the functions that imported names (path, name, target) are."""
    return imported.join(resolved_targets(imported, functions), ["target", "name"]).select("path", "name", "target", F.col("callee").alias("function"))


def _asked(functions: DataFrame, imported: DataFrame, made: DataFrame, builtins: tuple[str, ...], common: tuple[str, ...]) -> DataFrame:
    """A row for each thing that a call may be: caller, name, shown, how, target (an import path to look up), own (functions of the
    caller's file), reason (if nothing is found), open (whether the name itself may mean anything)."""
    of = imported.select(F.col("path").alias("file"), F.col("name").alias("word"), "target")
    none = F.array().cast("array<string>")
    free = functions.where("class_name is null").groupBy(F.col("file_path").alias("file"), "name").agg(F.collect_list("id").alias("all"), F.collect_list(F.when(F.col("parent_id").isNull(), F.col("id"))).alias("top"))

    def by_import(rows, column):
        met = of.withColumnRenamed("word", column)
        return rows.join(met, ["file", column], "left")

    plain = by_import(made.where((F.col("kind") == "name") & ~F.col("name").isin(*builtins)).join(free, ["file", "name"], "left"), "name")
    has = F.col("all").isNotNull()
    only = F.when(F.size("all") == 1, F.col("all")).when(F.size("top") == 1, F.col("top")).otherwise(F.col("all"))
    plain = plain.select(
        "caller", "name", F.col("name").alias("shown"), F.lit("name").alias("how"), F.when(~has, F.col("target")).alias("target"), F.coalesce(only, none).alias("own"),
        F.when(F.col("target").isNotNull() & ~has, "import_failed").otherwise("unresolved").alias("reason"), none.alias("types"),
    )
    shown = F.concat("receiver", F.lit("."), "name").alias("shown")
    named = by_import(made.where("kind = 'attribute'"), "receiver")
    module = named.where(F.col("target").isNotNull() & ~F.col("receiver").isin(*builtins)).select("caller", "name", shown, F.lit("module").alias("how"), "target", none.alias("own"), F.lit("import_failed").alias("reason"), none.alias("types"))
    methods = functions.where("class_name is not null").groupBy(F.col("file_path").alias("file"), F.col("class_name").alias("type"), "name").agg(F.collect_set("id").alias("own"), F.min_by("id", F.struct("start_line", "id")).alias("first"))
    local = named.where("target is null").drop("target")
    typed = by_import(local.where("size(types) > 0").withColumn("type", F.explode("types")), "type").join(methods.drop("first"), ["file", "type", "name"], "left")
    typed = typed.select("caller", "name", shown, F.lit("type").alias("how"), "target", F.coalesce("own", none).alias("own"), F.lit("no_type").alias("reason"), "types")
    fixed = lambda rows, text, reason: rows.select("caller", "name", text.alias("shown"), F.lit("none").alias("how"), F.lit(None).cast("string").alias("target"), none.alias("own"), F.lit(reason).alias("reason"), none.alias("types"))
    unusual = ~F.col("name").isin(*common)
    own = made.where("kind = 'own' and receiver <> 'super()'")
    mine = own.where("own_class is not null").join(methods.select("file", F.col("type").alias("own_class"), "name", "first"), ["file", "own_class", "name"])
    mine = mine.select("caller", "name", shown, F.lit("own").alias("how"), F.lit(None).cast("string").alias("target"), F.array("first").alias("own"), F.lit("no_type").alias("reason"), none.alias("types"))
    dotted = F.concat("receiver", F.lit("."), "name")
    rows = [
        plain, module, typed, mine, fixed(local.where("size(types) = 0").where(unusual), dotted, "no_type"), fixed(own.where("own_class is null"), dotted, "no_type"),
        fixed(made.where("receiver = 'super()'"), dotted, "no_type"), fixed(made.where("kind = 'chained'").where(unusual), F.col("name"), "dynamic"), fixed(made.where("kind = 'dynamic'"), F.col("name"), "dynamic"),
        fixed(made.where("kind = 'parse_failure'"), F.col("name"), "parse_failure"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def call_graph(functions: DataFrame, imported: DataFrame, made: DataFrame, builtins: tuple[str, ...] = BUILTINS, common: tuple[str, ...] = COMMON_METHODS) -> CallGraph:
    """The call graph of functions (id, name, class_name, parent_id, file_path, start_line), imports (path, name, target) and calls.

    A plain name is the one function of that name in the caller's file that is in no class (if there are several, the one
    that isn't nested), else what the file imports by it.  On self or cls it is the class's own method, or nothing at
    all.  On another name it is by import, if the file imports that name; else a method of any class that the name may
    hold, of the file or imported, if there is exactly one over all these classes.  Calls of builtins, on builtin modules, and
    of common methods on receivers of no known type are left out, and calls of oneself.

    Reasons: ambiguous, import_failed, unresolved, no_type (no class of the receiver has it; candidates are the classes),
    dynamic, parse_failure, regex_fallback.  Edges are exact, but for those that a pattern found in code that can't be
    parsed (low).  Null names are no calls; ids of functions are unique; tables without rows give an empty graph."""
    asked = stored(_asked(functions, imported, made, builtins, common))
    found = resolved_targets(asked.where("target is not null"), functions)
    met = asked.join(found, ["target", "name"], "left").withColumn("hits", F.when(F.col("callee").isNotNull(), F.array_append("own", F.col("callee"))).otherwise(F.col("own")))
    one = met.groupBy("caller", "name", "shown", "how", "reason", "types").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    one = one.withColumns({"callee": F.when(F.size("hits") == 1, F.get("hits", F.lit(0))), "confidence": F.lit("exact"), "reason": F.when(F.size("hits") > 1, "ambiguous").otherwise(F.col("reason"))})
    same = functions.groupBy(F.col("file_path").alias("file"), "name").agg(F.collect_list("id").alias("same"))
    text = made.where((F.col("kind") == "text") & ~F.col("name").isin(*builtins)).join(same, ["file", "name"], "left")
    text = text.withColumn("hits", F.array_sort(F.array_except(F.coalesce("same", F.array().cast("array<string>")), F.array("caller"))))
    guessed = text.select("caller", "name", F.col("name").alias("shown"), F.lit("text").alias("how"), F.lit("regex_fallback").alias("reason"), F.array().cast("array<string>").alias("types"), "hits", F.when(F.size("hits") == 1, F.get("hits", F.lit(0))).alias("callee"), F.lit("low").alias("confidence"))
    every = stored(one.unionByName(guessed))
    edges = every.where("callee is not null and callee <> caller").groupBy("caller", "callee").agg(F.min("confidence").alias("confidence")).select("caller", "callee", F.lit("call").alias("kind"), "confidence")
    named = functions.where("class_name is null").select("name", "id")
    open_ = every.where("callee is null")
    by_name = open_.where("how = 'name' and reason <> 'ambiguous'")
    holders = named.join(by_name.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("holders"))
    plain = by_name.join(holders, "name", "left").select("caller", F.col("shown").alias("callee_name"), F.when((F.col("reason") == "unresolved") & (F.col("holders") > 1), "ambiguous").otherwise(F.col("reason")).alias("reason"), "hits", F.when(F.col("holders") > 0, F.col("name")).alias("open_name"))
    rest = open_.where("how <> 'name' or reason = 'ambiguous'").select("caller", F.col("shown").alias("callee_name"), "reason", F.when(F.col("reason") == "no_type", F.array_sort("types")).otherwise(F.col("hits")).alias("hits"), F.lit(None).cast("string").alias("open_name"))
    unresolved = plain.unionByName(rest).withColumnRenamed("hits", "candidates").select("caller", "callee_name", "reason", "candidates", "open_name").distinct()
    return CallGraph(edges, unresolved, named)


#: calls that one copy of a name's list is put to
CALLS_A_LIST = 1000


def with_candidates(graph: CallGraph) -> DataFrame:
    """The unresolved calls with all candidates in one list each: for showing some of them; a name that many functions bear makes long rows.

    Calls of a common name are dealt to copies of its list, a thousand to each, so that its long rows are made in many tasks."""
    calls = stored(graph.unresolved)
    copies = calls.where("open_name is not null").groupBy("open_name").agg(F.ceil(F.count("*") / CALLS_A_LIST).cast("int").alias("copies"))
    lists = graph.named.withColumnRenamed("name", "open_name").join(copies, "open_name").groupBy("open_name", "copies").agg(F.array_sort(F.collect_set("id")).alias("more"))
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by a number of partitions, as Spark puts small ones together, and these are small before their lists come
    lists = lists.select("open_name", "more", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).repartition(parts, "open_name", "copy")
    asked = calls.where("open_name is not null").join(copies, "open_name").withColumn("copy", F.pmod(F.xxhash64("caller", "callee_name"), F.col("copies")).cast("int")).repartition(parts, "open_name", "copy")
    shown = asked.join(lists, ["open_name", "copy"], "left").select("caller", "callee_name", "reason", F.coalesce("more", "candidates").alias("candidates"))
    return shown.unionAll(calls.where("open_name is null").select("caller", "callee_name", "reason", "candidates"))
