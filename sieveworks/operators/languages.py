"""Call graphs of C, JavaScript and Go, by joins over the tables that their parsers give.

A call is looked up in scopes, one after another: its file, what the file includes or imports, its package, the
class that a receiver has.  The first scope that knows the name decides: one function there is an edge, several
make the call ambiguous.  As in `resolve`, what merely bears the name elsewhere is a relation of names
and never an edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored
from .resolve import CallGraph

# Functions of the C library and words that look like calls, which are no edges.
C_LIBRARY = tuple(
    """printf fprintf sprintf snprintf vprintf vfprintf vsprintf vsnprintf scanf fscanf sscanf malloc calloc realloc free fopen fclose fread fwrite fgets fputs fseek ftell rewind fflush feof ferror puts getchar putchar
    getc putc ungetc perror memcpy memset memmove memcmp memchr strlen strcmp strncmp strcpy strncpy strcat strncat strstr strchr strrchr strtok strerror strdup strndup atoi atol atof strtol strtoul strtoll
    strtoull strtod strtof exit abort _exit atexit qsort bsearch abs labs getenv setenv system assert sizeof offsetof typeof alignof __builtin_expect __builtin_unreachable va_start va_end va_arg va_copy
    close read write open lseek mmap munmap mprotect socket bind listen accept connect send recv sendto recvfrom select poll epoll_create epoll_ctl epoll_wait fork exec execve execvp waitpid
    pthread_create pthread_join pthread_mutex_lock pthread_mutex_unlock signal sigaction std move forward make_shared make_unique static_cast dynamic_cast reinterpret_cast const_cast new delete""".split()
)
C_SOURCES = (".c", ".cpp", ".cc", ".cxx")
# Objects and words of JavaScript whose calls are no edges.
JS_OBJECTS = tuple(
    """console Math JSON Object Array String Number Boolean Date RegExp Error Promise Map Set WeakMap WeakSet Symbol Proxy Reflect Buffer process global window document localStorage sessionStorage fetch
    XMLHttpRequest WebSocket URL URLSearchParams FormData Headers Request Response""".split()
)
JS_WORDS = tuple(
    """if else for while do switch case break continue return throw try catch finally function class const let var new delete typeof instanceof in of await async yield import export default from as super
    extends require parseInt parseFloat isNaN isFinite encodeURI decodeURI encodeURIComponent decodeURIComponent eval setTimeout setInterval clearTimeout clearInterval setImmediate clearImmediate queueMicrotask""".split()
)
#: what a module's path is tried with, in this order
JS_ENDINGS = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")
#: how many letters of an import path select the files that may hold it
_GRAM = 8
#: macros that stand for macros are followed so far
_ALIASES = 16
_KEY = ("caller", "call", "level")


def _none() -> Column:
    return F.array().cast("array<string>")


def _last(name: str, mark: str) -> Column:
    return F.element_at(F.split(name, mark), -1)


def _suffixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(text, k, F.length(text)))


def _set(kind: str, *parts: Column | str) -> Column:
    """The name of what a scope has under a name."""
    return F.concat_ws(" ", F.lit(kind), *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts))


def _hits(rows: DataFrame, one: int, several: int | None, name: str = "set") -> DataFrame:
    """The calls with the set that a scope has for them, and the scope's rank if that is one function, or several (None: it says nothing then)."""
    return rows.select(*_KEY, F.col(name).alias("set"), F.lit(one).alias("one"), F.lit(several).cast("int").alias("several"))


def _graph(asked: DataFrame, hits: list[DataFrame], members: list[DataFrame], named: DataFrame, own: bool = False) -> CallGraph:
    """The graph of calls and what scopes know of them.

    asked: caller, call (what stands there), level (of a call that stands for others, the deepest counts), shown, reason (if
    no scope knows it; null: not told), fixed (whether the reason stays, however many bear the name), open_name, candidates.
    hits: caller, call, level, set, one and several (the scope's rank, see _hits).  members: set, callee.  A set belongs to a scope and a
    name, and all calls that ask for it share it, so calls and functions of one name are never paired.  own: calls of oneself are edges."""
    asked = stored(asked.distinct())
    every = stored(reduce(DataFrame.unionByName, [m.select("set", "callee") for m in members]).distinct())
    sizes = every.groupBy("set").agg(F.count("*").alias("n"), F.min("callee").alias("first"))
    met = reduce(DataFrame.unionByName, hits).distinct().join(sizes, "set").withColumn("rank", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("several"))).where("rank is not null")
    best = met.groupBy(*_KEY).agg(F.min_by(F.struct("set", "n", "first"), "rank").alias("l"))
    one = stored(asked.join(best, [*_KEY], "left").withColumn("callee", F.when(F.col("l.n") == 1, F.col("l.first"))))
    deepest = one.where("callee is not null").groupBy("caller", "call").agg(F.max("level").alias("stop"))
    told = one.join(deepest, ["caller", "call"], "left")
    edges = told.where("level = stop" if own else "level = stop and callee <> caller").select("caller", "callee", F.lit("call").alias("kind"), F.lit("exact").alias("confidence")).distinct()
    open_ = told.where("callee is null and (stop is null or level > stop)")
    several = F.coalesce(F.col("l.n") > 1, F.lit(False))
    wanted = open_.where(~several & F.col("reason").isNotNull())
    holders = named.join(wanted.select(F.col("open_name").alias("name")).distinct(), "name", "left_semi").groupBy(F.col("name").alias("open_name")).agg(F.count_distinct("id").alias("holders"))
    plain = wanted.join(holders, "open_name", "left")
    reason = F.when((F.col("holders") > 1) & ~F.col("fixed"), "ambiguous").otherwise(F.col("reason"))
    rest = plain.select("caller", F.col("shown").alias("callee_name"), reason.alias("reason"), "candidates", F.when(F.col("holders") > 0, F.col("open_name")).alias("open_name"))
    listed = open_.where(several).select("caller", F.col("shown").alias("callee_name"), F.lit("ambiguous").alias("reason"), _none().alias("candidates"), F.col("l.set").alias("open_name"))
    shared = every.join(sizes.where("n > 1").select("set"), "set", "left_semi").select(F.col("set").alias("name"), F.col("callee").alias("id"))
    return CallGraph(edges, rest.unionByName(listed).distinct(), named.unionByName(shared).distinct())


def c_graph(functions: DataFrame, includes: DataFrame, prototypes: DataFrame, aliases: DataFrame, calls: DataFrame, library: tuple[str, ...] = C_LIBRARY) -> CallGraph:
    """The call graph of C and C++.

    functions: id, name (perhaps with a namespace), file_path.  includes: file, header.  prototypes: name.  aliases: name,
    value (macros that are another name).  calls: caller, name; a null name is a call by pointer.

    A macro's value is looked up before its name.  Scopes: the file; the files that end with a header that the file includes;
    for a name with a prototype, its one definition in a source file.  Library functions and calls of oneself are left out.
    Repeated rows count once."""
    f = functions.select("id", "name", "file_path", _last("name", "::").alias("base"))
    home = functions.select(F.col("id").alias("caller"), F.col("file_path").alias("file"))
    asks = ~F.col("name").isin(*library)
    made = calls.where(asks).select("caller", F.col("name").alias("call"), "name", F.lit(0).alias("level")).distinct()
    levels, known = [made], aliases.where("name <> value").select("name", "value").distinct()
    for k in range(1, _ALIASES + 1):
        deeper = levels[-1].join(known, "name").select("caller", "call", F.col("value").alias("name"), F.lit(k).alias("level")).where(asks & (F.col("name") != F.col("call")))
        deeper = stored(deeper)
        if deeper.isEmpty():
            break
        levels.append(deeper)
    asked = stored(reduce(DataFrame.unionByName, levels).join(home, "caller"))
    here, there = asked.withColumn("set", _set("file", "file", "name")), asked.withColumn("set", _set("included", "file", "name"))
    questions = asked.select("file", "name").distinct()
    in_file = questions.join(f.select(F.col("file_path").alias("file"), F.col("base").alias("name"), F.col("id").alias("callee")), ["file", "name"]).withColumn("set", _set("file", "file", "name"))
    files = f.where("file_path <> ''").select("file_path").distinct().select(F.col("file_path").alias("other"), F.explode(_suffixes(F.col("file_path"))).alias("header"))
    scope = includes.select("file", "header").distinct().join(files, "header").select("file", "other").distinct()
    included = questions.join(scope, "file").join(f.select(F.col("file_path").alias("other"), F.col("base").alias("name"), F.col("id").alias("callee")), ["other", "name"]).withColumn("set", _set("included", "file", "name"))
    bearers = f.select(F.col("base").alias("name"), "id", "file_path").unionByName(f.where("name <> base").select("name", "id", "file_path"))
    sources = bearers.where(F.lower(F.regexp_extract("file_path", r"(\.[^./]*)$", 1)).isin(*C_SOURCES))
    defined = sources.join(prototypes.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("callee"))
    declared = prototypes.select("name", F.lit(True).alias("declared")).distinct()
    definition = _set("definition", "name")
    by_definition, only = asked.withColumn("set", definition), defined.where("n = 1").withColumn("set", definition)
    both = asked.join(declared, "name", "left").join(defined.select("name", "n"), "name", "left")
    several = F.coalesce(F.col("n") > 1, F.lit(False))
    plain = both.select(
        *_KEY, F.col("name").alias("shown"), F.when(several, "ambiguous").otherwise("unresolved").alias("reason"), F.coalesce("declared", F.lit(False)).alias("fixed"),
        F.when(several, F.concat(F.lit("definition "), "name")).otherwise(F.col("name")).alias("open_name"), _none().alias("candidates"),
    )
    pointers = calls.where("name is null").select("caller", F.lit("(*fn)").alias("call"), F.lit(0).alias("level"), F.lit("(*fn)").alias("shown"), F.lit("function_pointer").alias("reason"), F.lit(True).alias("fixed"), F.lit(None).cast("string").alias("open_name"), _none().alias("candidates"))
    named = bearers.select("name", "id").unionByName(sources.select(F.concat(F.lit("definition "), "name").alias("name"), "id"))
    return _graph(plain.unionByName(pointers), [_hits(here, 0, 0), _hits(there, 1, 1), _hits(by_definition, 2, None)], [in_file, included, only], named.distinct())


def folded(folder: Column, path: Column) -> Column:
    """A relative path in a folder, without `.` and `..`; one that leaves the root stays there."""
    steps = F.filter(F.split(F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path)), "/"), lambda s: (s != "") & (s != "."))
    up = F.aggregate(steps, _none(), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    return F.array_join(up, "/")


def resolved_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, source, imported, reason): the file (path) that an import's source is.

    A source that begins with a dot or slash is folded into the importing file's folder, then tried as it is, with each ending of
    a module and as a folder's index.  Others are external (reason); such that no file fits are unresolved."""
    asked = imports.select("file", "source").where("source is not null").distinct()
    inner = F.col("source").startswith(".") | F.col("source").startswith("/")
    folder = F.regexp_extract("file", r"(?s)^(.*)/[^/]*$", 1)
    path = folded(folder, F.col("source"))
    tried = asked.where(inner).select("file", "source", F.posexplode(F.array(*(F.concat(path, F.lit(e)) for e in JS_ENDINGS))).alias("k", "path"))
    found = tried.join(files.select("path").distinct(), "path").groupBy("file", "source").agg(F.min_by("path", "k").alias("imported"))
    reason = F.when(~inner, "external").when(F.col("imported").isNull(), "unresolved")
    return asked.join(found, ["file", "source"], "left").select("file", "source", "imported", reason.alias("reason"))


def javascript_graph(functions: DataFrame, imports: DataFrame, deps: DataFrame, bases: DataFrame, calls: DataFrame) -> CallGraph:
    """The call graph of JavaScript and TypeScript.

    functions: id (file:name), name, class_name.  imports: file, name, source, original (the name there, or null).  deps: file,
    class_name, field, type, kind: the classes that a class's constructor or fields are given.  bases: file, class_name, base.
    calls: caller, kind (name, this, method, new), name, receiver.

    A name is of its file, else of the imported files, whose path holds the import's source; on this, the class's own
    method; on an injected receiver, the method of its class, or of the one class that extends or implements it; new is the
    one constructor or function of the name, else that of the file.  Repeated rows count once."""
    file_of = lambda c: F.substring_index(c, ":", 1)
    f = functions.select("id", _last("name", r"\.").alias("name"), "class_name", file_of("id").alias("file"))
    own = functions.select(F.col("id").alias("caller"), F.col("class_name").alias("own_class"), file_of("id").alias("file"))
    asked = stored(calls.select("caller", "kind", "name", "receiver").distinct().join(own, "caller"))
    base = lambda rows, shown: rows.withColumns({"call": shown, "level": F.lit(0)})
    callee = f.select("file", "name", F.col("id").alias("callee"))
    plain = base(asked.where((F.col("kind") == "name") & ~F.col("name").isin(*JS_WORDS)), F.col("name"))
    in_file = plain.select("file", "name").distinct().join(callee, ["file", "name"]).withColumn("set", _set("file", "file", "name"))
    missing = plain.join(callee.select("file", "name").distinct(), ["file", "name"], "left_anti")
    source = F.regexp_replace("source", r"^\./", "")
    # what a file imports by a name, of one source or of several, is one set
    sources = imports.select("file", "name", F.struct(F.coalesce("original", "name").alias("original"), source.alias("within")).alias("part")).groupBy("file", "name").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    within = F.array_join(F.transform("parts", lambda p: F.concat_ws(" ", p["original"], p["within"])), " ")
    brought = missing.join(sources, ["file", "name"]).withColumn("set", _set("import", within))
    parts = stored(brought.select("set", "parts").distinct().select("set", F.explode("parts").alias("part")).select("set", "part.*"))
    asks = parts.select("original", "within").where("within <> ''").distinct().withColumn("n", F.least(F.length("within"), F.lit(_GRAM))).withColumn("gram", F.substring("within", F.lit(1), F.col("n")))
    held = f.select(F.col("name").alias("original"), F.col("id").alias("callee"), F.translate("file", "\\", "/").alias("at")).join(asks.select("original", "n").distinct(), "original").where(F.length("at") >= F.col("n"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("at") - F.col("n") + 1), lambda k: F.substring("at", k, F.col("n"))))
    fits = asks.join(held.select("original", "n", "callee", "at", F.explode(grams).alias("gram")), ["original", "n", "gram"]).where(F.contains("at", "within")).select("original", "within", "callee").distinct()
    by_import = parts.join(fits, ["original", "within"])
    on_this = base(asked.where("kind = 'this'"), F.concat(F.lit("this."), "name"))
    on_this = on_this.withColumn("callee", F.concat("file", F.lit(":"), "own_class", F.lit("."), "name")).withColumn("set", _set("id", "callee"))
    mine = on_this.select("set", "callee").distinct().join(functions.select(F.col("id").alias("callee")), "callee")
    dotted = F.concat("receiver", F.lit("."), "name")
    on = base(asked.where((F.col("kind") == "method") & (F.col("receiver") != "this") & ~F.col("receiver").isin(*JS_OBJECTS)), dotted)
    injected = deps.groupBy("file", F.col("class_name").alias("own_class"), F.col("field").alias("receiver")).agg(F.min_by("type", F.when(F.col("kind") == "constructor", 0).otherwise(1)).alias("type"))
    typed = stored(on.join(injected, ["file", "own_class", "receiver"]))
    methods = f.where("class_name is not null").select("file", "name", "class_name", F.col("id").alias("callee"))
    questions = typed.select("type", "name").distinct()
    exact = questions.join(methods.select("name", F.col("class_name").alias("type"), "callee"), ["name", "type"]).withColumn("set", _set("method", "type", "name"))
    heirs = bases.select(F.col("base").alias("type"), F.col("file").alias("_file"), F.col("class_name").alias("_class")).distinct()
    nominal = questions.join(heirs, "type").join(methods.select(F.col("file").alias("_file"), F.col("class_name").alias("_class"), "name", "callee"), ["_file", "_class", "name"]).withColumn("set", _set("heirs", "type", "name"))
    # one method of the class counts, else one of its heirs; if there is neither, the class's own are shown before the heirs'
    by_type = [_hits(typed.withColumn("set", _set("method", "type", "name")), 0, 2), _hits(typed.withColumn("set", _set("heirs", "type", "name")), 1, 3)]
    fresh = base(asked.where((F.col("kind") == "new") & ~F.col("name").isin(*JS_WORDS, *JS_OBJECTS)), F.concat(F.lit("new "), "name"))
    builders = f.select("name", "id", "file").unionByName(f.where("name = 'constructor'").select(F.regexp_extract("id", r":([^:.]+)\.", 1).alias("name"), "id", "file")).distinct()
    made = builders.join(fresh.select("name").distinct(), "name", "left_semi").select(_set("new", "name").alias("set"), F.col("id").alias("callee"))
    made_here = fresh.select("name", "file").distinct().join(builders.select("name", "file", F.col("id").alias("callee")), ["name", "file"]).withColumn("set", _set("new in", "file", "name"))
    shown = lambda rows, reason, fixed, open_name: rows.select(*_KEY, F.col("call").alias("shown"), reason.alias("reason"), F.lit(fixed).alias("fixed"), open_name.alias("open_name"), _none().alias("candidates"))
    nowhere = F.lit(None).cast("string")
    tried = imports.select("file", "name", F.lit(True).alias("imported")).distinct()
    rows = [
        shown(plain.join(tried, ["file", "name"], "left").where("imported"), F.lit("import_failed"), True, nowhere), shown(plain.join(tried, ["file", "name"], "left_anti"), F.lit("unresolved"), False, F.col("name")), shown(on_this, nowhere, True, nowhere),
        shown(on, F.lit("no_type"), True, F.col("name")), shown(fresh, F.lit("unresolved"), False, F.concat(F.lit("new "), "name")),
    ]
    named = f.select("name", "id").unionByName(builders.select(F.concat(F.lit("new "), "name").alias("name"), "id")).distinct()
    hits = [
        _hits(plain.withColumn("set", _set("file", "file", "name")), 0, 0), _hits(brought, 1, 1), _hits(on_this, 0, 0), *by_type, _hits(fresh.withColumn("set", _set("new", "name")), 0, None), _hits(fresh.withColumn("set", _set("new in", "file", "name")), 1, None),
    ]
    return _graph(reduce(DataFrame.unionByName, rows), hits, [in_file, by_import, mine, exact, nominal, made, made_here], named, own=True)


def go_graph(functions: DataFrame, imports: DataFrame, calls: DataFrame) -> CallGraph:
    """The call graph of Go.

    functions: id (file:name or file:Type.name), name, class_name (the receiver's type), package, file_path, receiver (its
    parameter).  imports: file, alias, path.  calls: caller, name, receiver, package (the qualifier, if the file imports it),
    is_method.

    On the receiver's own parameter or type it is that type's method; on another type, that type's, pointer or not; on a
    package it is the function of the package that the import's path ends with, or names; a plain name is of the file, else of the package's
    files in its folder.  A type with two methods of the name, or none, says no more than that there is no type; a result's method is
    dynamic.  Repeated rows count once."""
    folder = lambda c: F.regexp_extract(c, r"(?s)^(.*)/[^/]*$", 1)
    bare = lambda c: F.regexp_replace(c, r"^\*", "")
    own = functions.select(F.col("id").alias("caller"), F.col("class_name").alias("own_class"), F.col("receiver").alias("parameter"), F.col("package").alias("own_package"), F.col("file_path").alias("file"))
    asked = stored(calls.select("caller", "name", F.coalesce("receiver", F.lit("")).alias("receiver"), F.coalesce("package", F.lit("")).alias("qualifier"), "is_method").distinct().join(own, "caller"))
    has = F.coalesce(F.col("own_class"), F.lit("")) != ""
    result = F.col("receiver") == "~call_result~"
    self_ = ~result & has & F.col("is_method") & (((F.col("qualifier") == "") & (F.col("receiver") == F.coalesce("parameter", F.lit(""))) & (F.col("receiver") != "")) | ((F.col("receiver") != "") & (F.col("receiver") == F.col("own_class"))))
    kind = F.when(result, "result").when(self_, "self").when(F.col("is_method") & (F.col("receiver") != "") & (F.col("qualifier") == ""), "typed").when(F.col("qualifier") != "", "package").otherwise("plain")
    shown = F.when(kind == "plain", F.col("name")).when(kind == "package", F.concat("qualifier", F.lit("."), "name")).otherwise(F.concat("receiver", F.lit("."), "name"))
    asked = asked.withColumns({"kind": kind, "call": shown, "level": F.lit(0)})
    methods = functions.where("class_name <> ''").select(F.col("class_name").alias("type"), "name", F.col("id").alias("callee"))
    of_type = asked.where("kind in ('self', 'typed')").withColumn("asked_type", F.when(F.col("kind") == "self", F.col("own_class")).otherwise(F.col("receiver")))
    types = of_type.withColumn("type", F.explode(F.array_distinct(F.array("asked_type", bare("asked_type")))))
    by_type = types.select("asked_type", "type", "name").distinct().join(methods, ["type", "name"]).withColumn("set", _set("type", "asked_type", "name"))
    all_types = methods.select("type").distinct()
    known = types.where("type = asked_type").join(all_types, "type", "left_semi").select(*_KEY, F.lit(True).alias("is_type"))
    pointer = types.where("type <> asked_type").join(all_types, "type", "left_semi").select(*_KEY, F.lit(True).alias("is_pointer"))
    met = of_type.join(known.distinct(), [*_KEY], "left").join(pointer.distinct(), [*_KEY], "left")
    silent = (F.col("kind") == "typed") & F.col("is_type").isNull() & F.col("is_pointer").isNotNull()
    nowhere = F.lit(None).cast("string")
    all_methods = F.when(F.col("is_type").isNotNull() | (F.col("kind") == "self"), F.concat(F.lit("methods of "), "asked_type"))
    # what a file imports by an alias, of one path or of several, is one set
    paths = imports.select("file", F.col("alias").alias("qualifier"), "path").groupBy("file", "qualifier").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    base = asked.where("kind = 'package'").join(paths, ["file", "qualifier"]).withColumn("set", _set("package", "qualifier", "name", F.array_join("paths", " ")))
    packages = base.select("set", "qualifier", "name", F.explode("paths").alias("path")).distinct().withColumn("package", F.explode(F.array_distinct(F.array(_last("path", "/"), "qualifier", "path"))))
    by_package = packages.join(functions.select("package", "name", F.col("id").alias("callee")), ["package", "name"])
    top = functions.where("coalesce(class_name, '') = ''").select(F.col("file_path").alias("file"), folder(F.col("file_path")).alias("folder"), "name", F.col("package").alias("_package"), F.col("id").alias("callee"))
    plain = asked.where("kind = 'plain'")
    here = plain.select("file", "name").distinct().join(top.select("file", "name", "callee"), ["file", "name"]).withColumn("set", _set("file", "file", "name"))
    plain = plain.withColumn("folder", folder(F.col("file"))).withColumn("set", _set("near", "folder", "own_package", "name"))
    near = plain.select("set", "folder", "name", "own_package").distinct().join(top.select("folder", "name", "_package", "callee"), ["folder", "name"])
    near = near.where("coalesce(_package, '') = '' or coalesce(own_package, '') = '' or _package = own_package")
    told = lambda rows, reason, fixed, open_name: rows.select(*_KEY, F.col("name").alias("shown"), reason.alias("reason"), F.lit(fixed).alias("fixed"), open_name.alias("open_name"), _none().alias("candidates"))
    rows = [
        told(asked.where("kind = 'result'"), F.lit("dynamic"), True, nowhere), told(met, F.when(silent, nowhere).otherwise("no_type"), True, all_methods), told(asked.where("kind = 'package'"), F.lit("import_failed"), True, nowhere),
        told(plain, F.lit("unresolved"), False, F.col("name")),
    ]
    named = functions.select("name", "id").unionByName(functions.where("class_name <> ''").select(F.concat(F.lit("methods of "), "class_name").alias("name"), "id")).distinct()
    hits = [_hits(of_type.withColumn("set", _set("type", "asked_type", "name")), 0, None), _hits(base, 0, 0), _hits(plain.withColumn("set", _set("file", "file", "name")), 0, 0), _hits(plain, 1, 1)]
    return _graph(reduce(DataFrame.unionByName, rows), hits, [by_type, by_package, here, near], named)
