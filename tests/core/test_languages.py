"""Calls of C, JavaScript and Go over small tables, scope by scope."""

from sieveworks.operators import languages, resolve


def shown(graph):
    edges = {(r.caller, r.callee) for r in graph.edges.collect()}
    return edges, {(r.caller, r.callee_name): (r.reason, list(r.candidates)) for r in resolve.with_candidates(graph).collect()}


def test_c(spark):
    table = spark.createDataFrame
    functions = table([
        ("a.c:main", "main", "a.c"), ("a.c:own", "own", "a.c"), ("a.c:two", "two", "a.c"), ("a.c:n::two", "n::two", "a.c"), ("inc/x.h:inl", "inl", "inc/x.h"), ("inc/x.h:both", "both", "inc/x.h"), ("lib/y.h:both", "both", "lib/y.h"),
        ("lib/y.h:deep", "deep", "lib/y.h"), ("d.c:declared", "declared", "d.c"), ("d.h:declared", "declared", "d.h"), ("d.c:twice", "twice", "d.c"), ("e.cpp:twice", "twice", "e.cpp"), ("d.h:headed", "headed", "d.h"), ("z.c:far", "far", "z.c"),
        ("z.c:far2", "m::far2", "z.c"), ("zz.c:far2", "far2", "zz.c"),
    ], "id string, name string, file_path string")
    includes = table([("a.c", "x.h"), ("a.c", "lib/y.h"), ("a.c", "missing.h"), ("b.c", "z.c")], "file string, header string")
    prototypes = table([("declared",), ("twice",), ("headed",), ("declared",)], "name string")
    aliases = table([("OWN", "own"), ("DEEP", "MID"), ("MID", "deep"), ("LOST", "nowhere"), ("PRINT", "printf"), ("LOOP", "LOOP2"), ("LOOP2", "LOOP")], "name string, value string")
    asked = ["own", "two", "inl", "both", "declared", "twice", "headed", "far", "far2", "printf", "none", "OWN", "DEEP", "LOST", "PRINT", "LOOP", "main", None, "own"]
    edges, lost = shown(languages.c_graph(functions, includes, prototypes, aliases, table([("a.c:main", n) for n in asked], "caller string, name string")))
    assert edges == {("a.c:main", c) for c in ("a.c:own", "inc/x.h:inl", "d.c:declared", "lib/y.h:deep")}
    assert {k[1]: v for k, v in lost.items()} == {
        "two": ("ambiguous", ["a.c:n::two", "a.c:two"]), "both": ("ambiguous", ["inc/x.h:both", "lib/y.h:both"]), "twice": ("ambiguous", ["d.c:twice", "e.cpp:twice"]), "headed": ("unresolved", ["d.h:headed"]), "far": ("unresolved", ["z.c:far"]),
        "far2": ("ambiguous", ["z.c:far2", "zz.c:far2"]), "none": ("unresolved", []), "LOST": ("unresolved", []), "nowhere": ("unresolved", []), "PRINT": ("unresolved", []), "LOOP": ("unresolved", []), "LOOP2": ("unresolved", []), "(*fn)": ("function_pointer", []),
    }


JS = [
    ("call.ts:Ctl.get", "Ctl.get", "Ctl"), ("call.ts:Ctl.own", "Ctl.own", "Ctl"), ("call.ts:local", "local", None), ("svc.ts:CallService.getById", "CallService.getById", "CallService"), ("svc.ts:CallService.remove", "CallService.remove", "CallService"),
    ("v2.ts:CallServiceV2.getById", "CallServiceV2.getById", "CallServiceV2"), ("impl.ts:CallImpl.find", "CallImpl.find", "CallImpl"), ("impl2.ts:Other.find", "Other.find", "Other"), ("impl3.ts:Third.find", "Third.find", "Third"), ("lib/util.js:helper", "helper", None),
    ("lib2/util.js:helper", "helper", None), ("lib/one.js:single", "single", None), ("lib/model.js:Model.constructor", "Model.constructor", "Model"), ("lib/model.js:Box", "Box", None), ("x.js:Box", "Box", None), ("call.ts:Pair", "Pair", None), ("x.js:Pair", "Pair", None),
]


def test_javascript(spark):
    """Injected services by class, by the one class that implements an interface; names by import, alone, or not at all."""
    table = spark.createDataFrame
    functions = table(JS, "id string, name string, class_name string")
    imports = table([("call.ts", "helper", "./lib/util", None), ("call.ts", "alias", "./lib/one", "single"), ("call.ts", "gone", "./nowhere", None), ("call.ts", "unique", "b/util", "helper"), ("call.ts", "several", "/util.j", "helper")], "file string, name string, source string, original string")
    deps = table([("call.ts", "Ctl", "svc", "CallService", "constructor"), ("call.ts", "Ctl", "svc", "Wrong", "field"), ("call.ts", "Ctl", "finder", "IFind", "field"), ("call.ts", "Ctl", "many", "IMany", "field"), ("call.ts", "Ctl", "odd", "Nobody", "field")], "file string, class_name string, field string, type string, kind string")
    bases = table([("impl.ts", "CallImpl", "IFind"), ("impl2.ts", "Other", "IMany"), ("impl3.ts", "Third", "IMany")], "file string, class_name string, base string")
    asked = [
        ("this", "own", None), ("this", "nothing", None), ("name", "local", None), ("name", "helper", None), ("name", "alias", None), ("name", "gone", None), ("name", "unique", None), ("name", "several", None), ("name", "single", None), ("name", "setTimeout", None), ("name", "none", None),
        ("method", "getById", "svc"), ("method", "find", "finder"), ("method", "find", "many"), ("method", "find", "odd"), ("method", "remove", "x"), ("method", "zzz", "x"), ("method", "log", "console"), ("new", "Model", None), ("new", "Box", None), ("new", "Pair", None),
        ("new", "Map", None), ("new", "Nothing", None),
    ]
    edges, lost = shown(languages.javascript_graph(functions, imports, deps, bases, table([("call.ts:Ctl.get", *a) for a in asked], "caller string, kind string, name string, receiver string")))
    assert {c for _, c in edges} == {"call.ts:Ctl.own", "call.ts:local", "lib/one.js:single", "lib/util.js:helper", "svc.ts:CallService.getById", "impl.ts:CallImpl.find", "lib/model.js:Model.constructor", "call.ts:Pair"}
    assert {k[1]: v for k, v in lost.items()} == {
        "gone": ("import_failed", []), "several": ("ambiguous", ["lib/util.js:helper", "lib2/util.js:helper"]), "single": ("unresolved", ["lib/one.js:single"]), "none": ("unresolved", []), "many.find": ("ambiguous", ["impl2.ts:Other.find", "impl3.ts:Third.find"]),
        "odd.find": ("no_type", ["impl.ts:CallImpl.find", "impl2.ts:Other.find", "impl3.ts:Third.find"]), "x.remove": ("no_type", ["svc.ts:CallService.remove"]), "x.zzz": ("no_type", []), "new Box": ("ambiguous", ["lib/model.js:Box", "x.js:Box"]), "new Nothing": ("unresolved", []),
    }


def test_modules(spark):
    """Relative sources are folded, and tried with endings and as a folder's index."""
    table = spark.createDataFrame
    files = table([("src/a.js",), ("src/lib/b.ts",), ("src/lib/index.js",), ("top.jsx",), ("src/x.js",), ("src/x.ts",)], "path string")
    asked = {"./a": "src/a.js", "./lib/b": "src/lib/b.ts", "./lib": "src/lib/index.js", "../top": "top.jsx", "./lib/../a.js": "src/a.js", "./x": "src/x.js", "/top": "top.jsx", "../../../top": "top.jsx", "react": None, "./none": None}
    got = {r.source: (r.imported, r.reason) for r in languages.resolved_modules(table([("src/main.js", s) for s in asked], "file string, source string"), files).collect()}
    assert got == {s: (p, None if p else "external" if s == "react" else "unresolved") for s, p in asked.items()}


def test_go(spark):
    table = spark.createDataFrame
    functions = table([
        ("a/x.go:Run", "Run", None, "a", "a/x.go", None), ("a/x.go:T.Do", "Do", "T", "a", "a/x.go", "t"), ("a/x.go:T.Call", "Call", "T", "a", "a/x.go", "t"), ("a/y.go:near", "near", None, "a", "a/y.go", None), ("a/y_test.go:near2", "near2", None, "a_test", "a/y_test.go", None),
        ("a/y.go:twice", "twice", None, "a", "a/y.go", None), ("a/z.go:twice", "twice", None, "", "a/z.go", None), ("b/q.go:Help", "Help", None, "util", "b/q.go", None), ("c/q.go:Both", "Both", None, "util", "c/q.go", None), ("d/q.go:Both", "Both", None, "util", "d/q.go", None),
        ("b/q.go:P.Go", "Go", "P", "util", "b/q.go", "p"), ("c/q.go:P.Go", "Go", "P", "util", "c/q.go", "p"), ("b/q.go:far", "far", None, "util", "b/q.go", None),
    ], "id string, name string, class_name string, package string, file_path string, receiver string")
    imports = table([("a/x.go", "util", "example.com/x/util"), ("a/x.go", "u2", "example.com/util")], "file string, alias string, path string")
    asked = [
        ("a/x.go:T.Call", "Do", "t", None, True), ("a/x.go:T.Call", "Missing", "t", None, True), ("a/x.go:Run", "Do", "T", None, True), ("a/x.go:Run", "Do", "*T", None, True), ("a/x.go:Run", "Do", "v", None, True), ("a/x.go:Run", "Go", "P", None, True), ("a/x.go:Run", "Go", "*P", None, True),
        ("a/x.go:Run", "near", None, None, False), ("a/x.go:Run", "near2", None, None, False), ("a/x.go:Run", "twice", None, None, False), ("a/x.go:Run", "Help", None, "util", False), ("a/x.go:Run", "Both", None, "u2", False), ("a/x.go:Run", "None", None, "util", False),
        ("a/x.go:Run", "far", None, None, False), ("a/x.go:Run", "gone", None, None, False), ("a/x.go:Run", "then", "~call_result~", None, True), ("a/x.go:Run", "Run", None, None, False),
    ]
    edges, lost = shown(languages.go_graph(functions, imports, table(asked, "caller string, name string, receiver string, package string, is_method boolean")))
    assert edges == {("a/x.go:T.Call", "a/x.go:T.Do"), ("a/x.go:Run", "a/x.go:T.Do"), ("a/x.go:Run", "a/y.go:near"), ("a/x.go:Run", "b/q.go:Help")}
    assert lost[("a/x.go:T.Call", "Missing")] == ("no_type", ["a/x.go:T.Call", "a/x.go:T.Do"]) and lost[("a/x.go:Run", "Do")] == ("no_type", []) and lost[("a/x.go:Run", "Go")] == ("no_type", ["b/q.go:P.Go", "c/q.go:P.Go"])
    assert {k[1]: v for k, v in lost.items() if k[1] not in ("Missing", "Do", "Go")} == {
        "near2": ("unresolved", ["a/y_test.go:near2"]), "twice": ("ambiguous", ["a/y.go:twice", "a/z.go:twice"]), "Both": ("ambiguous", ["c/q.go:Both", "d/q.go:Both"]), "None": ("import_failed", []), "far": ("unresolved", ["b/q.go:far"]), "gone": ("unresolved", []), "then": ("dynamic", []),
    }


def test_ambiguous_calls_share_what_they_mean(spark):
    """Calls that may mean the same functions name one set of them; no call has a list of its own."""
    table = spark.createDataFrame
    rows = [(f"u/f{k}.go:Both", "Both", None, "util", f"u/f{k}.go", None) for k in range(3)] + [(f"a/x{k}.go:Run{k}", f"Run{k}", None, "a", f"a/x{k}.go", None) for k in range(4)]
    functions = table(rows, "id string, name string, class_name string, package string, file_path string, receiver string")
    imports = table([(f"a/x{k}.go", "u", "example.com/util") for k in range(4)], "file string, alias string, path string")
    calls = table([(f"a/x{k}.go:Run{k}", "Both", None, "u", False) for k in range(4)], "caller string, name string, receiver string, package string, is_method boolean")
    graph = languages.go_graph(functions, imports, calls)
    open_ = graph.unresolved.collect()
    assert len(open_) == 4 and {(r.reason, tuple(r.candidates)) for r in open_} == {("ambiguous", ())}
    (name,) = {r.open_name for r in open_}
    assert sorted(r.id for r in graph.named.where(graph.named.name == name).collect()) == [f"u/f{k}.go:Both" for k in range(3)]
