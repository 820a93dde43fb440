"""Python sources to functions, calls and a graph; units of them."""

from sieveworks.operators import code, graph, resolve, units

APP = '''"""An app."""
import os
from lib.util import helper as h
from lib import util
import flask

x = os.environ["A"]


@app.route("/a", methods=["GET", "POST"])
def index(a, *b, c=1, **d):
    """Doc."""
    def inner():
        return h(1)
    inner()
    return _private()


async def _private():
    box = Box()
    box.open()
    util.free()
    unknown()
    return index()


class Box:
    def __init__(self):
        self.open()

    @property
    def size(self):
        return 1

    def open(self):
        (lambda: 0)()
'''
UTIL = "def helper(x):\n    return x\n\n\ndef free():\n    helper(2)\n"
BAD = "def broken(:\n    free()\n"


def files(spark):
    return spark.createDataFrame([("app.py", APP), ("lib/util.py", UTIL), ("bad.py", BAD), ("empty.py", ""), ("none.py", None), ("const.py", '"""doc"""\nimport os\n')], "path string, text string")


def test_functions(spark):
    got = {r.id: r for r in code.functions(files(spark)).collect()}
    kinds = {i: r.unit_type for i, r in got.items()}
    assert kinds == {
        "app.py:index": "route_handler", "app.py:index.inner": "nested_function", "app.py:_private": "private_function", "app.py:Box.__init__": "constructor", "app.py:Box.size": "property", "app.py:Box.open": "method",
        "app.py:__module__": "module_level", "lib/util.py:helper": "function", "lib/util.py:free": "function",
    }
    index = got["app.py:index"]
    assert (index.start_line, list(index.parameters), list(index.decorators), index.docstring) == (10, ["a", "b", "c", "d"], ["@app.route('/a', methods=['GET', 'POST'])"], "Doc.")
    assert got["app.py:_private"].is_async and got["app.py:index.inner"].parent_id == "app.py:index" and "environ" in got["app.py:__module__"].code


def test_imports_and_routes(spark):
    got = {(r.path, r.name): r.target for r in code.imports(files(spark)).collect()}
    assert got[("app.py", "h")] == "lib.util.helper" and got[("app.py", "util")] == "lib.util" and got[("app.py", "os")] == "os"
    (route,) = code.routes(files(spark)).collect()
    assert (route.rule, list(route.methods), route.handler, route.framework) == ("/a", ["GET", "POST"], "index", "decorator")
    more = spark.createDataFrame([("u.py", 'urlpatterns = [path("x/", views.show), re_path("y", z)]\napp.router.add_post("/p", save)\napp.router.add_route("PUT", "/q", put)\n')], "path string, text string")
    assert sorted((r.framework, r.rule, r.handler, tuple(r.methods)) for r in code.routes(more).collect()) == [("router", "/p", "save", ("POST",)), ("router", "/q", "put", ("PUT",)), ("urlconf", "x/", "views.show", ()), ("urlconf", "y", "z", ())]


def test_call_graph(spark):
    edges, open_, _ = resolve.call_graph(*code.sources(files(spark)))
    got = {(r.caller, r.callee): r.confidence for r in edges.collect()}
    assert got == {
        ("app.py:index", "app.py:index.inner"): "exact", ("app.py:index", "lib/util.py:helper"): "exact", ("app.py:index", "app.py:_private"): "exact", ("app.py:index.inner", "lib/util.py:helper"): "exact", ("app.py:_private", "app.py:Box.open"): "exact",
        ("app.py:_private", "lib/util.py:free"): "exact", ("app.py:_private", "app.py:index"): "exact", ("app.py:Box.__init__", "app.py:Box.open"): "exact", ("lib/util.py:free", "lib/util.py:helper"): "exact",
    }
    lost = {(r.caller, r.callee_name): r.reason for r in open_.collect()}
    assert lost[("app.py:_private", "unknown")] == "unresolved" and lost[("app.py:Box.open", "<callable>")] == "dynamic" and lost[("app.py:_private", "Box")] == "unresolved"


ONE = '''import json
import lib.two as two
from lib.two import Foo, make as build
from nowhere import gone


class Bar:
    def only(self):
        return self.size() + self.missing()

    @property
    def size(self):
        return 1

    @size.setter
    def size(self, x):
        super().size(x)

    def both(self):
        pass


class Baz:
    def both(self):
        def only():
            pass


def twice():
    pass


def imported_class():
    Foo.bar()
    Foo.nothing()
    two.free()
    two.Foo()
    json.loads("1")
    print(len("a"))


def typed_by_import(z):
    x = Foo()
    x.bar()
    x.join()
    x.nothing()
    z.go()
    z.strip()
    z.a.go()
    z.a.strip()
    (lambda: 0)()


def union(u):
    y = Foo()
    y = Bar()
    y.only()
    y.both()
    y = Baz()
    y.both()
    w: Foo = build()
    w.bar()
    self.x()
    gone()
    twice()
    common()


def outer():
    def twice():
        pass
    return twice()
'''
TWO = "class Foo:\n    def bar(self):\n        pass\n\n\ndef free():\n    def common():\n        pass\n\n\ndef make():\n    return Foo()\n"
THREE = "def common():\n    pass\n\n\nclass K:\n    def common(self):\n        cls.common()\n"


def classes(spark):
    return spark.createDataFrame([("app/one.py", ONE), ("lib/two.py", TWO), ("three.py", THREE)], "path string, text string")


def test_classes_and_unions(spark):
    """Imported classes, local names by import, unions with one method, builtins and common methods, reasons and shown names."""
    found = resolve.call_graph(*code.sources(classes(spark)))
    got = {(r.caller.split(":")[1], r.callee) for r in found.edges.collect()}
    assert got == {
        ("Bar.only", "app/one.py:Bar.size"), ("imported_class", "lib/two.py:Foo.bar"), ("imported_class", "lib/two.py:free"), ("typed_by_import", "lib/two.py:Foo.bar"), ("union", "lib/two.py:make"), ("union", "app/one.py:twice"), ("outer", "app/one.py:twice"),
    }
    open_ = {(r.caller.split(":")[1], r.callee_name): (r.reason, list(r.candidates)) for r in resolve.with_candidates(found).collect()}
    both = ["app/one.py:Bar.both", "app/one.py:Baz.both"]
    assert open_ == {
        ("Bar.size", "super().size"): ("no_type", []), ("imported_class", "Foo.nothing"): ("import_failed", []), ("imported_class", "two.Foo"): ("import_failed", []),
        ("typed_by_import", "x.join"): ("no_type", ["Foo"]), ("typed_by_import", "x.nothing"): ("no_type", ["Foo"]), ("typed_by_import", "z.go"): ("no_type", []), ("typed_by_import", "go"): ("dynamic", []),
        ("typed_by_import", "<callable>"): ("dynamic", []), ("typed_by_import", "Foo"): ("import_failed", []), ("union", "y.both"): ("ambiguous", both), ("union", "w.bar"): ("ambiguous", ["lib/two.py:Foo.bar", "lib/two.py:make"]), ("union", "y.only"): ("ambiguous", ["app/one.py:Bar.only", "app/one.py:Baz.both.only"]),
        ("union", "Foo"): ("import_failed", []), ("union", "Bar"): ("unresolved", []), ("union", "Baz"): ("unresolved", []), ("union", "self.x"): ("no_type", []), ("union", "gone"): ("import_failed", []),
        ("union", "common"): ("ambiguous", ["lib/two.py:free.common", "three.py:common"]), ("make", "Foo"): ("unresolved", []),
    }


def test_one_method_over_a_union(spark):
    """The methods are asked, not the classes: one method over two classes is an edge."""
    text = "from b import Foo\n\nclass Baz:\n    def only(self):\n        pass\n\ndef f():\n    y = Foo()\n    y = Baz()\n    y.only()\n    y.far()\n"
    rows = spark.createDataFrame([("a.py", text), ("b.py", "class Foo:\n    def far(self):\n        pass\n")], "path string, text string")
    edges, open_, _ = resolve.call_graph(*code.sources(rows))
    assert {(r.caller, r.callee) for r in edges.collect()} == {("a.py:f", "a.py:Baz.only"), ("a.py:f", "b.py:Foo.far")}
    assert {r.callee_name for r in open_.collect()} == {"Foo", "Baz"}


def test_import_paths(spark):
    """The longest file wins, then the module's ending; names that are imported as they are or under another name."""
    rows = spark.createDataFrame([("a/b.py:C.m", "m", "a/b.py"), ("a/b.py:f", "f", "a/b.py"), ("a.py:b.m", "m", "a.py"), ("x/deep/mod.py:g", "g", "x/deep/mod.py"), ("os.py:sep", "sep", "os.py"), ("z.py:solo", "solo", "z.py")], "id string, name string, file_path string")
    asks = [("a.b.C", "m"), ("a.b.f", "f"), ("a.b", "f"), ("a.b", "m"), ("deep.mod.g", "h"), ("mod.g", "h"), ("far.x.deep.mod.g", "h"), ("od.g", "h"), ("other.g", "h"), ("solo", "x"), ("q.f", "q")]
    made = {(r.target, r.name): r.callee for r in resolve.resolved_targets(spark.createDataFrame(asks, "target string, name string"), rows).collect()}
    assert made == {
        ("a.b.C", "m"): "a/b.py:C.m", ("a.b.f", "f"): "a/b.py:f", ("a.b", "f"): "a/b.py:f", ("a.b", "m"): "a.py:b.m", ("deep.mod.g", "h"): "x/deep/mod.py:g", ("mod.g", "h"): "x/deep/mod.py:g", ("far.x.deep.mod.g", "h"): "x/deep/mod.py:g",
        ("od.g", "h"): "x/deep/mod.py:g", ("solo", "x"): "z.py:solo",
    }


def test_open_names_are_one_relation(spark):
    """A visited node's open call by name makes unknown what bears the name, and no more."""
    found = resolve.call_graph(*code.sources(classes(spark)))
    nodes = code.sources(classes(spark)).functions.select("id")
    roots = spark.createDataFrame([("app/one.py:union",)], "id string")
    by_name = found.unresolved.where("callee_name = 'common'")
    status = {r.id: r.status for r in graph.reachability(nodes, found.edges, roots, by_name, found.named).collect()}
    assert status["three.py:common"] == status["lib/two.py:free.common"] == "unknown" and status["lib/two.py:make"] == "reachable" and status["three.py:K.common"] == "unreachable" and set(status) == {r.id for r in nodes.collect()}
    listed = resolve.with_candidates(found).where("callee_name = 'common'")
    assert {r.id: r.status for r in graph.reachability(nodes, found.edges, roots, listed).collect()} == status


def test_unparsable_code_gives_low_edges(spark):
    rows = spark.createDataFrame([("a.py:f", "f", None, None, "a.py", 1, "def f(:\n g()\n h()"), ("a.py:g", "g", None, None, "a.py", 9, "def g():\n pass")], "id string, name string, class_name string, parent_id string, file_path string, start_line int, code string")
    edges, open_, _ = resolve.call_graph(rows, code.imports(rows.selectExpr("file_path as path", "'' as text")), code.calls(rows))
    assert [(r.caller, r.callee, r.confidence) for r in edges.collect()] == [("a.py:f", "a.py:g", "low")]
    assert sorted((r.callee_name, r.reason) for r in open_.collect()) == [("<parse>", "parse_failure"), ("f", "regex_fallback"), ("h", "regex_fallback")]


def test_units(spark):
    rows, imported, made = code.sources(files(spark))
    edges, open_, _ = resolve.call_graph(rows, imported, made)
    tables = units.graph_tables(rows, "python", edges=edges, unresolved=open_)
    nodes = {r.id: r for r in tables["nodes"].collect()}
    assert nodes["app.py:index"].visibility == "public" and nodes["app.py:_private"].visibility == "private" and nodes["app.py:Box.open"].kind == "method" and nodes["app.py:__module__"].kind == "module_init"
    assert units.graph_statistics(tables).first().asDict() == {"nodes": 9, "resolved_edges": 9, "structural_roots": tables["roots"].count(), "unresolved": open_.count()}
    near = units.neighbours(tables["nodes"].select("id"), tables["nodes"], tables["edges"])
    made = {r.id: r for r in units.assembled(tables["nodes"], near).collect()}
    free = made["lib/util.py:free"]
    assert (free.total_up, free.total_down, list(free.files)) == (1, 2, ["app.py", "lib/util.py"]) and free.code.startswith("def free():") and free.code.count("File Boundary") == 3
    go = {r.id: r for r in units.assembled(tables["nodes"], near, "go").collect()}
    assert list(go["lib/util.py:free"].files) == ["lib/util.py"] and go["lib/util.py:free"].code.count("File Boundary") == 1
    total = units.unit_totals(units.assembled(tables["nodes"], near)).first()
    assert total.units == 9 and total.enhanced == 7 and total.mean_up == round(sum(r.total_up for r in made.values()) / 9, 2)
    assert {r.seed: [d.id for d in r.dependencies] for r in units.bundle(tables["nodes"].select("id").where("id like '%free'"), tables["nodes"], tables["edges"]).collect()} == {"lib/util.py:free": ["lib/util.py:helper"]}
    assert units.degree_texts(tables["nodes"], tables["edges"]).first().mean_out == "1.00"
    lists = {r.id: (list(r.calls), list(r.callers)) for r in units.graph_lists(tables["nodes"], tables["edges"]).collect()}
    assert lists["app.py:__module__"] == ([], []) and lists["lib/util.py:free"] == (["lib/util.py:helper"], ["app.py:_private"])
    closure = units.import_closure(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")], "path string, imported string"), 3)
    assert sorted(map(tuple, closure.collect())) == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("a", 3, "d")]
    assert units.import_closure(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a", "b"), ("a", "c")], "path string, imported string"), 3, 2).count() == 2
    assert all(r.isExported for r in units.analyzer_rows(rows, "python").collect())
