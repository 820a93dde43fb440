"""Functions, imports, calls and routes of Python sources, as tables; `resolve` makes a call graph of them.

Parsing a file needs its whole text and the syntax tree, so it runs on Arrow batches, a file at a time.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored

FUNCTIONS = pa.schema([
    ("id", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("class_name", pa.string()), ("parent_id", pa.string()), ("file_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("is_async", pa.bool_()), ("decorators", pa.list_(pa.string())), ("parameters", pa.list_(pa.string())), ("docstring", pa.string()), ("code", pa.string()),
])
FUNCTIONS_DDL = (
    "id string, name string, qualified_name string, class_name string, parent_id string, file_path string, start_line int, end_line int, is_async boolean, decorators array<string>, parameters array<string>, docstring string, code string"
)
IMPORTS = pa.schema([("path", pa.string()), ("name", pa.string()), ("target", pa.string()), ("pos", pa.int32())])
IMPORTS_DDL = "path string, name string, target string, pos int"
CALLS = pa.schema([("caller", pa.string()), ("file", pa.string()), ("own_class", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("receiver", pa.string()), ("types", pa.list_(pa.string()))])
CALLS_DDL = "caller string, file string, own_class string, kind string, name string, receiver string, types array<string>"
_DEFINED = (ast.FunctionDef, ast.AsyncFunctionDef)
_CALL_TEXT = re.compile(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(")
_BREAKS = re.compile("[\t\r\x0b\x0c]")
#: what holds statements in a statement, and what holds no node with a call; both in the order of syntax trees
_BODIES = ("body", "handlers", "orelse", "finalbody", "cases")
_BARE = frozenset(("ctx", "op", "ops", "id", "attr", "arg", "names", "module", "level", "asname", "kind", "type_comment", "type_ignores"))
_HOLDS: dict[type, tuple[str, ...]] = {}
#: files that one batch of rows is made of
FILES_A_BATCH = 256


def _tree(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def _statements(node: ast.AST) -> Iterator[ast.AST]:
    """The statements, handlers and cases right inside a statement, in the order of its tree."""
    for name in _BODIES:
        if isinstance(inside := getattr(node, name, None), list):
            yield from inside


def _walked(tree: ast.AST) -> list[ast.AST]:
    """The nodes of a tree as ast.walk has them, without some kinds that no call, assignment or import is in or is."""
    nodes = [tree]
    for node in nodes:
        kind = type(node)
        if (names := _HOLDS.get(kind)) is None:
            names = _HOLDS[kind] = tuple(n for n in kind._fields if n not in _BARE)
        for name in names:
            value = getattr(node, name, None)
            if isinstance(value, list):
                nodes += [x for x in value if isinstance(x, ast.AST)]
            elif isinstance(value, ast.AST):
                nodes.append(value)
    return nodes


def _row(node, text: list[str], path: str, owner: str | None, parent: str | None) -> dict:
    """A function's row.  owner: its class, or the functions around it, as a dotted prefix."""
    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    qualified = f"{owner}.{node.name}" if owner else node.name
    a = node.args
    names = [x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
    return {
        "id": f"{path}:{qualified}", "name": node.name, "qualified_name": qualified, "class_name": None, "parent_id": parent, "file_path": path, "start_line": first, "end_line": node.end_lineno, "is_async": isinstance(node, ast.AsyncFunctionDef),
        "decorators": [f"@{ast.unparse(d)}" for d in node.decorator_list], "parameters": names, "docstring": ast.get_docstring(node), "code": "\n".join(text[first - 1 : node.end_lineno]),
    }


def _nested(node, text: list[str], path: str, row: dict, class_name: str | None) -> Iterator[tuple[dict, ast.AST]]:
    """The functions defined inside a function, at any depth, with their trees."""
    for child in _statements(node):
        if isinstance(child, _DEFINED):
            own = _row(child, text, path, row["qualified_name"], row["id"]) | {"class_name": class_name}
            yield own, child
            yield from _nested(child, text, path, own, class_name)
        elif not isinstance(child, ast.ClassDef):
            yield from _nested(child, text, path, row, class_name)


def _module_code(tree: ast.Module, text: list[str], path: str) -> dict | None:
    """The statements of a file outside functions and classes, if any does more than import or say something."""

    def trivial(n):
        return isinstance(n, (ast.Import, ast.ImportFrom, ast.Pass)) or isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant)

    own = [n for n in tree.body if not isinstance(n, (*_DEFINED, ast.ClassDef))]
    if all(trivial(n) for n in own):
        return None
    lines = sorted({k for n in own for k in range(n.lineno, n.end_lineno + 1)})
    return {
        "id": f"{path}:__module__", "name": "__module__", "qualified_name": "__module__", "class_name": None, "parent_id": None, "file_path": path, "start_line": lines[0], "end_line": lines[-1], "is_async": False, "decorators": [],
        "parameters": [], "docstring": ast.get_docstring(tree), "code": "\n".join(text[k - 1] for k in lines),
    }


def _functions_in(path: str, tree: ast.Module, text: list[str]) -> Iterator[tuple[dict, ast.AST | None]]:
    """A file's functions with their trees, and its module code, which has none."""
    for node in tree.body:
        if isinstance(node, _DEFINED):
            row = _row(node, text, path, None, None)
            yield row, node
            yield from _nested(node, text, path, row, None)
        elif isinstance(node, ast.ClassDef):
            for child in node.body:
                if isinstance(child, _DEFINED):
                    row = _row(child, text, path, node.name, None) | {"class_name": node.name}
                    yield row, child
                    yield from _nested(child, text, path, row, node.name)
    if module := _module_code(tree, text, path):
        yield module, None


def _functions_of(path: str, source: str | None) -> Iterator[dict]:
    if (tree := _tree(source)) is not None:
        yield from (row for row, _ in _functions_in(path, tree, (source or "").split("\n")))


def _mapped(rows: DataFrame, each, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, FILES_A_BATCH):
                batch = whole.slice(begin, FILES_A_BATCH)
                made = [row for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in each(*values)]
                yield pa.RecordBatch.from_pylist(made, schema=schema)

    return rows.mapInArrow(run, ddl)


def _dealt(files: DataFrame) -> DataFrame:
    """Paths and texts, dealt by path: to parse a file takes far longer than to move it, and files may come in few partitions."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).repartition(parts, "path")


def functions(files: DataFrame) -> DataFrame:
    """The functions, methods, nested functions and module code of Python files (path, text), with their unit_type.

    Ids are `path:qualified name`; a file that can't be parsed has none.  Null texts count as empty; of a
    name that a file defines twice, both rows are given (see last_defined)."""
    made = _mapped(_dealt(files), _functions_of, FUNCTIONS, FUNCTIONS_DDL)
    return made.withColumn("unit_type", unit_type(F.col("name"), F.col("decorators"), F.col("class_name"), F.col("file_path"), F.col("parent_id")))


def last_defined(rows: DataFrame) -> DataFrame:
    """The last definition of each id."""
    rest = [c for c in rows.columns if c not in ("id", "start_line")]
    return rows.groupBy("id").agg(F.max(F.struct("start_line", *rest)).alias("r")).select("id", "r.*")


def unit_type(name: Column, decorators: Column, class_name: Column, path: Column, parent_id: Column) -> Column:
    """What a function is for, by its decorators, file and name."""
    marks, place, low = F.lower(F.array_join(decorators, " ")), F.lower(path), F.lower(name)
    routes = F.lit(False)
    for word in ("@app.route", "@router.", "@blueprint.", "@get", "@post", "@put", "@delete"):
        routes = routes | marks.contains(word)
    in_class = F.coalesce(class_name, F.lit("")) != ""
    method = (
        F.when(name == "__init__", "constructor").when(name.startswith("__") & name.endswith("__"), "dunder_method").when(marks.contains("@property"), "property")
        .when(marks.contains("@staticmethod"), "static_method").when(marks.contains("@classmethod"), "class_method").otherwise("method")
    )
    return (
        F.when(name == "__module__", "module_level").when(parent_id.isNotNull(), "nested_function").when(routes, "route_handler").when(place.contains("views") & ~in_class, "view_function").when(in_class, method)
        .when(low.contains("middleware") | place.contains("middleware"), "middleware").when(name.startswith("test_") | place.contains("test"), "test").when(name.startswith("_") & ~name.startswith("__"), "private_function").otherwise("function")
    )


def _imports_of(path: str, source: str | None) -> Iterator[dict]:
    if (tree := _tree(source)) is not None:
        yield from _imports_in(path, tree)


def _imports_in(path: str, tree: ast.Module) -> Iterator[dict]:
    nodes: list[ast.AST] = [tree]
    for k, node in enumerate(nodes):  # level by level, as ast.walk goes
        nodes += _statements(node)
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            head = f"{node.module}." if isinstance(node, ast.ImportFrom) and node.module else ""
            for alias in node.names:
                yield {"path": path, "name": alias.asname or alias.name, "target": f"{head}{alias.name}", "pos": k}


def imports(files: DataFrame) -> DataFrame:
    """(path, name, target): what each name stands for in a file (path, text) that imports it; the last import of a name counts."""
    return _last_import(_mapped(_dealt(files), _imports_of, IMPORTS, IMPORTS_DDL))


def _last_import(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "name").agg(F.max_by("target", "pos").alias("target"))


def _types_of(nodes: list[ast.AST]) -> dict[str, set[str]]:
    """The classes that local names may hold, by their annotations and the calls that they were made with."""
    out: dict[str, set[str]] = {}
    for node in nodes:
        targets = [node.target] if isinstance(node, ast.AnnAssign) else node.targets if isinstance(node, ast.Assign) else []
        made = []
        if targets and isinstance(node.value, ast.Call):
            f = node.value.func
            made = [f.id] if isinstance(f, ast.Name) else [f.attr] if isinstance(f, ast.Attribute) and isinstance(node, ast.Assign) else []
        if isinstance(node, ast.AnnAssign) and isinstance(node.annotation, ast.Name):
            made.append(node.annotation.id)
        for target in targets:
            if isinstance(target, ast.Name) and made:
                out.setdefault(target.id, set()).update(made)
    return out


def _alone(node: ast.AST | None, code: str, plain: bool) -> ast.AST | None:
    """The tree of a function's text by itself: its part of the file's tree, wherever the text is sure to parse to the same.

    That is where it begins with the function or `@`, and dedent takes the indentation of this line off all others; else, or if the
    file isn't plain (has tabs or other breaks than \\n), the text is parsed again, which may fail."""
    head = code.lstrip(" ")
    margin = code[: len(code) - len(head)]
    if node is not None and plain and head.startswith(("def ", "async ", "@")) and not code.endswith("\\") and (not margin or all(line.startswith(margin) or not line.strip(" ") for line in code.split("\n"))):
        return node
    return _tree(textwrap.dedent(code))


def _calls_of(caller: str, file: str | None, own_class: str | None, code: str | None) -> Iterator[dict]:
    return _calls_in(caller, file, own_class, code, _alone(None, code or "", False))


def _calls_in(caller: str, file: str | None, own_class: str | None, code: str | None, tree: ast.AST | None) -> Iterator[dict]:

    def row(kind, name, receiver=None, types=()):
        return {"caller": caller, "file": file, "own_class": own_class, "kind": kind, "name": name, "receiver": receiver, "types": sorted(types)}

    if tree is None:
        yield row("parse_failure", "<parse>")
        yield from (row("text", name) for name in sorted(set(_CALL_TEXT.findall(code))))
        return
    nodes = _walked(tree)
    local = _types_of(nodes)
    seen = set()
    for node in nodes:
        if not isinstance(node, ast.Call):
            continue
        f = node.func
        on = f.value if isinstance(f, ast.Attribute) else None
        if isinstance(f, ast.Name):
            made = row("name", f.id)
        elif on is None:
            made = row("dynamic", "<callable>")
        elif isinstance(on, ast.Name):
            made = row("own" if on.id in ("self", "cls") else "attribute", f.attr, on.id, local.get(on.id, ()))
        elif isinstance(on, ast.Call) and isinstance(on.func, ast.Name) and on.func.id == "super":
            made = row("own", f.attr, "super()")
        else:
            made = row("chained", f.attr)
        if (key := (made["kind"], made["name"], made["receiver"])) not in seen:
            seen.add(key)
            yield made


def calls(rows: DataFrame) -> DataFrame:
    """(caller, file, own_class, kind, name, receiver, types): the different calls of each function (id, file_path, class_name, code).

    kind: name; own, on self, cls or super(); attribute, on another name, with the classes that it may hold by local
    assignments; chained, on anything else; dynamic; and of code that can't be parsed parse_failure and text, which is what a
    pattern finds there."""
    return _mapped(rows.select("id", "file_path", "class_name", "code"), _calls_of, CALLS, CALLS_DDL)


class Sources(NamedTuple):
    """What Python files hold, for resolve.call_graph."""

    functions: DataFrame
    imports: DataFrame
    calls: DataFrame


_ALL = pa.schema([("what", pa.string()), ("function", pa.struct(list(FUNCTIONS))), ("import", pa.struct(list(IMPORTS))), ("call", pa.struct(list(CALLS)))])


def _all_of(path: str, source: str | None) -> Iterator[dict]:
    if (tree := _tree(source)) is None:
        return
    last = {row["id"]: (row, node) for row, node in _functions_in(path, tree, (source or "").split("\n"))}
    plain = not _BREAKS.search(source or "")
    for row, node in last.values():
        yield {"what": "function", "function": row}
        yield from ({"what": "call", "call": c} for c in _calls_in(row["id"], path, row["class_name"], row["code"], _alone(node, row["code"], plain)))
    # in the order of their places, so the last one stays
    yield from ({"what": "import", "import": i} for i in {i["name"]: i for i in _imports_in(path, tree)}.values())


def sources(files: DataFrame) -> Sources:
    """Functions, imports and calls of Python files (path, text), each file read once; they are tables, so no step after reads it again.

    Paths are distinct.  Of a name that a file defines or imports twice the last one counts.  A file that can't be parsed has none of the three."""
    ddl = f"what string, function struct<{_fields(FUNCTIONS_DDL)}>, import struct<{_fields(IMPORTS_DDL)}>, call struct<{_fields(CALLS_DDL)}>"
    # a folder for each kind, so that a step which wants calls doesn't go through rows of functions
    every = stored(_mapped(_dealt(files), _all_of, _ALL, ddl), by="what")
    made, imported, called = (every.where(F.col("what") == c).select(f"{c}.*") for c in ("function", "import", "call"))
    kind = unit_type(F.col("name"), F.col("decorators"), F.col("class_name"), F.col("file_path"), F.col("parent_id"))
    return Sources(made.withColumn("unit_type", kind), imported.drop("pos"), called)


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ") for part in ddl.split(", ")))


_ROUTE = re.compile(r"^(?:\w+\.)*(route|get|post|put|delete|patch|head|options|websocket|api_route)$")


def _routes_of(path: str, source: str | None) -> Iterator[dict]:
    tree = _tree(source)
    for node in ast.walk(tree) if tree else ():
        row = lambda kind, methods, rule, handler: {"path": path, "framework": kind, "methods": methods, "rule": rule, "handler": handler, "line": node.lineno}  # noqa: E731, B023
        text = lambda x: x.value if isinstance(x, ast.Constant) and isinstance(x.value, str) else None
        if isinstance(node, _DEFINED):
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and (m := _ROUTE.match(d.func.attr)):
                    listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                    methods = [text(e) for e in listed.elts if text(e)] if isinstance(listed, (ast.List, ast.Tuple, ast.Set)) else ["GET"] if m[1] == "route" else [m[1].upper()]
                    yield row("decorator", methods, text(d.args[0]) if d.args else None, node.name)
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
            if name in ("path", "re_path", "url") and len(node.args) >= 2 and text(node.args[0]) is not None:
                yield row("urlconf", [], text(node.args[0]), ast.unparse(node.args[1]))
            elif name in ("add_get", "add_post", "add_put", "add_delete", "add_patch") and len(node.args) >= 2:
                yield row("router", [name[4:].upper()], text(node.args[0]), ast.unparse(node.args[1]))
            elif name == "add_route" and len(node.args) >= 3:
                yield row("router", [text(node.args[0]) or "*"], text(node.args[1]), ast.unparse(node.args[2]))


def routes(files: DataFrame) -> DataFrame:
    """(path, framework, methods, rule, handler, line): the routes that Python files (path, text) register, by decorators, URL lists or router calls."""
    schema = pa.schema([("path", pa.string()), ("framework", pa.string()), ("methods", pa.list_(pa.string())), ("rule", pa.string()), ("handler", pa.string()), ("line", pa.int32())])
    return _mapped(_dealt(files), _routes_of, schema, "path string, framework string, methods array<string>, rule string, handler string, line int")
