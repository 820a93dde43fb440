"""Stage, graph and evidence tables derived from the driver's tables.

Each is one SQL text that both Spark and DuckDB run, so that queries and their oracles start
from the same rows.  `{name}` stands for a table, given or derived.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DERIVED = {
    "line_counts": "SELECT l_orderkey AS unit_id, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS f FROM {lineitem} GROUP BY l_orderkey",
    "stage1": """SELECT o_orderkey AS unit_id, concat('F', o_orderkey) AS finding_id, o_orderkey AS pos,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'error' WHEN o_orderstatus = 'P' THEN 'candidate' WHEN o_orderstatus = 'F' THEN 'no_finding' ELSE 'inconclusive' END AS decision
        FROM {orders}""",
    "stage2": """SELECT unit_id, concat('F', unit_id) AS finding_id, unit_id * 2 + k AS pos,
        CASE WHEN k = 1 THEN 'rejected' WHEN n % 4 = 1 THEN 'rejected' WHEN n % 4 = 2 THEN 'inconclusive' ELSE 'confirmed' END AS decision,
        CASE WHEN unit_id % 37 = 0 THEN 'failed' ELSE 'succeeded' END AS execution_state
        FROM {line_counts} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) x WHERE n % 4 <> 0 AND (k = 0 OR unit_id % 11 = 0)""",
    "dynamic": """SELECT CASE WHEN unit_id % 5 = 0 THEN NULL ELSE unit_id END AS unit_id, concat('F', unit_id) AS finding_id, unit_id AS pos,
        CASE WHEN f = n THEN 'reproduced' WHEN f % 3 = 1 THEN 'not_reproduced' ELSE 'inconclusive' END AS decision,
        CASE WHEN f < n AND f % 3 = 0 THEN 'blocked' WHEN unit_id % 41 = 0 THEN 'skipped' ELSE 'succeeded' END AS execution_state
        FROM {line_counts} WHERE f > 0""",
    # records as stages write them: without a unit or a finding, twice, by the second stage alone, skipped
    "found1": """SELECT CASE WHEN unit_id % 19 = 0 THEN NULL ELSE concat('src/f', unit_id % 50, '.py:fn', unit_id) END AS unit_id, CASE WHEN unit_id % 31 = 0 THEN '' ELSE finding_id END AS finding_id, pos, decision,
        CASE WHEN unit_id % 3 = 0 THEN concat('lib/g', unit_id % 40, '.py') ELSE '' END AS file, CASE WHEN unit_id % 2 = 0 THEN 'h' ELSE '' END AS function, concat('e', unit_id % 7, ',e', unit_id % 5) AS cited FROM {stage1} WHERE unit_id % 23 <> 0
        UNION ALL SELECT concat('src/f', unit_id % 50, '.py:fn', unit_id), finding_id, pos + 1000000000, 'candidate', '', '', 'e1' FROM {stage1} WHERE unit_id % 29 = 0""",
    "found2": """SELECT CASE WHEN unit_id % 17 = 0 THEN NULL ELSE concat('src/f', unit_id % 50, '.py:fn', unit_id) END AS unit_id, CASE WHEN unit_id % 13 = 0 THEN NULL ELSE finding_id END AS finding_id, pos, decision, execution_state, concat('e', unit_id % 5, ',e', unit_id % 11) AS cited FROM {stage2}
        UNION ALL SELECT concat('src/f', unit_id % 50, '.py:fn', unit_id), finding_id, pos + 2000000000, 'inconclusive', 'skipped', 'e0' FROM {stage1} WHERE decision = 'no_finding' AND unit_id % 4 = 0
        UNION ALL SELECT concat('only/s2.py:u', unit_id), concat('F', unit_id), pos + 3000000000, 'confirmed', 'succeeded', 'e2,e2' FROM {stage1} WHERE unit_id % 47 = 0""",
    "found3": """SELECT CASE WHEN unit_id IS NULL THEN NULL ELSE concat('src/f', unit_id % 50, '.py:fn', unit_id) END AS unit_id, finding_id, pos, decision, execution_state, concat('e', pos % 3) AS cited FROM {dynamic}""",
    "nodes": """SELECT p_partkey AS id, concat('fn', p_partkey % 40) AS name, concat('pkg', p_size % 4, '.fn', p_partkey % 40) AS qualified_name,
        concat('src/', p_brand, '/m', p_partkey % 3, '.py') AS file_path, concat('src/', p_brand) AS folder,
        CASE WHEN p_size % 9 = 0 THEN 'module_level' WHEN p_size % 9 = 1 THEN 'lambda' ELSE 'function' END AS kind,
        CASE WHEN p_partkey % 10 = 3 THEN 'public' ELSE 'private' END AS visibility, p_partkey % 6 = 0 AS is_exported, p_type AS unit_type FROM {part}""",
    "edges": """SELECT cast(floor(p_partkey / 2) AS bigint) AS caller, p_partkey AS callee, CASE WHEN p_size % 5 = 0 THEN 'low' WHEN p_size % 5 = 1 THEN 'exact' ELSE NULL END AS confidence
        FROM {part} WHERE p_partkey > 0 AND p_size % 7 <> 0""",
    "roots": "SELECT p_partkey AS id FROM {part} WHERE p_partkey = 1 OR p_partkey % 97 = 5",
    "unresolved": """SELECT p_partkey AS caller, CASE WHEN p_size % 5 = 0 THEN '<lambda>' ELSE concat('x.fn', p_partkey * 3 % 40) END AS callee_name,
        CASE WHEN p_size % 3 = 0 THEN 'dynamic' WHEN p_size % 3 = 1 THEN 'external' ELSE 'ambiguous' END AS reason FROM {part} WHERE p_size % 11 = 0""",
    "spans": "SELECT concat(l_orderkey, ':', l_partkey, ':', l_suppkey, ':', l_linenumber, ':', cast(l_quantity AS int)) AS id, concat('file', l_partkey - l_partkey % 3) AS file, CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE l_linenumber * 10 END AS lo, CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE l_linenumber * 10 + cast(l_quantity AS int) END AS hi FROM {lineitem}",
    "hunks": "SELECT concat('file', p_partkey - p_partkey % 7) AS file, p_size AS start, p_size + p_partkey % 4 AS stop FROM {part}",
    # the same over as many files as there were at first, so that each has many spans and hunks
    "crowded_spans": "SELECT concat(l_orderkey, ':', l_partkey, ':', l_suppkey, ':', l_linenumber, ':', cast(l_quantity AS int)) AS id, concat('file', l_partkey % 500) AS file, CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE l_linenumber * 10 END AS lo, CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE l_linenumber * 10 + cast(l_quantity AS int) END AS hi FROM {lineitem}",
    "crowded_hunks": "SELECT concat('file', p_partkey % 600) AS file, p_size AS start, p_size + p_partkey % 4 AS stop FROM {part}",
    "sources": "SELECT concat('S', p_partkey) AS id, concat('F', p_partkey) AS finding_id, concat('s', p_size % 3) AS source, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_type END AS sink FROM {part}",
    "source_edges": "SELECT concat('S', caller) AS caller, concat('S', callee) AS callee FROM {edges} UNION ALL SELECT concat('S', caller) AS caller, concat('S', callee) AS callee FROM {edges} WHERE caller % 13 = 0",
    "cited": "SELECT DISTINCT concat('S', l_partkey) AS id, concat('e', l_suppkey % 50) AS evidence_id FROM {lineitem}",
    "evidence": "SELECT substr(split_part(text, chr(10), 1), 1, 40) AS evidence_id, doc_id AS pos, text AS content, CASE WHEN doc_id % 10 = 0 THEN 'bad' WHEN doc_id % 10 = 1 THEN repeat('a', 64) ELSE NULL END AS content_hash FROM {documents}",
    "routes": """SELECT d.doc_id, d.source, concat('src/', d.source, '.py:', CASE WHEN d.doc_id % 4 = 0 THEN '_get_default_' WHEN d.doc_id % 4 = 1 THEN 'build_' WHEN d.doc_id % 4 = 2 THEN 'Cls.' ELSE '__' END, 'fn', d.doc_id % 3) AS route,
        CASE WHEN quality * 2 + toxic = 0 THEN 'Vulnerable' WHEN quality * 2 + toxic = 1 THEN 'bypassable' WHEN quality * 2 + toxic = 2 THEN 'SAFE' ELSE 'protected' END AS verdict FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "failures": """SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'api_status' WHEN event_type = 'click' THEN 'rate_limit' WHEN event_type = 'view' THEN 'bad_request' WHEN event_type = 'signup' THEN 'timeout' ELSE NULL END AS kind,
        450 + cast(replace(replace(props, '{{"k": ', ''), '}}', '') AS int) AS status FROM {events}""",
    "calls": "SELECT concat('m-', role) AS model, length(text) AS input_tokens, turn * 7 AS output_tokens FROM {conversations}",
    "packages": "SELECT p_partkey AS part, 'PyPI' AS ecosystem, concat('Pkg_', p_partkey - p_partkey % 10) AS name, concat(p_size % 5, '.', p_partkey % 10, CASE WHEN p_size % 3 = 0 THEN '.0' ELSE '' END) AS version FROM {part}",
    "advisories": """SELECT concat('A', p_partkey) AS id, concat('pkg-', p_partkey - p_partkey % 10) AS package, concat(p_size % 3) AS introduced,
        CASE WHEN p_partkey % 3 = 0 THEN concat(p_size % 4, '.5') ELSE NULL END AS fixed, CASE WHEN p_partkey % 3 = 1 THEN concat(p_size % 4) ELSE NULL END AS last_affected FROM {part}""",
    "answers": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN props WHEN event_id % 5 = 1 THEN concat('```json', chr(10), props, chr(10), '```') WHEN event_id % 5 = 2 THEN concat('Answer: ', props, ' done')
        WHEN event_id % 5 = 3 THEN substr(props, 1, 4) ELSE 'none' END AS answer FROM {events}""",
    "words": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN ' Vuln ' WHEN o_orderkey % 6 = 1 THEN 'bypass' WHEN o_orderkey % 6 = 2 THEN 'SAFE' WHEN o_orderkey % 6 = 3 THEN NULL WHEN o_orderkey % 6 = 4 THEN 'odd' ELSE 'uncertain' END AS a, CASE WHEN o_orderstatus = 'F' THEN 'vulnerable' WHEN o_orderstatus = 'P' THEN 'bypassable' ELSE NULL END AS b, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 = 1 END AS agrees, CASE WHEN o_custkey % 4 = 0 THEN 'Confirmed' WHEN o_custkey % 4 = 1 THEN 'rejected' WHEN o_custkey % 4 = 2 THEN NULL ELSE 'agreed' END AS stage2, CASE WHEN o_custkey % 5 = 0 THEN 'confirmed' WHEN o_custkey % 5 = 1 THEN 'BLOCKED' ELSE NULL END AS dyn FROM {orders}",
    "sources_py": """SELECT concat('m', p_partkey, '.py') AS path, concat('import m', p_partkey + 1, ' as nxt', chr(10), 'from m', p_partkey + 2, ' import f', p_partkey + 2, chr(10), chr(10), 'def f', p_partkey, '(a):', chr(10), '    return g', p_partkey, '(a)', chr(10), chr(10), chr(10),
        CASE WHEN p_size % 2 = 0 THEN '@router.get("/x")' ELSE '# plain' END, chr(10), 'def g', p_partkey, '(b, *c):', chr(10), '    nxt.f', p_partkey + 1, '(b)', chr(10), '    f', p_partkey + 2, '(c)', chr(10), '    return h(b)', chr(10)) AS text, p_partkey AS k, p_size FROM {part}""",
    # calls in an order that isn't that of ids, with several ways to a node
    "placed_calls": """SELECT cast(floor(p_partkey / 3) AS bigint) AS caller, p_partkey AS callee, p_partkey * 7919 % 1000003 AS place, cast(floor(p_partkey / 3) AS bigint) * 7907 % 1000003 AS caller_place FROM {part} WHERE p_partkey > 0
        UNION ALL SELECT a.p_partkey, b.p_partkey, b.p_partkey * 7919 % 1000003, a.p_partkey * 7907 % 1000003 FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 2 + a.p_size % 9 WHERE a.p_partkey % 4 <> 1""",
    # modules with classes: their functions, imports and calls as tables, and the text that says the same
    "py_keys": "SELECT p_partkey AS k, concat('p', p_partkey % 7, '/m', p_partkey, '.py') AS path FROM {part}",
    "py_functions": """SELECT path, concat(path, ':C', k, '.only') AS id, 'only' AS name, concat('C', k) AS class_name FROM {py_keys} UNION ALL SELECT path, concat(path, ':C', k, '.run'), 'run', concat('C', k) FROM {py_keys}
        UNION ALL SELECT path, concat(path, ':D', k, '.run'), 'run', concat('D', k) FROM {py_keys} UNION ALL SELECT path, concat(path, ':D', k, '.only'), 'only', concat('D', k) FROM {py_keys} WHERE k % 4 = 1
        UNION ALL SELECT path, concat(path, ':f', k), concat('f', k), NULL FROM {py_keys} UNION ALL SELECT path, concat(path, ':shared', k % 3), concat('shared', k % 3), NULL FROM {py_keys} WHERE k % 100 = 7""",
    "py_imports": """SELECT path, concat('C', k + 1) AS name, concat('p', (k + 1) % 7, '.m', k + 1, '.C', k + 1) AS target FROM {py_keys} UNION ALL SELECT path, 'nxt', concat('p', (k + 2) % 7, '.m', k + 2) FROM {py_keys}
        UNION ALL SELECT path, 'h', concat('p', (k + 3) % 7, '.m', k + 3, '.f', k + 3) FROM {py_keys} UNION ALL SELECT path, 'json', 'json' FROM {py_keys}""",
    "py_calls": """SELECT path, concat(path, ':C', k, '.run') AS caller, concat('C', k) AS own_class, 'own' AS kind, 'only' AS name, 'self' AS receiver, NULL AS type FROM {py_keys}
        UNION ALL SELECT path, concat(path, ':D', k, '.run'), concat('D', k), 'super', 'run', 'super()', NULL FROM {py_keys}
        UNION ALL SELECT path, concat(path, ':f', k), NULL, kind, replace(replace(replace(replace(name, '<0>', concat(k)), '<1>', concat(k + 1)), '<2>', concat(k + 2)), '<3>', concat(k % 3)), replace(receiver, '<1>', concat(k + 1)), replace(replace(type, '<0>', concat(k)), '<1>', concat(k + 1))
        FROM {py_keys} JOIN (SELECT 0 AS v, 'name' AS kind, 'C<1>' AS name, NULL AS receiver, NULL AS type UNION ALL SELECT 0, 'attribute', 'run', 'x', 'C<1>' UNION ALL SELECT 1, 'name', 'C<0>', NULL, NULL UNION ALL SELECT 1, 'name', 'D<0>', NULL, NULL
        UNION ALL SELECT 1, 'attribute', 'only', 'y', 'C<0>' UNION ALL SELECT 1, 'attribute', 'only', 'y', 'D<0>' UNION ALL SELECT 2, 'name', 'C<1>', NULL, NULL UNION ALL SELECT 2, 'name', 'D<0>', NULL, NULL UNION ALL SELECT 2, 'attribute', 'run', 'y', 'C<1>'
        UNION ALL SELECT 2, 'attribute', 'run', 'y', 'D<0>' UNION ALL SELECT 3, 'attribute', 'f<2>', 'nxt', NULL UNION ALL SELECT 3, 'name', 'h', NULL, NULL UNION ALL SELECT 3, 'attribute', 'loads', 'json', NULL UNION ALL SELECT 3, 'name', 'print', NULL, NULL
        UNION ALL SELECT 3, 'name', 'len', NULL, NULL UNION ALL SELECT 4, 'attribute', 'run', 'C<1>', NULL UNION ALL SELECT 4, 'attribute', 'strip', 'a', NULL UNION ALL SELECT 4, 'chained', 'go', NULL, NULL UNION ALL SELECT 4, 'attribute', 'go', 'z', NULL
        UNION ALL SELECT 4, 'name', 'shared<3>', NULL, NULL UNION ALL SELECT 5, 'name', 'make', NULL, NULL UNION ALL SELECT 5, 'attribute', 'run', 'w', 'C<0>' UNION ALL SELECT 5, 'attribute', 'run', 'w', 'make' UNION ALL SELECT 5, 'attribute', 'nothing', 'nxt', NULL) t ON v = k % 6""",
    "py_texts": """SELECT path, concat('import json', chr(10), 'from p', (k + 1) % 7, '.m', k + 1, ' import C', k + 1, chr(10), 'import p', (k + 2) % 7, '.m', k + 2, ' as nxt', chr(10), 'from p', (k + 3) % 7, '.m', k + 3, ' import f', k + 3, ' as h', chr(10), chr(10), chr(10),
        'class C', k, ':', chr(10), '    def only(self):', chr(10), '        pass', chr(10), chr(10), '    def run(self):', chr(10), '        return self.only()', chr(10), chr(10), chr(10),
        'class D', k, ':', chr(10), CASE WHEN k % 4 = 1 THEN concat('    def only(self):', chr(10), '        pass', chr(10), chr(10)) ELSE '' END, '    def run(self):', chr(10), '        return super().run()', chr(10), chr(10), chr(10),
        CASE WHEN k % 100 = 7 THEN concat('def shared', k % 3, '():', chr(10), '    pass', chr(10), chr(10), chr(10)) ELSE '' END, 'def f', k, '(a, z=None):', chr(10),
        CASE WHEN k % 6 = 0 THEN concat('    x = C', k + 1, '()', chr(10), '    x.run()', chr(10)) WHEN k % 6 = 1 THEN concat('    y = C', k, '()', chr(10), '    y = D', k, '()', chr(10), '    return y.only()', chr(10))
        WHEN k % 6 = 2 THEN concat('    y = C', k + 1, '()', chr(10), '    if a:', chr(10), '        y = D', k, '()', chr(10), '    y.run()', chr(10)) WHEN k % 6 = 3 THEN concat('    print(len(json.loads(a)))', chr(10), '    return h(nxt.f', k + 2, '(a))', chr(10))
        WHEN k % 6 = 4 THEN concat('    C', k + 1, '.run(a.strip())', chr(10), '    a.b.go()', chr(10), '    z.go()', chr(10), '    shared', k % 3, '()', chr(10)) ELSE concat('    w: C', k, ' = make()', chr(10), '    w.run()', chr(10), '    nxt.nothing()', chr(10)) END) AS text FROM {py_keys}""",
    "manifest_lines": "SELECT concat('./src/f', p_partkey % 50, '.py') AS file, concat('@@ -', p_size, CASE WHEN p_size % 2 = 0 THEN ',3' ELSE '' END, ' +', p_partkey % 90 + 1, CASE WHEN p_size % 3 = 0 THEN ',0' WHEN p_size % 3 = 1 THEN ',4' ELSE '' END, ' @@ def f():') AS line, p_partkey % 90 + 1 AS first, p_size % 3 AS k FROM {part}",
}
_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def used(text: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(text)))


def needed(names: list[str]) -> list[str]:
    """Derived tables that some names build on, and they themselves, in order."""
    out: list[str] = []
    for name in names:
        if name in DERIVED and name not in out:
            out += [n for n in needed(used(DERIVED[name])) if n not in out] + [name]
    return out


def duckdb_sql(body: str) -> str:
    """A whole query from a body that names tables as {name}."""
    fill = lambda text: _NAME.sub(r"\1", text).replace("{{", "{").replace("}}", "}")
    parts = ", ".join(f"{n} AS ({fill(DERIVED[n])})" for n in needed(used(body)))
    body = fill(body).lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{parts}{', ' if parts else ''}{body[len(head) :]}"
    return f"WITH {parts} {body}" if parts else body


class Tables:
    """The tables of a folder, given and derived, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in DERIVED:
            text = DERIVED[name]
            return self.spark.sql(text, **{n: self[n] for n in used(text)})
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
