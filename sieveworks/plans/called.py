"""Registered queries of call resolution in C, JavaScript and Go: a row for each edge and each unresolved call."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import languages
from .derived import DERIVED
from .registry import query

# tables of a C parser: work functions whose names recur, inline ones of headers, one definition of some prototypes
_C = {
    "c_functions": """SELECT concat('src/d', p_partkey % 5, '/u', p_partkey, '.c:work', p_partkey % 40) AS id, concat('work', p_partkey % 40) AS name, concat('src/d', p_partkey % 5, '/u', p_partkey, '.c') AS file_path FROM {part}
        UNION SELECT concat('inc/h', p_partkey % 30, '.h:inl', p_partkey % 60), concat('inl', p_partkey % 60), concat('inc/h', p_partkey % 30, '.h') FROM {part} UNION SELECT concat('inc/h', p_partkey % 30, '.h:common'), 'common', concat('inc/h', p_partkey % 30, '.h') FROM {part}
        UNION SELECT concat('src/only', p_partkey, '.c:uniq', p_partkey), concat('ns::uniq', p_partkey), concat('src/only', p_partkey, '.c') FROM {part} WHERE p_partkey % 10 = 0""",
    "c_includes": "SELECT concat('src/d', p_partkey % 5, '/u', p_partkey, '.c') AS file, concat('/h', p_partkey % 30, '.h') AS header FROM {part} UNION SELECT concat('src/d', p_partkey % 5, '/u', p_partkey, '.c'), concat('inc/h', (p_partkey + 1) % 30, '.h') FROM {part} WHERE p_partkey % 3 = 0",
    "c_prototypes": "SELECT DISTINCT concat('uniq', p_partkey - p_partkey % 20) AS name FROM {part} UNION SELECT DISTINCT concat('work', p_partkey % 5) FROM {part}",
    "c_aliases": "SELECT DISTINCT concat('CALL', p_partkey % 60) AS name, concat('inl', p_partkey % 60) AS value FROM {part} UNION SELECT DISTINCT concat('DEEP', p_partkey % 20), concat('CALL', p_partkey % 20) FROM {part}",
    "c_calls": """SELECT concat('src/d', k % 5, '/u', k, '.c:work', k % 40) AS caller, name FROM (SELECT p_partkey AS k, concat('inl', p_partkey % 60) AS name FROM {part} UNION ALL SELECT p_partkey, concat('uniq', p_partkey - p_partkey % 10) FROM {part} UNION ALL SELECT p_partkey, concat('work', (p_partkey + p_size) % 40) FROM {part}
        UNION ALL SELECT p_partkey, concat('CALL', (p_partkey + p_size % 3) % 60) FROM {part} UNION ALL SELECT p_partkey, concat('DEEP', p_partkey % 25) FROM {part} UNION ALL SELECT p_partkey, 'common' FROM {part} UNION ALL SELECT p_partkey, 'printf' FROM {part} UNION ALL SELECT p_partkey, NULL FROM {part} WHERE p_size % 7 = 0) c""",
}
_JS = {
    "js_functions": """SELECT concat('app/s', p_partkey, '.ts:Svc', p_partkey % 300, '.get') AS id, concat('Svc', p_partkey % 300, '.get') AS name, concat('Svc', p_partkey % 300) AS class_name FROM {part} UNION ALL SELECT concat('app/s', p_partkey, '.ts:Svc', p_partkey % 300, '.constructor'), concat('Svc', p_partkey % 300, '.constructor'), concat('Svc', p_partkey % 300) FROM {part} WHERE p_partkey % 300 > 40
        UNION ALL SELECT concat('app/c', p_partkey, '.ts:Ctl', p_partkey, '.run'), concat('Ctl', p_partkey, '.run'), concat('Ctl', p_partkey) FROM {part} UNION ALL SELECT concat('lib/u', p_partkey % 700, '/m', p_partkey, '.js:help', p_partkey % 90), concat('help', p_partkey % 90), NULL FROM {part}""",
    "js_imports": "SELECT concat('app/c', p_partkey, '.ts') AS file, 'h' AS name, concat('./u', p_partkey % 700, '/m') AS source, concat('help', p_partkey % 90) AS original FROM {part} UNION ALL SELECT concat('app/c', p_partkey, '.ts'), concat('help', p_partkey % 45), concat('u', p_size, '/m1'), NULL FROM {part} WHERE p_partkey % 90 <> 44",
    "js_deps": "SELECT concat('app/c', p_partkey, '.ts') AS file, concat('Ctl', p_partkey) AS class_name, 'svc' AS field, concat('Svc', p_partkey * 7 % 350) AS type, 'constructor' AS kind FROM {part} UNION ALL SELECT concat('app/c', p_partkey, '.ts'), concat('Ctl', p_partkey), 'svc', 'Other', 'field' FROM {part} UNION ALL SELECT concat('app/c', p_partkey, '.ts'), concat('Ctl', p_partkey), 'iface', concat('IGet', p_partkey % 500), 'field' FROM {part}",
    "js_bases": "SELECT concat('app/s', p_partkey, '.ts') AS file, concat('Svc', p_partkey % 300) AS class_name, concat('IGet', p_partkey % 450) AS base FROM {part} WHERE p_size % 4 <> 0",
    "js_calls": """SELECT concat('app/c', p_partkey, '.ts:Ctl', p_partkey, '.run') AS caller, v.kind AS kind, replace(replace(v.name, '<a>', concat(p_partkey % 45)), '<b>', concat(p_partkey * 3 % 320)) AS name, v.receiver AS receiver FROM {part} CROSS JOIN (SELECT 'name' AS kind, 'h' AS name, NULL AS receiver UNION ALL SELECT 'name', 'help<a>', NULL
        UNION ALL SELECT 'name', 'setTimeout', NULL UNION ALL SELECT 'this', 'run', NULL UNION ALL SELECT 'this', 'gone', NULL UNION ALL SELECT 'method', 'get', 'svc' UNION ALL SELECT 'method', 'get', 'iface' UNION ALL SELECT 'method', 'get', 'x' UNION ALL SELECT 'method', 'log', 'console' UNION ALL SELECT 'new', 'Svc<b>', NULL) v""",
}
_GO = {
    "go_functions": """SELECT concat('p', p_partkey % 60, '/f', p_partkey, '.go:Fn', p_partkey % 400) AS id, concat('Fn', p_partkey % 400) AS name, NULL AS class_name, CASE WHEN p_size % 9 = 0 THEN '' ELSE concat('p', p_partkey % 60) END AS package, concat('p', p_partkey % 60, '/f', p_partkey, '.go') AS file_path, NULL AS receiver FROM {part}
        UNION ALL SELECT concat('p', p_partkey % 60, '/f', p_partkey, '.go:T', p_partkey % 600, '.Do'), 'Do', concat('T', p_partkey % 600), concat('p', p_partkey % 60), concat('p', p_partkey % 60, '/f', p_partkey, '.go'), 't' FROM {part} WHERE p_size % 3 <> 0
        UNION ALL SELECT concat('p', p_partkey % 60, '/f', p_partkey, '.go:T', p_partkey % 600, '.Call', p_partkey), concat('Call', p_partkey), concat('T', p_partkey % 600), concat('p', p_partkey % 60), concat('p', p_partkey % 60, '/f', p_partkey, '.go'), 't' FROM {part}""",
    "go_imports": "SELECT concat('p', p_partkey % 60, '/f', p_partkey, '.go') AS file, 'q' AS alias, concat('example.com/p', (p_partkey + 1) % 60) AS path FROM {part} UNION ALL SELECT concat('p', p_partkey % 60, '/f', p_partkey, '.go'), concat('p', p_partkey % 7), 'example.com/none' FROM {part}",
    "go_calls": """SELECT concat('p', p_partkey % 60, '/f', p_partkey, '.go:T', p_partkey % 600, '.Call', p_partkey) AS caller, replace(replace(replace(v.name, '<a>', concat((p_partkey + 1) % 400)), '<b>', concat((p_partkey + 60) % 400)), '<c>', concat(p_partkey % 450)) AS name, replace(v.receiver, '<d>', concat(p_partkey * 11 % 650)) AS receiver, replace(v.qualifier, '<e>', concat(p_partkey % 9)) AS package, v.receiver IS NOT NULL AS is_method
        FROM {part} CROSS JOIN (SELECT 'Do' AS name, 't' AS receiver, NULL AS qualifier UNION ALL SELECT 'Do', 'T<d>', NULL UNION ALL SELECT 'Do', '*T<d>', NULL UNION ALL SELECT 'Do', 'v', NULL UNION ALL SELECT 'Fn<a>', NULL, 'q' UNION ALL SELECT 'Fn<c>', NULL, 'p<e>' UNION ALL SELECT 'Fn<b>', NULL, NULL UNION ALL SELECT 'Fn<c>', NULL, NULL UNION ALL SELECT 'then', '~call_result~', NULL) v""",
}
DERIVED.update({**_C, **_JS, **_GO})


def _rows(graph):
    """(caller, outcome, what): edges with their callee, unresolved calls with their name; how many functions it may be."""
    sizes = graph.named.groupBy(F.col("name").alias("open_name")).agg(F.count_distinct("id").alias("more"))
    edges = graph.edges.select("caller", F.lit("edge").alias("outcome"), F.col("callee").alias("what"), F.lit(1).cast("bigint").alias("n"))
    lost = graph.unresolved.join(sizes, "open_name", "left").select("caller", F.col("reason").alias("outcome"), F.col("callee_name").alias("what"), F.coalesce("more", F.size("candidates").cast("bigint")).alias("n"))
    return edges.unionByName(lost)


@query(
    r"""WITH f AS (SELECT *, string_split(name, '::')[-1] AS base FROM {c_functions}), a AS (SELECT c.caller, c.name AS call, 0 AS level, c.name FROM (SELECT DISTINCT caller, name FROM {c_calls} WHERE name IS NOT NULL AND name <> 'printf') c
        UNION ALL SELECT c.caller, c.name, 1, x.value FROM (SELECT DISTINCT caller, name FROM {c_calls}) c JOIN {c_aliases} x ON x.name = c.name UNION ALL SELECT c.caller, c.name, 2, y.value FROM (SELECT DISTINCT caller, name FROM {c_calls}) c JOIN {c_aliases} x ON x.name = c.name JOIN {c_aliases} y ON y.name = x.value),
    q AS (SELECT a.*, g.file_path AS file FROM a JOIN f g ON g.id = a.caller), i AS (SELECT DISTINCT x.file, g.file_path AS other FROM {c_includes} x JOIN (SELECT DISTINCT file_path FROM f) g ON ends_with(g.file_path, x.header)),
    h AS (SELECT q.caller, call, level, 0 AS r, f.id FROM q JOIN f ON f.file_path = q.file AND f.base = q.name UNION SELECT q.caller, call, level, 1, f.id FROM q JOIN i USING (file) JOIN f ON f.file_path = i.other AND f.base = q.name
        UNION SELECT q.caller, call, level, 2, d.id FROM q JOIN {c_prototypes} p ON p.name = q.name JOIN (SELECT base, min(id) AS id FROM f WHERE file_path LIKE '%.c' GROUP BY base HAVING count(*) = 1) d ON d.base = q.name),
    s AS (SELECT caller, call, level, r, list(DISTINCT id) AS l FROM h GROUP BY ALL), b AS (SELECT caller, call, level, arg_min(l, r) AS l FROM s GROUP BY ALL),
    o AS (SELECT q.*, coalesce(len(b.l), 0) AS m, b.l[1] AS id FROM q LEFT JOIN b USING (caller, call, level)), d AS (SELECT caller, call, max(level) AS stop FROM o WHERE m = 1 GROUP BY ALL)
    SELECT DISTINCT caller, 'edge' AS outcome, id AS what, 1 AS n FROM o JOIN d USING (caller, call) WHERE level = stop AND id <> caller
    UNION ALL SELECT DISTINCT caller, CASE WHEN m > 1 THEN 'ambiguous' WHEN name IN (SELECT name FROM {c_prototypes}) THEN CASE WHEN (SELECT count(*) FROM f WHERE base = o.name AND file_path LIKE '%.c') > 1 THEN 'ambiguous' ELSE 'unresolved' END WHEN (SELECT count(*) FROM f WHERE base = o.name) > 1 THEN 'ambiguous' ELSE 'unresolved' END,
        name, CASE WHEN m > 1 THEN m WHEN name IN (SELECT name FROM {c_prototypes}) AND (SELECT count(*) FROM f WHERE base = o.name AND file_path LIKE '%.c') > 1 THEN (SELECT count(*) FROM f WHERE base = o.name AND file_path LIKE '%.c') ELSE (SELECT count(*) FROM f WHERE base = o.name) END
        FROM o LEFT JOIN d USING (caller, call) WHERE m <> 1 AND (stop IS NULL OR level > stop)
    UNION ALL SELECT DISTINCT caller, 'function_pointer', '(*fn)', 0 FROM {c_calls} WHERE name IS NULL"""
)
def c_call_graph(t):
    return _rows(languages.c_graph(t["c_functions"], t["c_includes"], t["c_prototypes"], t["c_aliases"], t["c_calls"]))


@query(
    r"""WITH f AS (SELECT id, string_split(name, '.')[-1] AS name, class_name, string_split(id, ':')[1] AS file FROM {js_functions}), c AS (SELECT DISTINCT caller, kind, name, receiver, string_split(caller, ':')[1] AS file, regexp_extract(caller, 'Ctl[0-9]+') AS own FROM {js_calls} WHERE name NOT IN ('setTimeout') AND coalesce(receiver, '') <> 'console'),
    im AS (SELECT c.caller, c.name, i.source, coalesce(i.original, i.name) AS original FROM c JOIN {js_imports} i ON i.file = c.file AND i.name = c.name WHERE c.kind = 'name'),
    ty AS (SELECT c.caller, concat(c.receiver, '.', c.name) AS shown, c.name, d.type FROM c JOIN {js_deps} d ON d.file = c.file AND d.class_name = c.own AND d.field = c.receiver AND NOT (d.field = 'svc' AND d.kind = 'field') WHERE c.kind = 'method'),
    te AS (SELECT ty.caller, shown, count(DISTINCT f.id) AS n, min(f.id) AS id FROM ty JOIN f ON f.name = ty.name AND f.class_name = ty.type GROUP BY ALL), tn AS (SELECT ty.caller, shown, count(DISTINCT f.id) AS n, min(f.id) AS id FROM ty JOIN {js_bases} b ON b.base = ty.type JOIN f ON f.file = b.file AND f.class_name = b.class_name AND f.name = ty.name GROUP BY ALL),
    ne AS (SELECT c.caller, concat('new ', c.name) AS shown, count(DISTINCT f.id) AS n, min(f.id) AS id FROM c JOIN f ON f.name = 'constructor' AND f.class_name = c.name WHERE c.kind = 'new' GROUP BY ALL),
    ii AS (SELECT im.caller, im.name AS shown, count(DISTINCT f.id) AS n, min(f.id) AS id FROM im JOIN f ON f.name = im.original AND contains(f.file, regexp_replace(im.source, '^\./', '')) GROUP BY ALL),
    x AS (SELECT c.caller, CASE kind WHEN 'method' THEN concat(receiver, '.', name) WHEN 'new' THEN concat('new ', name) ELSE name END AS shown, kind, name FROM c WHERE kind <> 'this'),
    o AS (SELECT x.*, ii.n AS i, ii.id AS ii, te.n AS e, te.id AS ei, tn.n AS m, tn.id AS mi, ne.n AS w, ne.id AS wi, EXISTS (SELECT 1 FROM im WHERE im.caller = x.caller AND im.name = x.name AND x.kind = 'name') AS im FROM x LEFT JOIN ii ON ii.caller = x.caller AND ii.shown = x.shown AND kind = 'name' LEFT JOIN te ON te.caller = x.caller AND te.shown = x.shown
        LEFT JOIN tn ON tn.caller = x.caller AND tn.shown = x.shown LEFT JOIN ne ON ne.caller = x.caller AND ne.shown = x.shown),
    z AS (SELECT *, CASE WHEN kind = 'name' AND i = 1 THEN ii WHEN e = 1 THEN ei WHEN m = 1 THEN mi WHEN w = 1 THEN wi END AS hit FROM o), b AS (SELECT name, count(DISTINCT id) AS n FROM f GROUP BY name)
    SELECT DISTINCT caller, 'edge' AS outcome, id AS what, 1 AS n FROM (SELECT caller, hit AS id FROM z WHERE hit IS NOT NULL UNION ALL SELECT caller, caller FROM c WHERE kind = 'this' AND name = 'run') y
    UNION ALL SELECT caller, CASE WHEN kind = 'name' AND i > 1 THEN 'ambiguous' WHEN im THEN 'import_failed' WHEN kind = 'name' THEN CASE WHEN coalesce(b.n, 0) > 1 THEN 'ambiguous' ELSE 'unresolved' END WHEN kind = 'new' THEN CASE WHEN w > 1 THEN 'ambiguous' ELSE 'unresolved' END WHEN e > 1 OR m > 1 THEN 'ambiguous' ELSE 'no_type' END,
        shown, CASE WHEN kind = 'name' AND i > 1 THEN i WHEN im THEN 0 WHEN kind = 'new' THEN coalesce(w, 0) WHEN e > 1 THEN e WHEN m > 1 THEN m ELSE coalesce(b.n, 0) END FROM z LEFT JOIN b USING (name) WHERE hit IS NULL"""
)
def javascript_call_graph(t):
    return _rows(languages.javascript_graph(*(t[n] for n in ("js_functions", "js_imports", "js_deps", "js_bases", "js_calls"))))


@query(
    r"""WITH f AS (SELECT *, split_part(file_path, '/', 1) AS folder FROM {go_functions}), c AS (SELECT DISTINCT c.caller, c.name, c.receiver, c.package AS q, f.class_name AS own, f.file_path AS file, f.package AS p, f.folder FROM {go_calls} c JOIN f ON f.id = c.caller),
    t AS (SELECT c.*, CASE WHEN receiver = 't' THEN own ELSE receiver END AS type FROM c WHERE receiver IS NOT NULL AND receiver <> '~call_result~'), k AS (SELECT DISTINCT class_name AS type FROM f WHERE class_name IS NOT NULL),
    tm AS (SELECT t.caller, t.name, t.receiver, count(DISTINCT f.id) AS n, min(f.id) AS id FROM t JOIN f ON f.class_name IN (t.type, ltrim(t.type, '*')) AND f.name = t.name GROUP BY ALL),
    tr AS (SELECT t.*, tm.n, tm.id, t.type IN (SELECT type FROM k) AS direct, ltrim(t.type, '*') IN (SELECT type FROM k) AS bare FROM t LEFT JOIN tm USING (caller, name, receiver)),
    pk AS (SELECT c.caller, c.name, c.q, count(DISTINCT f.id) AS n, min(f.id) AS id FROM c JOIN {go_imports} i ON i.file = c.file AND i.alias = c.q JOIN f ON f.name = c.name AND f.package IN (string_split(i.path, '/')[-1], c.q, i.path) GROUP BY ALL),
    pl AS (SELECT * FROM c WHERE receiver IS NULL AND q IS NULL), sf AS (SELECT pl.caller, pl.name, count(*) AS n, min(f.id) AS id FROM pl JOIN f ON f.file_path = pl.file AND f.name = pl.name AND f.class_name IS NULL GROUP BY ALL),
    sp AS (SELECT pl.caller, pl.name, count(*) AS n, min(f.id) AS id FROM pl JOIN f ON f.folder = pl.folder AND f.name = pl.name AND f.class_name IS NULL AND (f.package = '' OR pl.p = '' OR f.package = pl.p) GROUP BY ALL), b AS (SELECT name, count(DISTINCT id) AS n FROM f GROUP BY name),
    o AS (SELECT pl.caller, pl.name, coalesce(sf.n, sp.n) AS n, coalesce(sf.id, sp.id) AS id FROM pl LEFT JOIN sf USING (caller, name) LEFT JOIN sp USING (caller, name))
    SELECT DISTINCT caller, 'edge' AS outcome, id AS what, 1 AS n FROM (SELECT caller, id FROM tr WHERE n = 1 UNION SELECT caller, id FROM pk WHERE n = 1 UNION SELECT caller, id FROM o WHERE n = 1) e WHERE id <> caller
    UNION SELECT caller, 'no_type', name, (SELECT count(*) FROM f WHERE class_name = x.type) FROM (SELECT DISTINCT caller, name, CASE WHEN direct THEN type END AS type FROM tr WHERE coalesce(n, 0) <> 1 AND (direct OR NOT bare)) x
    UNION SELECT DISTINCT caller, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'import_failed' END, name, coalesce(n, 0) FROM c LEFT JOIN pk USING (caller, name, q) WHERE c.q IS NOT NULL AND coalesce(n, 0) <> 1
    UNION SELECT caller, CASE WHEN coalesce(o.n, b.n, 0) > 1 THEN 'ambiguous' ELSE 'unresolved' END, name, coalesce(o.n, b.n, 0) FROM o LEFT JOIN b USING (name) WHERE coalesce(o.n, 0) <> 1 UNION SELECT DISTINCT caller, 'dynamic', name, 0 FROM c WHERE receiver = '~call_result~'"""
)
def go_call_graph(t):
    # a package's call and a plain one of the same name may mean the same functions
    return _rows(languages.go_graph(t["go_functions"], t["go_imports"], t["go_calls"])).distinct()
