"""Canonical JSON of free-form texts against the standard library."""

import hashlib
import json

from sieveworks.operators import nested

TEXTS = [
    '{"b": 1, "a": [1, 2.0, {"z": null, "y": [[], {}, [1, [2, [3, {"deep": "x"}]]]]}], "é": "ü\\u0001\\u001f\\n\\"\\\\/", "": true, "A": false}', "1.0", "1.50", "1e5", "-0", "-0.0", "1E400", "-1e400", "12345678901234567890", "123456789012345678901234567890123456789012",
    '"a\\u000b\\u007f\\u2028\\t"', "null", " [1] ", "1e-7", "0.1", "[]", "{}", "3.14159265358979", "0.30000000000000004", "123456789.123456789", "1e16", "1e15", "123456789012345680.0", "0.0001", "0.00001234", "1.5e300", "2.5E-3", "-7.25", "1e22", "100", "1000000000000000.5",
    '{"\\uffff": 1, "\\ud83d\\ude00": 2, "z": 3, "Z": 4, "10": 5, "9": 6}', '["1", "-2", "number 3", 4, "\\u0001number x", {"\\u0001number k": 1, "\\u0001": 2}]', '{"a b": {"c:d": ["e,f"]}, "-": "-1"}', json.dumps(list(range(12))), '"[1, {"',
]
BROKEN = [None, "", "bad", "{", "01", "1.", "[1,]", "--1", '{"a": 1', "NaN"]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def stable(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_equals_the_library(spark):
    want = {k: stable(json.loads(t)) for k, t in enumerate(TEXTS)}
    got = {r.id: r.text for r in nested.canonical(nested.json_nodes(table(spark, TEXTS))).collect()}
    assert got == want
    digests = {r.id: r.sha256 for r in nested.digests(table(spark, TEXTS + BROKEN)).collect()}
    assert digests == {k: hashlib.sha256(want[k].encode()).hexdigest() if k in want else None for k in range(len(TEXTS + BROKEN))}


def test_keys_are_dropped_at_any_depth(spark):
    text = '{"verdict": 1, "a": {"b": [{"c": {"d": {"severity": "high", "e": [{"verdict": {"x": 1}}, 2]}}}]}, "list": ["verdict"], "decision": {}}'
    got = {r.id: r.text for r in nested.without_conclusions(table(spark, [text, "[]", None])).collect()}
    assert got == {0: '{"a":{"b":[{"c":{"d":{"e":[{},2]}}}]},"list":["verdict"]}', 1: "[]"}


def test_empty_table(spark):
    assert nested.digests(table(spark, []).limit(0)).collect() == [] and nested.canonical(nested.json_nodes(table(spark, BROKEN))).collect() == []


def test_whole_texts_are_neither_shuffled_nor_written(spark, monkeypatch):
    """Texts go through alone, with what `canonical` makes of their nodes; repeated keys and trailing text are broken."""
    odd = ['{"a": 1, "a": 2}', '{"a": 1} x', "Infinity", "[1" + "0" * 5000 + "]", "[" * 300 + "]" * 300, '{"verdict": 1, "verdict": 2}']
    for f in ("settled", "stored"):
        monkeypatch.setattr(nested, f, lambda df: 1 / 0)
    made = nested.canonical_texts(table(spark, TEXTS + BROKEN + odd))
    got = [r.text for r in made.orderBy("id").collect()]
    assert got == [stable(json.loads(t)) for t in TEXTS] + [None] * (len(BROKEN) + 3) + [odd[3], odd[4], None]
    assert "Exchange" not in nested.digests(table(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert [r.text for r in nested.without_conclusions(table(spark, odd)).collect()] == [odd[3], odd[4]]
