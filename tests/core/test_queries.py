"""Every registered query of the core against its SQL in DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveworks.functions import texts
from sieveworks.plans import derived, queries, registry

TABLES = derived.BASE


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equals_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    out = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, out.fetchall())
    assert len(got) == len(want) and got == want
    assert want or name == "state_violations"


def test_metric_checks_count_all_units(spark, sf_dir, duck, monkeypatch):
    seen, rules = [], queries.stages.metric_errors
    monkeypatch.setattr(queries.stages, "metric_errors", lambda row: seen.append(row.collect()[0]) or rules(row))
    queries.QUERIES["metric_checks"](spark, sf_dir)
    (row,) = seen
    first, total = duck.execute("SELECT (SELECT count(*) FROM orders), (SELECT count(*) FROM (SELECT p_partkey FROM part UNION SELECT o_orderkey FROM orders) x)").fetchone()
    assert sum(row[f"stage1_{k}"] for k in ("candidates", "no_finding", "inconclusive", "errors")) == first
    assert row.total_units == row.reachable + row.unreachable + row.unknown_reachability == total


def test_stable_ids_of_empty_and_missing_values_equal_sql(spark, tmp_path):
    docs = [(0, "", "en", "s", 0), (1, None, "en", "s", 0), (2, "t", "en", "s", 9), (3, "t", "en", "s", 10), (4, "t", "en", "s", 1_234_567), (-1, "t", "en", "s", -5), (-2, "t", "en", "s", -12345)]
    docs += [(5, "t", None, "s", 1), (6, "t", "en", None, 1), (7, "t", None, None, 1), (8, "t", "en", "s", None), (None, "t", "en", "s", 1), (None,) * 5]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, out = queries.QUERIES["stable_ids"](spark, str(tmp_path)), con.execute(queries.ORACLES["stable_ids"])
    want = rows([d[0] for d in out.description], out.fetchall())
    assert rows(df.columns, df.collect()) == want and len(want) == len(docs)
    assert {r.doc_id: r.cost for r in df.where("doc_id in (0, 8, -2)").collect()} == {0: "$0.00", 8: "$", -2: "$-12345.00"}


def test_costs_keep_their_places(spark):
    """Four below a cent, else two, unless places are said; null is no amount, and a missing hash keeps its place in an id."""
    amounts = spark.createDataFrame([(0.0,), (0.004,), (5.0,), (1234.5,), (None,)], "a double")
    shown = lambda *more, **kind: [r[0] for r in amounts.select(texts.cost_text(F.col("a"), *more, **kind)).collect()]
    assert shown() == ["$0.0000", "$0.0040", "$5.00", "$1,234.50", None] and shown(places=2) == ["$0.00", "$0.00", "$5.00", "$1,234.50", None]
    assert shown(places=3) == ["$0.000", "$0.004", "$5.000", "$1234.500", None] and shown(F.lit("GBP"), places=2) == ["0.00 GBP", "0.00 GBP", "5.00 GBP", "1234.50 GBP", None]
    none, said = F.lit(None).cast("string"), lambda x: F.lit(x).cast("string")
    ids = spark.range(1).select(texts.evidence_id(F.lit("code"), said("s"), none, none), texts.evidence_id(F.lit("code"), said("s"), said(""), said("")), texts.evidence_id(F.lit("code"), none, said("s"), said(""))).collect()[0]
    assert ids[0] == ids[1] != ids[2]


def test_no_core_module_names_the_corpus_folder():
    top = os.path.dirname(queries.__file__) + "/.."
    for folder, _, files in os.walk(top):
        if "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f)).read()


def test_joins_of_queries_gather_no_side_on_the_driver(spark, tmp_path):
    """A file's size says little of its rows; the caller's own session stays as it is."""
    spark.range(300_000).selectExpr("id", "id % 7 AS k").write.parquet(f"{tmp_path}/t")
    plan = lambda s: (lambda t: t.join(t.selectExpr("id", "explode(sequence(0, 9)) AS x"), "id"))(s.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    own = registry.shuffling(spark)
    assert "Broadcast" in plan(spark) and "Broadcast" not in plan(own)
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
