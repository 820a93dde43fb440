"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import Tables, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: bytes of a table, as Spark estimates them, that is broadcast without being asked for
SMALL = 64 << 10


def shuffling(spark: SparkSession) -> SparkSession:
    """A session on the same context, with the same settings, whose joins shuffle both sides instead of gathering one on the driver.

    A Parquet file of 5 MB may hold a million rows and be exploded behind that; by its size Spark would gather all of it on the
    driver.  Nor are sides gathered there that turn out to be small: each takes a page of 64 MB, and loops have dozens.  Tables
    of a few KB, literals among them, are broadcast as always.  The caller's session stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", str(SMALL))
    own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    return own


def query(sql: str | None = None):
    """Registers a function of Tables by its name, with SQL for the same rows where there is any."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(shuffling(spark), sf_dir))
        if sql:
            ORACLES[f.__name__] = duckdb_sql(sql)
        return f

    return add
