"""Writes that are seen whole or not at all: artifacts that must hold before they replace the last one, and a keyed store
whose upserts rewrite only what they touch.

Data go to new folders; what is current is said by one small file, which is replaced by a rename at the end.  So a
reader, and a writer that starts again after it was stopped, find the old state or the new one.  Two writers of one path
at a time are not kept apart: the later one's state stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import manifest_errors

POINTER = "current.json"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _state(spark: SparkSession, path: str) -> dict | None:
    where, fs = _at(spark, f"{path}/{POINTER}")
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{POINTER}", wholetext=True).collect())) if fs.exists(where) else None


def _put_state(spark: SparkSession, path: str, state: dict) -> None:
    """Replaces the file that says what is current, by a rename over it."""
    fs_package, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target, fs = _at(spark, f"{path}/{POINTER}")
    draft, _ = _at(spark, f"{path}/draft-{uuid.uuid4().hex}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    kind = getattr(fs_package, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    fs_package.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, how)


def _remove(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def _hashes(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table, file, sha256) of the part files of tables in a folder."""
    rows = None
    for name in names:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{name}")
        own = files.select(F.lit(name).alias("table"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
        rows = own if rows is None else rows.unionAll(own)
    return rows


@dataclass(frozen=True)
class Artifact:
    """A published set of tables: its folder, the tables, and the manifest (table, file, sha256) of their files."""

    folder: str
    tables: dict[str, DataFrame]
    manifest: DataFrame


def publish(tables: dict[str, DataFrame], path: str, checks: list[Callable[[dict[str, DataFrame]], DataFrame]], upstream: tuple[DataFrame, DataFrame] | None = None) -> list[tuple[str, int]]:
    """Writes tables as the new artifact, if it holds; else the old one stays.  Returns (rule, n) of what doesn't hold.

    The tables are written to a folder of their own and read back; each check gives a table (rule, n) of what it finds wrong
    in them, such as stages.artifact_errors or checks of evidence.  upstream: manifests (table, file, sha256), as said and as
    found, of what the artifact was made from.  Only when nothing is wrong is the manifest written, and then the folder made the
    current one; without that step nobody reads it.  Tables may be empty; there must be one at least."""
    spark, folder = next(iter(tables.values())).sparkSession, f"{path}/version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    staged = {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()}
    wrong = [(r.rule, int(r.n)) for check in checks for r in check(staged).where("n > 0").collect()]
    if upstream is not None and (n := manifest_errors(*upstream).count()):
        wrong.append(("upstream_hash", n))
    if wrong:
        _remove(spark, folder)
        return sorted(wrong)
    _hashes(spark, folder, list(tables)).write.parquet(f"{folder}/manifest")
    _put_state(spark, path, {"folder": folder, "tables": {name: df.schema.json() for name, df in tables.items()}})
    return []


def published(spark: SparkSession, path: str, verify: bool = True) -> Artifact | None:
    """The current artifact, or None before the first.  verify: raises ValueError if a file isn't as its manifest says."""
    from pyspark.sql.types import StructType

    if (state := _state(spark, path)) is None:
        return None
    folder = state["folder"]
    manifest = spark.read.schema("table string, file string, sha256 string").parquet(f"{folder}/manifest")
    if verify and (lost := manifest_errors(manifest, _hashes(spark, folder, list(state["tables"]))).limit(5).collect()):
        raise ValueError("the artifact's files differ from its manifest: " + ", ".join(f"{r.table}/{r.file}" for r in lost))
    return Artifact(folder, {name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{folder}/{name}") for name, schema in state["tables"].items()}, manifest)


class KeyedStore:
    """The last row of each key, in hash buckets; an upsert rewrites the buckets that its keys lie in, and no others.

    A bucket is one folder, so nothing has to be compacted; folders that an upsert replaced stay for those who still read
    them until `cleaned`.  buckets counts when the store is made; it should grow with the keys, a few million to each.  The
    greatest `order` wins, and of equal ones the later upsert."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", order: str = "ts", buckets: int = 64):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.buckets = (_state(spark, self.path) or {"buckets": buckets})["buckets"]

    def _rows(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The rows, or None before the first upsert."""
        from pyspark.sql.types import StructType

        state = _state(self.spark, self.path)
        return None if state is None else self._rows(list(state["folders"].values()), StructType.fromJson(json.loads(state["schema"])))

    def upsert(self, new: DataFrame, source: str | None = None, number: int | None = None) -> list[int]:
        """Puts rows in; returns the buckets that were written.  Null keys are one key.

        source, number: a stream's id and batch; a batch that was put in before is left out, so a restarted stream
        repeats nothing, and a stream with a new checkpoint, whose batches count from 0 again, is another source."""
        state = _state(self.spark, self.path) or {"buckets": self.buckets, "folders": {}, "applied": {}, "schema": new.schema.json()}
        if source is not None and state["applied"].get(source, -1) >= number:
            return []
        # of one batch a key's last row is taken before the rows are dealt, so a hot key is one row for each task
        rest = [c for c in new.columns if c != self.order]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        last = new.groupBy(F.col(self.key).alias("_key")).agg(F.max(F.struct(self.order, *rest)).alias("_row")).select("_row.*").select(*new.columns, bucket.alias("_bucket"))
        folder = f"{self.path}/run-{uuid.uuid4().hex}"
        last.write.partitionBy("_bucket").parquet(f"{folder}/new")
        touched = sorted(r[0] for r in self.spark.read.parquet(f"{folder}/new").select("_bucket").distinct().collect()) if self._has(f"{folder}/new") else []
        old = self._rows([state["folders"][str(b)] for b in touched if str(b) in state["folders"]], new.schema)
        fresh = self.spark.read.parquet(f"{folder}/new").select(*new.columns) if touched else self._rows([], new.schema)
        both = old.withColumn("_late", F.lit(0)).unionByName(fresh.withColumn("_late", F.lit(1)))
        ranked = both.groupBy(F.col(self.key).alias("_key")).agg(F.max(F.struct(self.order, "_late", *rest)).alias("_row")).select("_row.*").select(*new.columns, bucket.alias("_bucket"))
        if touched:
            ranked.repartition(min(len(touched), self.buckets), "_bucket").write.partitionBy("_bucket").parquet(f"{folder}/rows")
        state["folders"] |= {str(b): f"{folder}/rows/_bucket={b}" for b in touched}
        if source is not None:
            state["applied"][source] = number
        _put_state(self.spark, self.path, state)
        _remove(self.spark, f"{folder}/new")
        return touched

    def _has(self, path: str) -> bool:
        where, fs = _at(self.spark, path)
        return any("_bucket=" in s.getPath().getName() for s in fs.listStatus(where))

    def cleaned(self) -> int:
        """Removes what no current bucket points to; returns how many folders went."""
        state = _state(self.spark, self.path)
        keep = {f.rsplit("/", 3)[1] + "/" + f.rsplit("/", 1)[1] for f in (state or {"folders": {}})["folders"].values()}
        where, fs = _at(self.spark, self.path)
        gone = 0
        for run in fs.listStatus(where) if fs.exists(where) else []:
            if run.getPath().getName().startswith("run-"):
                rows, _ = _at(self.spark, f"{run.getPath()}/rows")
                parts = list(fs.listStatus(rows)) if fs.exists(rows) else []
                dead = [p.getPath() for p in parts if "_bucket=" in p.getPath().getName() and f"{run.getPath().getName()}/{p.getPath().getName()}" not in keep]
                alive = any(f"{run.getPath().getName()}/" in k for k in keep)
                for p in dead if alive else [run.getPath()]:
                    fs.delete(p, True)
                    gone += 1
        return gone
