"""The corpus pipeline: quality rules, near-duplicates, leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the
columns of `documents`; the last returns its tokens.  Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import leaks, near_dups, pieces, pii, quality, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_OTHERS = ("lang", "source")


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    """The columns of `documents`; n_chars follows the text."""
    return rows.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that they remove.

    Null and empty texts are rejected; repeated rows and null ids are judged each by itself; an empty
    table stays empty; columns beyond those of `documents` go."""
    return _with_text(quality.quality_rules(docs, carry=_OTHERS).where("kept"), "clean_text")


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates.

    Texts without words have no duplicates and stay.  Rows that repeat an id are one document: that
    with the least text stays.  Rows without an id can't be told apart by one, and stay.  An empty table
    stays empty."""
    kept = near_dups.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    out = docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("r")).select("doc_id", "r.*")
    return out.join(repeated, "doc_id", "left_anti").unionByName(one).select(*COLUMNS)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; one of which nothing is left goes.

    Null text comes out as empty; repeated rows and null ids are searched each by itself; an empty
    table stays empty, and an empty benchmark changes no text."""
    found = leaks.benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=_OTHERS)
    return _with_text(found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))), "clean_text")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the kinds of personal data in their places.

    Null text stays null; repeated rows and null ids are masked each by itself, and all count in
    training; an empty table stays empty."""
    return _with_text(pii.masked(docs.select(*COLUMNS)), "text")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text.

    Null and empty texts have no pieces; repeated rows and null ids are encoded each by itself; an
    empty table gives an empty result."""
    return pieces.encode_pieces(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dups_stage),
    ("benchmark decontamination", leaks_stage),
    ("personal data", pii_stage),
    ("sentencepiece encoding", pieces_stage),
]
#: SQL can't express the pieces.  The tests hold each stage's rows against a brute-force version; where personal data
#: is, they take from its operator, as that is trained
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
