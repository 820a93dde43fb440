"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, counts, leaks, licenses, near_dups, oracles, pieces, pii, quality, repeats, secrets, shared, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fiftieth page the archive also has a torn first try, which the reader must get over:
    after_gap tells the records that it recovered behind a quarantined gap."""
    path = shared.folder(spark)
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html", (F.col("page_id") % 50 == 0).alias("torn"))
    warc.write_archives(pages, path, torn_col="torn")
    found = warc.with_revisits(warc.read_archives(spark, path, with_payload=False), extra=("gap_before",)).withColumnRenamed("gap_before", "after_gap")
    shared.remove(spark, path)  # with_revisits has written what it read
    return found


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count_kind("spans", k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), with_text=False)
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all documents are written as a table; then three edits of every document come in:
    a deletion at a quarter of it, an insertion in the middle of what is then there, a replacement
    near the end."""
    trees = shared.written(counts.token_trees(_table(spark, sf_dir, "documents")))
    n = F.aggregate("leaves", F.lit(0).cast("bigint"), lambda acc, leaf: acc + leaf["chars"])

    def edit(start, length, text):
        return F.struct(start.cast("bigint").alias("start"), (start + length).cast("bigint").alias("end"), F.lit(text).alias("text"))

    edits = F.array(edit(F.floor(n / 4), 7, ""), edit(F.floor(n / 2), 0, " an inserted passage, isn't it? "), edit(F.floor(n * 3 / 4), 5, "12 \n"))
    done = counts.edited_trees(trees, edits)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), "n_pretokens", "n_reencoded", "n_leaves_opened", "n_chars_after")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    counts = [_count_kind("spans", k).alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), with_text=False).drop("clean_text")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(_table(spark, sf_dir, "documents"), with_text=False).drop("removed", "clean_text")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(_table(spark, sf_dir, "documents"), with_groups=False).drop("groups")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations")
    return conversations.repaired(conversations.damaged(table), ids=table, times=F.col("times"))[0]


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are removed once what was read from them is a table."""
    path = shared.folder(spark)
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    found = shared.written(token_files.read_token_files(spark, path, with_ids=False).drop("ids"))
    shared.remove(spark, path)
    return found


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's columns that don't depend on training."""
    return op2_personal_data(spark, sf_dir).drop("spans")


def license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's exact phrases."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's fixed shapes."""
    return op8_secret_scan(spark, sf_dir).drop("spans")


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's counts of the whole text."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_warc_salvage, op2_personal_data, op3_benchmark_decontamination, op4_license_scan, op5_minhash_near_dups, op6_edit_aware_counts, op7_sentencepiece, op8_secret_scan, op9_quality_rules,
            op10_suffix_array_dedup, op11_tokenizer_alignment, op12_conversation_repair, op13_token_files, personal_data_base, license_scan_base, secret_scan_base, quality_rules_base,
        )
    }
