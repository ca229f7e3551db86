"""The operators as registered queries, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credentials, decontamination, licences, lines, mixing, naming, pages, phrases, quality, ranking, simhash, suffixes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(_table(spark, sf_dir, "pages"), min_pages=5, min_share=0.2)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_substrings(_table(spark, sf_dir, "documents"), width=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Small ranges, so that the archives of these tables are really split.
    read = warc.archived_pages(_table(spark, sf_dir, "pages"), min_revisit_bytes=0, split_bytes=1 << 19)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), error_rate=0.05)
    items = F.array_distinct("matches.item_id")
    return found.select(
        "row.doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids")
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), max_rows=4000)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.assess(docs, model).select("row.doc_id", *columns, "probability")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    return found.select("row.doc_id", "n_lines", "n_removed", "n_runs", "kept_text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2)
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = licences.find_licences(docs, licences.train(docs, max_paragraphs=1000))
    sure = F.filter("notices", lambda n: n["family"] != licences.UNKNOWN)
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda n: n["family"]))), ",").alias("families"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(_table(spark, sf_dir, "documents"), scope=300)
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{credentials.KINDS[k]}") for k in range(3)),
        F.sha2(credentials.listed("base"), 256).alias("base_sha256"),
        credentials.listed("spans").alias("spans"),
    )


def op11_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = naming.exact_groups(_table(spark, sf_dir, "documents"), block_bytes=1024)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), most=3, least=10, absorbed=50, top=2000)


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.best_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_suffixes": op2_suffixes,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_lines": op7_lines,
    "op8_mixing": op8_mixing,
    "op9_licences": op9_licences,
    "op10_secrets": op10_secrets,
    "op11_naming": op11_naming,
    "op12_phrases": op12_phrases,
    "op13_ranking": op13_ranking,
}

#: SQL for a second engine, where SQL can express the operator.
SQL: dict[str, str] = {
    "op3_warc": warc.sql("pages"),
    "op7_lines": lines.sql("documents"),
    "op8_mixing": mixing.sql("documents"),
    "op11_naming": naming.sql("documents"),
    "op12_phrases": phrases.sql("documents"),
    "op13_ranking": ranking.sql("documents", "benchmark"),
}
