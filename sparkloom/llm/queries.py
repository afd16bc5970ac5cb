"""The queries of this package's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fim, jaccard, merkle, mixing, packing, quality_forest, substrings, topk, toxicity, url_filter, warc, wrappers


def tokenizer_path() -> str:
    """The public byte-level BPE file; found on the driver, at the same place on all machines."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"))


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.edited(table(spark, folder, "documents")).drop("edits")


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.components(table(spark, folder, "documents"), k=4, percent=85)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_forest.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    rows = fim.fim(table(spark, folder, "documents"))
    text = fim.restored(F.col("form"), F.col("output"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_extraction, op2_url_filters, op3_fingerprints, op4_substring_dedup, op5_top_k, op6_packing, op7_ngram_jaccard_join, op8_toxicity, op9_mixing, op10_warc, op11_source_divergence, op12_quality_rules, op13_fill_in_middle]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": url_filter.ORACLE_SQL, "op3_fingerprints": merkle.ORACLE_SQL, "op4_substring_dedup": substrings.ORACLE_SQL, "op7_ngram_jaccard_join": jaccard.ORACLE_SQL, "op5_top_k": topk.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op13_fill_in_middle": fim.ORACLE_SQL}
