"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import chat_format, html_extract, importance_resampling, jaccard_join, language_id, license_scan, mixing, oracles, quality, sentencepiece_codec, topk_search, url_filter, warc, whitening
from helixframe.llm._shared import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id.identify(docs, language_id.train(docs))


def transcripts(turns: DataFrame) -> DataFrame:
    """The turns as lines of transcripts whose speakers are partly lost: of the markers 15 % are missing, 20 % name nobody.

    `held_out` marks the conversations, a quarter by crc32, from which nothing is learned.
    """
    fate = F.pmod(F.xxhash64(F.lit("marker"), "conv_id", "turn"), F.lit(20))
    marker = F.when(fate < 3, "").when(fate < 5, "Speaker: ").when(fate < 7, ">> ").otherwise(F.concat(F.initcap("role"), F.lit(": ")))
    text = F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", text.alias("text"), language_id.held_out(F.col("conv_id")).alias("held_out"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with lost markers, parsed and rendered; the model learns from the conversations that are not held out."""
    turns = transcripts(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    found = chat_format.format_chats(turns, F.when(~F.col("held_out"), F.lower("role")))
    return found.withColumn("held_out", language_id.held_out(F.col("conv_id")))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ledger = quality.apply_policy(quality.quality_ledger(docs), "v1")
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return importance_resampling.resample(docs, target).drop("n_words")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose records hold at most 4 KiB, so that about half of the pages are put together from segments."""
    index = warc.archive_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"), segment_bytes=1 << 12)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy drops, alone and with the others, over all documents."""
    return quality.ablations(quality.quality_ledger(table(spark, sf_dir, "documents", "doc_id", "text")), "v1")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_html_extract": op2_html_extract,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_chat_format": op7_chat_format,
    "op8_top_k": op8_top_k,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_whitening": op12_whitening,
    "op13_warc": op13_warc,
    "quality_ablations": quality_ablations,
}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": oracles.OP4, "op8_top_k": oracles.OP8, "op9_mix_sources": oracles.OP9, "op10_quality_rules": oracles.OP10, "op11_importance_resampling": oracles.OP11, "op13_warc": oracles.OP13,
    "quality_ablations": oracles.ABLATIONS,
}
