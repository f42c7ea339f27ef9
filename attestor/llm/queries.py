"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, langid, license_scan, line_dedup, media, ngram_join, packing, quality, resampling, sentencepiece_codec, suffix_dedup, token_counts
from .common import checkpoint_root, materialise, table


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file on this machine; each executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 1).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = materialise(token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), "byte_bpe_50k", tokenizer("byte_bpe_50k.tiktoken")), "token-counts", keep=True)
    ledger = token_counts.TokenLedger(spark, f"{checkpoint_root(spark)}/attestor/ledger-{uuid.uuid4().hex}")
    first = token_counts.estimated_counts(docs, "byte_bpe_50k")
    ledger.commit("load", token_counts.insertions(first))
    ledger.commit("count", token_counts.revisions(first, counts))  # estimates go, counts come
    ledger.commit("count", token_counts.revisions(first, counts))  # a retry adds nothing
    return ledger.totals()


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), 3, 90)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, 2, tokenizer("byte_bpe_50k.tiktoken"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = chat_format.canonical_turns(chat_format.mixed_records(rows.unionByName(hard)))
    return chat_format.digests(chat_format.read_back(chat_format.format_conversations(turns)))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, images = media.text_media(table(spark, sf_dir, "documents"))
    parsed = media.parse_pages(pages, "doc_id", keep=("n_bytes",))
    resolved = media.resolve(parsed, media.media_features(images), "doc_id", keep=("n_bytes",))
    return resolved.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "n_items", "caption")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_license_scan, op3_line_dedup, op4_token_counts, op5_ngram_join, op6_best_fit_packing, op7_chat_format, op8_media_columns, op9_quality_rules, op10_language_id, op11_collocations, op12_suffix_dedup, op13_importance_resampling)
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op11_collocations": collocations.oracle_sql(),
}
