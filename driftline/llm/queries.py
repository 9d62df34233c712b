"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, decontam, embed_dedup, html_extract, ngram_join, quality, sharding, suffix_dedup, toxicity, warc
from driftline.llm.common import shared_dir, table
from driftline.llm.oracles import ORACLES


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = ngram_join.group_documents(table(spark, sf_dir, "documents"), ngram_join.Rule(4, 85, 100))
    return grouped.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{warc.archive_name()}"
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), path)
    return warc.page_index(spark, path)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40, f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_array_dedup, op2_quality_classifier, op3_html_extraction, op4_decontamination, op5_ngram_jaccard, op6_warc, op7_embedding_dedup, op8_sharding, op9_byte_bpe, op10_toxicity]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL twins where SQL can express a query; tests hold the others against brute force."""
    return dict(ORACLES)
