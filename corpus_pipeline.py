"""The corpus pipeline: five stages over ``documents``, each written and reread as the next input.

Filtering stages keep whole rows.  Word shingles take five words and a similarity of 0.8.
The last stage returns the encoded corpus.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, decontam, ngram_join, quality, suffix_dedup
from driftline.llm.common import cleared, cut, join_per_key, remove, shared_dir, table

#: Documents scored below this are rejected.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.  Rows are judged one by one, so equal
    texts, repeats and ties at the threshold (kept) fare alike; null and empty texts by the prior
    statistics; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.  A row is its id and its
    text, by a 64-bit key, so another text under the id of a copy stays; of texts under the smallest
    id the least key stays.  Exact repeats of a kept row stay, and rows without words or without id."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    grouped = ngram_join.group_documents(docs.select(key.alias("row"), "text"), ngram_join.Rule(5, 80, 100), "row")
    placed = grouped.filter("n_shingles > 0 and id is not null").select(F.col("id").alias("row"), F.col("component_id").alias("component")).distinct()
    known = docs.select(key.alias("row"), "doc_id").filter("row is not null").groupBy("row").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("id_to"))
    one = F.when(F.col("id") == F.col("id_to"), F.col("id")).otherwise(F.raise_error(F.lit("two different ids have one 64-bit key")).cast("long"))
    rows = cut(placed.join(known, "row").select("component", F.struct(one.alias("id"), "row").alias("own")))
    first = rows.groupBy("component").agg(F.min("own").alias("first"), F.count("*").alias("size")).filter("size > 1")
    copies = join_per_key(rows, first, "component", "size").filter("own != first").select(F.col("own.id").alias("copy_id"), F.col("own.row").alias("copy_key"))
    rest = docs.join(copies, (docs["doc_id"] == F.col("copy_id")) & (key == F.col("copy_key")), "left_anti")
    return rest.select(docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds.  A character goes only if all of
    its bytes go; ``n_chars`` follows the text.  No row goes: null texts become empty, of equal
    texts that of the smallest id stays whole, rows of one id never cut each other."""
    shortened = suffix_dedup.dedup_texts(docs)
    return shortened.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item.  Null and empty texts match nothing
    and stay; equal texts and repeats fare alike; a similarity of exactly 0.8 is a match."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; decoding them must give the text's bytes back, or the job fails.
    Every row stays; null and empty texts have no ids."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", F.col("text").alias("whole"), "text"), path, pattern)
    same = F.col("decoded") == F.coalesce(F.col("whole"), F.lit("")).cast("binary")
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("decoded bytes differ from the text")).cast("array<int>"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), checked.alias("ids"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL expresses neither the classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a Parquet table in the shared folder.  A stage's
    intermediate tables go once its result is written, and its input once nothing reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
