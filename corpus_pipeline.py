"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; ``n_chars`` is
kept true where a stage changes the text.  Null texts count as empty, texts of
any length are taken whole, other columns pass through all stages but the last,
and an empty table gives empty results; what holds for repeated rows, null
doc_ids and ties is said where each stage's operator is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, lines, mixing, queries, rules, simhash
from quarry.llm.common import ensure_checkpoint_dir

#: SimHash components and fitted rates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the full policy rejects."""
    return rules.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; documents left without a word go."""
    kept = lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(lines.BLANKS))) > 0)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles to 0.8 stays: the one with the smallest doc_id."""
    return simhash.one_of_each(docs, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the domains' tokens meet the target weights."""
    return mixing.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and the decoded text's digest for each document."""
    found = bpe.bpe(docs, queries.tokenizer_path())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the whole table; each result is written to the shared folder and read again, so a loss repeats one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
