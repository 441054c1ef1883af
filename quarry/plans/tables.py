"""The driver's tables in the roles of the engine's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ids import document_id, stored_chunk_id
from quarry.functions.query import keywords
from quarry.operators.chunks import windows

SIZE, OVERLAP = 500, 100


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with collection, doc_type and source_path."""
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("collection"), F.col("lang").alias("doc_type"), path.alias("source_path"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed windows of all documents, with their stored ids."""
    docs = corpus(spark, sf)
    names = docs.select("doc_id", "collection", "doc_type", "source_path", document_id(F.col("text")).alias("file_id"))
    cut = windows(docs, SIZE, OVERLAP).join(names, "doc_id")
    return cut.withColumn("chunk_id", stored_chunk_id(F.col("file_id"), F.col("source_path"), F.col("chunk_index"), F.col("text")))


def item_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as queries (item_id, terms): 20 keywords in lower case at most."""
    return read(spark, sf, "benchmark").select("item_id", keywords(F.lower("text"), 2).alias("terms"))


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items with the stored vector of the same number as query vector."""
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return read(spark, sf, "benchmark").select("item_id").join(v, "item_id")


def stages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as stages of traces: one trace for each user, the value as elapsed time, ``k`` as number of results."""
    names = {"click": "dense_retrieval", "view": "sparse_retrieval", "purchase": "fusion"}
    stage = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("event_type")), F.col("event_type"))
    n = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf, "events").select(F.col("user_id").alias("trace_id"), stage.alias("stage"), F.col("ts").alias("started_at"), F.col("value").alias("elapsed_ms"), n.alias("n"), F.lit(None).cast("string").alias("error"), "event_id")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Stages in traces of one user's day, so that traces lack stages; results up to 3 count as none."""
    trace = F.concat(F.col("trace_id").cast("string"), F.lit("-"), F.date_format("started_at", "yyyyMMdd"))
    return stages(spark, sf).withColumns({"trace_id": trace, "n": F.when(F.col("n") > 3, F.col("n")).otherwise(0), "error": F.when(F.col("elapsed_ms") < 0.5, "late")})
