"""Incremental ingestion of a stream of documents: each micro-batch is merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.ingest import ingest
from quarry.operators.sparse import postings, tokenised


def start(documents: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Ingests what arrives and stops when nothing is left.

    A batch's chunks and history go to folders named by its number, written
    whole, so that a batch that runs again after a failure replaces itself.
    Documents whose last batch had the same text are left out; a document that
    comes again changed is ingested again, see :func:`current`.
    """
    spark = documents.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        schema = f"doc_id {batch.schema['doc_id'].dataType.simpleString()}, file_hash string, collection string, status string, batch long"
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/history")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        history = (spark.read.schema(schema).parquet(f"{target}/history") if there else spark.createDataFrame([], schema)).where(F.col("batch") < number)
        once = batch.dropDuplicates(["doc_id"])
        last = history.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        history = history.join(last, ["doc_id", "batch"], "left_semi")
        ingest(once, history).write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        seen = once.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), "collection", F.lit("success").alias("status"))
        done = seen.join(history.select("file_hash", "collection"), ["file_hash", "collection"], "left_anti").select(seen.columns)
        done.write.mode("overwrite").parquet(f"{target}/history/batch={number}")

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks that hold now: of a document that came again changed only those of its last batch."""
    history = spark.read.parquet(f"{target}/history")
    last = history.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{target}/chunks").join(last, ["doc_id", "batch"], "left_semi")


def current_postings(spark: SparkSession, target: str) -> DataFrame:
    """Postings (chunk_id, term, tf, doc_length) of the chunks that hold now, so a document that came again replaces its own."""
    return postings(tokenised(current(spark, target).where("chunk_id IS NOT NULL"), "chunk_id"), "chunk_id")
