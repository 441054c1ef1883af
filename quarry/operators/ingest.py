"""Ingestion of many documents in one job; what fails becomes a row, not an exception."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import ids, text
from quarry.operators import catalog
from quarry.operators.chunks import windows


def ingest(documents: DataFrame, history: DataFrame, splitter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks of the documents (doc_id, text, source_path, collection) that ``history`` doesn't list as done.

    Split, refined by rule, enriched by rule; columns doc_id, chunk_index,
    chunk_id, offsets of the source text, text (refined), title, summary, tags
    and error.  A chunk that refining empties has an error and no id.
    """
    done = history.where("status = 'success'").select("file_hash", "collection")
    known = documents.withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256))
    fresh = known.join(done, ["file_hash", "collection"], "left_anti")
    cut = (splitter or (lambda d: windows(d, 500, 100)))(fresh)
    meta = fresh.select("doc_id", "source_path", "collection", F.concat(F.lit("doc_"), F.substring("file_hash", 1, 16)).alias("file_id"))
    rows = cut.join(meta, "doc_id").withColumn("text", text.refine(F.col("text")))
    there = F.col("text") != ""
    return rows.select(
        "doc_id",
        "collection",
        "chunk_index",
        F.when(there, ids.stored_chunk_id(F.col("file_id"), F.col("source_path"), F.col("chunk_index"), F.col("text"))).alias("chunk_id"),
        "start_offset",
        "end_offset",
        "text",
        F.when(there, text.title(F.col("text"))).alias("title"),
        F.when(there, text.summary(F.col("text"))).alias("summary"),
        F.when(there, text.keyword_tags(F.col("text"))).alias("tags"),
        F.when(~there, "the chunk is empty after refining").alias("error"),
    )


def run(documents: DataFrame, history: DataFrame, now: str, splitter: Callable[[DataFrame], DataFrame] | None = None, embed: Callable[[Column], Column] | None = None, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Ingestion to the end: the tables ``chunks``, ``vectors``, ``history`` and ``failed`` as they are afterwards.

    Documents that the history lists as done are left out; the others are split,
    refined, enriched and, with an embedder, embedded, and their chunks take the
    place of all chunks of the same source in ``stored``.  A document without a
    good chunk is a row of ``failed`` with its error and is marked so.
    """
    made = ingest(documents, history, splitter)
    places = documents.select("doc_id", "source_path", "collection", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    state = made.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("n"), F.max("error").alias("error"))
    done = history.where("status = 'success'").select("file_hash", "collection")
    outcome = places.join(done, ["file_hash", "collection"], "left_anti").join(state, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    good = outcome.where("n > 0")
    failed = outcome.where("n = 0").select("doc_id", "source_path", "collection", "file_hash", F.coalesce("error", F.lit("the document has no text")).alias("error"))
    after = catalog.marked(history, good.select("file_hash", F.col("source_path").alias("file_path"), "collection"), "success", now)
    after = catalog.marked(after, failed.select("file_hash", F.col("source_path").alias("file_path"), "collection", F.col("error").alias("error_msg")), "failed", now)
    chunks = made.where("error IS NULL").join(places.select("doc_id", "source_path"), "doc_id").drop("error")
    if stored is not None:
        kept = stored.join(good.select("source_path", "collection"), ["source_path", "collection"], "left_anti")
        everything = kept.unionByName(chunks, allowMissingColumns=True)
    else:
        everything = chunks
    vectors = chunks.select("chunk_id", "collection", embed(F.col("text")).alias("embedding")) if embed else chunks.select("chunk_id", "collection", F.lit(None).cast("array<float>").alias("embedding"))
    return {"chunks": everything, "vectors": vectors, "history": after, "failed": failed}


def stage_counts(chunks: DataFrame) -> DataFrame:
    """One row (n_chunks, avg_size, n_refined, n_enriched): what a pipeline reports of good chunks; sizes in whole characters."""
    there = chunks.where("error IS NULL")
    return there.agg(F.count("*").alias("n_chunks"), F.coalesce(F.floor(F.sum(F.length("text")) / F.count("*")), F.lit(0)).alias("avg_size"), F.count_if(F.length("text") < F.col("end_offset") - F.col("start_offset")).alias("n_refined"), F.count_if(F.size("tags") > 0).alias("n_enriched"))


def summary(chunks: DataFrame) -> DataFrame:
    """One row (n_documents, n_failed, n_chunks, exit_code): exit code 0 if all chunks are good, 2 if none, else 1."""
    bad = F.col("error").isNotNull()
    got = chunks.agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct(F.when(bad, F.col("doc_id"))).alias("n_failed"), F.count_if(~bad).alias("n_chunks"))
    return got.withColumn("exit_code", F.when(F.col("n_failed") == 0, 0).when(F.col("n_chunks") == 0, 2).otherwise(1))


def with_captions(chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """Chunks whose image placeholders are followed by the captions (image_id, caption) that are known.

    Each image is captioned once; a chunk looks up only the images it names.
    """
    each = chunks.select("chunk_id", F.explode(F.array_distinct(text.image_refs(F.col("text")))).alias("image_id"))
    known = each.join(captions, "image_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "caption"))).alias("c"))

    def put(body: Column, c: Column) -> Column:
        mark = F.concat(F.lit("[IMAGE: "), c["image_id"], F.lit("]"))
        return F.replace(body, mark, F.concat(mark, F.lit("\n(Description: "), c["caption"], F.lit(")")))

    joined = chunks.join(known, "chunk_id", "left")
    return joined.withColumn("text", F.coalesce(F.aggregate("c", F.col("text"), put), F.col("text"))).drop("c")


def delete_document(stores: dict[str, DataFrame], key: str, value: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each store without a document's rows, and rows (store, n_deleted)."""
    gone = F.coalesce(F.col(key) == value, F.lit(False))
    counts = None
    for name, rows in stores.items():
        one = rows.agg(F.count_if(gone).alias("n_deleted")).select(F.lit(name).alias("store"), "n_deleted")
        counts = one if counts is None else counts.unionByName(one)
    return {name: rows.where(~gone) for name, rows in stores.items()}, counts
