"""Catalog: documents, collections and their lifecycle as merges by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import path_stem, preview


def normalised_tags(value: Column) -> Column:
    """Tags of a JSON list or a comma string, blanks trimmed, empty ones dropped."""
    decoded = F.try_parse_json(value)
    listed = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>"))
    parts = F.coalesce(F.when(decoded.isNotNull(), listed), F.split(value, ",", -1))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def resolved_title(title: Column, source_path: Column, text: Column) -> Column:
    """Given title, else the path's stem, else the first line that isn't blank, else a default."""
    line = F.filter(F.split(F.coalesce(text, F.lit("")), "\\n"), lambda x: F.trim(x) != "")
    first = F.trim(F.regexp_replace(F.get(line, 0), "^[# ]+|[# ]+$", ""))
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(path_stem(F.nullif(F.trim(source_path), F.lit(""))), F.lit("")), F.nullif(first, F.lit("")), F.lit("Untitled Document"))


def document_catalog(chunks: DataFrame) -> DataFrame:
    """One row for each document of ``chunks`` (doc_id, chunk_index, chunk_id, text, title, source_path, doc_type, tags array, page).

    Attributes are those of the first chunk; chunk ids in order; tags distinct
    in the order of their first chunk; pages distinct and sorted.  What a
    document gathers is bounded by its own chunks.
    """
    first = F.min_by(F.struct("title", "source_path", "doc_type", "text"), "chunk_index").alias("f")
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "tags"))).alias("l")
    by = chunks.groupBy("doc_id").agg(first, listed, F.array_sort(F.collect_set("page")).alias("pages"))
    return by.select(
        "doc_id",
        resolved_title(F.col("f.title"), F.col("f.source_path"), F.col("f.text")).alias("title"),
        "f.source_path",
        "f.doc_type",
        preview(F.col("f.text")).alias("summary"),
        F.transform("l", lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.array_distinct(F.flatten(F.transform("l", lambda x: x["tags"]))).alias("tags"),
        "pages",
    )


def collection_stats(documents: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Rows (collection, n_documents, n_chunks, n_images): each table is counted before it's joined."""
    d = documents.groupBy("collection").agg(F.count("*").alias("n_documents"))
    c = chunks.groupBy("collection").agg(F.count("*").alias("n_chunks"))
    i = images.groupBy("collection").agg(F.count("*").alias("n_images"))
    joined = d.join(c, "collection", "left").join(i, "collection", "left")
    return joined.select("collection", "n_documents", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_images", F.lit(0)).alias("n_images"))


def list_documents(history: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Successful history rows with their numbers of chunks and images; two joins for all documents."""
    c = chunks.groupBy("file_hash").agg(F.count("*").alias("n_chunks"))
    i = images.groupBy("file_hash").agg(F.count("*").alias("n_images"))
    joined = history.where("status = 'success'").join(c, "file_hash", "left").join(i, "file_hash", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_chunks", "n_images")})


def document_detail(history: DataFrame, chunks: DataFrame, file_hash: Column) -> DataFrame:
    """History rows that ``file_hash`` selects, with their chunk ids in order."""
    ids = chunks.groupBy("file_hash").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("c"))
    joined = history.where(file_hash).join(ids, "file_hash", "left")
    return joined.withColumn("chunk_ids", F.coalesce(F.transform("c", lambda x: x["chunk_id"]), F.array().cast("array<string>"))).drop("c")


def pending(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files (file_hash, collection, ...) that no success of the history covers."""
    return files.join(history.where("status = 'success'").select("file_hash", "collection"), ["file_hash", "collection"], "left_anti")


def merge_history(history: DataFrame, changes: DataFrame) -> DataFrame:
    """History with changes merged by (file_hash, collection): the newest wins, the first processed_at stays."""
    both = history.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    by = Window.partitionBy("file_hash", F.coalesce("collection", F.lit("")))
    newest = F.row_number().over(by.orderBy(F.desc("__new"), F.desc("updated_at")))
    first = F.first("processed_at", ignorenulls=True).over(by.orderBy("__new", "updated_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumns({"__r": newest, "processed_at": first}).where("__r = 1").drop("__r", "__new")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, new ones in the place of old ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows without those that the condition holds for; unknown counts as not."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def index_gap(indexed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows (key, state): ``stale`` if only indexed, ``missing`` if only expected."""
    stale = indexed.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("state", F.lit("stale"))
    missing = expected.select(key).distinct().join(indexed.select(key), key, "left_anti").withColumn("state", F.lit("missing"))
    return stale.unionByName(missing)


def sanitised(metadata: DataFrame, lists: list[str], nested: list[str]) -> DataFrame:
    """Metadata columns as a store takes them: lists as comma strings, nested ones as JSON."""
    return metadata.withColumns({c: F.array_join(c, ",") for c in lists} | {c: F.to_json(c) for c in nested})


def complete(indexed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row (complete, n_stale, n_missing): an index is complete if it holds just what is expected."""
    gap = index_gap(indexed, expected, key)
    return gap.agg(F.count_if(F.col("state") == "stale").alias("n_stale"), F.count_if(F.col("state") == "missing").alias("n_missing")).select(((F.col("n_stale") == 0) & (F.col("n_missing") == 0)).alias("complete"), "n_stale", "n_missing")


def store_counts(store: DataFrame) -> DataFrame:
    """Rows (collection, n)."""
    return store.groupBy("collection").agg(F.count("*").alias("n"))


def ordered_history(history: DataFrame) -> DataFrame:
    """History in the order of processing."""
    return history.orderBy("processed_at", "file_hash")


def marked(history: DataFrame, files: DataFrame, status: str, now: str) -> DataFrame:
    """History after files (file_hash, file_path, collection, error_msg) came out with a status; the time of their first processing stays."""
    rows = files.select("file_hash", "file_path", F.lit(status).alias("status"), F.coalesce("collection", F.lit("")).alias("collection"), *([F.col("error_msg")] if "error_msg" in files.columns else [F.lit(None).cast("string").alias("error_msg")]), F.lit(now).alias("processed_at"), F.lit(now).alias("updated_at"))
    return merge_history(history.withColumn("collection", F.coalesce("collection", F.lit(""))), rows.select(history.columns))


def removed(history: DataFrame, files: DataFrame) -> DataFrame:
    """History without some files (file_hash, collection)."""
    return history.join(files.select("file_hash", F.coalesce("collection", F.lit("")).alias("__c")), (history["file_hash"] == files["file_hash"]) & (F.coalesce(history["collection"], F.lit("")) == F.col("__c")), "left_anti")
