"""What the query tools answer: document summaries, document and collection lists as text, whole for all askers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tool_summary, tool_title
from quarry.operators.catalog import normalised_tags

#: Metadata that a summary doesn't repeat.
HIDDEN = ("source_ref", "chunk_index", "start_offset", "end_offset", "_placeholder", "text", "title", "summary", "tags", "source_path", "source")


def first_present(metadata: Column, *keys: str) -> Column:
    """The first of some keys that a metadata map has a value for."""
    return F.coalesce(*(F.try_element_at(metadata, F.lit(k)) for k in keys))


def summary_metadata(metadata: Column) -> Column:
    """Metadata for a summary: without fields it shows itself and internal ones."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*HIDDEN) & ~k.startswith("_"))


def collection_metadata(metadata: Column) -> Column:
    """A collection's metadata without internal fields and those of the vector store."""
    return F.map_filter(metadata, lambda k, _: ~k.startswith("_") & ~k.startswith("hnsw:"))


def summary_tags(metadata: Column) -> Column:
    """Tags of a metadata map, and the document type in upper case if it isn't among them."""
    tags = F.coalesce(normalised_tags(F.try_element_at(metadata, F.lit("tags"))), F.array().cast("array<string>"))
    kind = F.upper(F.nullif(F.try_element_at(metadata, F.lit("doc_type")), F.lit("")))
    return F.when(kind.isNull() | F.array_contains(tags, kind), tags).otherwise(F.array_append(tags, kind))


#: Ids are looked for in chunk ids by length and a hash of their first and last characters, so many hashes.
SHAPES = 64


def shape(part: Column) -> Column:
    """A whole number for a text's length and its first and last characters; equal texts have equal ones."""
    ends = F.concat(F.substring(part, 1, 1), F.substring(part, -1, 1))
    return F.length(part) * SHAPES + F.pmod(F.hash(ends), F.lit(SHAPES))


def held_ids(named: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``named`` (chunk_id, ...) with each of the distinct ``ids`` (doc_id) that its chunk_id holds.

    The parts of a chunk_id that are as long as some id, and begin and end like
    one, are joined with the ids by equality, so rows grow with the chunks and
    not with chunks times ids.
    """
    shapes = ids.agg(F.collect_set(shape(F.col("doc_id"))).alias("__shapes"), F.collect_set(F.length("doc_id")).alias("__lengths"))  # one row, of the ids' kinds
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.length("chunk_id") - n + 1), lambda i: F.substring(F.col("chunk_id"), i, n))
    parts = F.flatten(F.transform(F.filter("__lengths", lambda n: n <= F.length("chunk_id")), of_length))
    held = F.array_distinct(F.filter(parts, lambda p: F.array_contains("__shapes", shape(p))))
    each = named.where("chunk_id IS NOT NULL").crossJoin(F.broadcast(shapes)).withColumn("doc_id", F.explode(held)).drop("__shapes", "__lengths")
    return each.join(ids, "doc_id")


def document_chunks(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text, metadata map, chunk_index) of the asked doc_ids, with doc_id.

    Those whose ``source_ref`` names the document; for a document without any,
    those whose id holds its doc_id.
    """
    own = chunks.withColumn("doc_id", F.try_element_at("metadata", F.lit("source_ref")))
    by_ref = own.join(asked.select("doc_id").distinct(), "doc_id")
    rest = asked.where("doc_id IS NOT NULL").select("doc_id").distinct().join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    return by_ref.unionByName(held_ids(chunks, rest))


def document_summaries(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (doc_id, title, summary, tags, source_path, chunk_count, metadata) of the asked documents; one without chunks has no row.

    Title, tags and metadata are the first chunk's; the summary is the first
    that a chunk carries, else a preview of the first chunk.
    """
    found = document_chunks(asked, chunks)
    said = F.nullif(F.try_element_at("metadata", F.lit("summary")), F.lit(""))
    order = F.struct("chunk_index", "chunk_id")
    by = found.groupBy("doc_id").agg(F.min_by(F.struct("metadata", "text"), order).alias("x"), F.min_by(said, F.when(said.isNotNull(), order)).alias("said"), F.count("*").alias("chunk_count"))
    meta = F.col("x.metadata")
    path = first_present(meta, "source_path", "source")
    return by.select(
        "doc_id",
        tool_title(F.try_element_at(meta, F.lit("title")), F.col("x.text"), path).alias("title"),
        F.coalesce("said", tool_summary(F.col("x.text"))).alias("summary"),
        summary_tags(meta).alias("tags"),
        path.alias("source_path"),
        "chunk_count",
        summary_metadata(meta).alias("metadata"),
    )


def summary_text(title: Column, doc_id: Column, summary: Column, tags: Column, source: Column, chunks: Column) -> Column:
    """A summary as text."""
    lines = F.array(
        F.concat(F.lit("## "), title),
        F.concat(F.lit("**Document ID:** `"), doc_id, F.lit("`")),
        F.when(source.isNotNull(), F.concat(F.lit("**Source:** "), source)),
        F.when(F.size(tags) > 0, F.concat(F.lit("**Tags:** "), F.array_join(tags, ", "))),
        F.concat(F.lit("**Chunks:** "), chunks.cast("string")),
        F.concat(F.lit("\n### Summary\n"), summary),
    )
    return F.array_join(F.array_compact(lines), "\n")


def ordered_catalog(documents: DataFrame) -> DataFrame:
    """Documents by title regardless of case, then by doc_id."""
    return documents.orderBy(F.lower("title"), "doc_id")


def documents_text(documents: DataFrame) -> DataFrame:
    """Rows (collection, text): each collection's documents (collection, doc_id, title, source_path, doc_type, chunk_count, pages, summary) as a numbered list."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    body = F.array_compact(
        F.array(
            F.concat(F.lit("   - Document ID: `"), F.col("doc_id").cast("string"), F.lit("`")),
            F.when(some("source_path"), F.concat(F.lit("   - Source: `"), "source_path", F.lit("`"))),
            F.when(some("doc_type"), F.concat(F.lit("   - Type: "), F.upper("doc_type"))),
            F.concat(F.lit("   - Chunks: "), F.col("chunk_count").cast("string")),
            F.when(F.size("pages") > 0, F.concat(F.lit("   - Pages: "), F.array_join(F.col("pages").cast("array<string>"), ", "))),
            F.when(some("summary"), F.concat(F.lit("   - Summary: "), "summary")),
        )
    )
    one = F.struct(F.lower("title").alias("k"), "doc_id", "title", F.array_join(body, "\n").alias("body"), "chunk_count")
    by = documents.groupBy("collection").agg(F.array_sort(F.collect_list(one)).alias("d"), F.sum("chunk_count").alias("n"))  # a list that a person reads
    head = F.format_string("## Documents in `%s` (%d total, %d chunks)", "collection", F.size("d"), "n")
    each = F.transform("d", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". **"), x["title"], F.lit("**\n"), x["body"]))
    return by.select("collection", F.concat(head, F.lit("\n\n"), F.array_join(each, "\n\n")).alias("text"))


def collections_text(collections: DataFrame) -> DataFrame:
    """One row (text): all collections (name, n_documents, n_chunks, metadata map) by name as a numbered list."""
    many = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    shown = F.map_entries(collection_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    meta = F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    line = F.concat(F.lit("**"), "name", F.lit("**"), F.when(F.col("n_documents").isNotNull() & F.col("n_chunks").isNotNull(), F.concat(F.lit(" - "), many(F.col("n_documents"), "document"), F.lit(", "), many(F.col("n_chunks"), "chunk"))).otherwise(""), F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""))
    listed = collections.agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("c"))
    each = F.transform("c", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    head = F.format_string("## Available Collections (%d total)\n", F.size("c"))
    return listed.select(F.when(F.size("c") == 0, "No collections found in the knowledge base.").otherwise(F.concat(head, F.lit("\n"), F.array_join(each, "\n"))).alias("text"))


def rerank_prompt(template: str, query: Column, passages: Column) -> Column:
    """The prompt for a reranking model: passages is an array of (id, text)."""
    each = F.transform(passages, lambda p: F.concat(F.lit("Passage ID: "), p["id"], F.lit("\nText: "), F.coalesce(p["text"], F.lit("")), F.lit("\n")))
    return F.concat(F.lit(f"{template}\n\nQuery: "), query, F.lit("\n\nPassages:\n"), F.array_join(each, "\n"), F.lit("\n\nOutput your response as a JSON array of objects, one per passage."))


def enrichment_prompt(template: str, text: Column, limit: int = 2000) -> Column:
    """A template with its ``{chunk_text}`` (or ``{text}``) filled in, at most ``limit`` characters of it."""
    part = F.substring(text, 1, limit)
    return F.replace(F.replace(F.lit(template), F.lit("{chunk_text}"), part), F.lit("{text}"), part)


def preparation_summary(files: DataFrame, cases: DataFrame) -> DataFrame:
    """One row (pdf_count, case_count, first_case_id) of a benchmark's files (path) and cases (case_id)."""
    pdfs = files.agg(F.count_if(F.lower("path").endswith(".pdf")).alias("pdf_count"))
    return pdfs.crossJoin(cases.agg(F.count("*").alias("case_count"), F.min("case_id").alias("first_case_id")))  # one row each
