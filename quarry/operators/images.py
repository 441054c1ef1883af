"""Images of documents: the register, references in results and their content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import image_refs
from quarry.operators import catalog

#: Types by suffix, and by the first bytes where the suffix says nothing.
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}
MAGIC = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "52494646": "image/webp", "424D": "image/bmp"}
#: The fields of an image in a chunk's metadata.
IMAGE = "array<struct<id:string,path:string,page:int,caption:string>>"


def register(index: DataFrame, new: DataFrame) -> DataFrame:
    """The register (image_id, file_path, collection, doc_hash, page_num, created_at) with new rows in the place of old ones; of new rows with one id the latest counts."""
    latest = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("created_at"), "file_path"))
    return catalog.upsert(index, new.withColumn("__r", latest).where("__r = 1").drop("__r"), "image_id")


def unregister(index: DataFrame, image_ids: DataFrame | None = None, collection: str | None = None, doc_hash: str | None = None) -> DataFrame:
    """The register without some images: by id, by collection, by document; given together, all must hold."""
    wanted = index
    if image_ids is not None:
        wanted = wanted.join(image_ids.select("image_id"), "image_id", "left_semi")
    for column, value in (("collection", collection), ("doc_hash", doc_hash)):
        if value is not None:
            wanted = wanted.where(F.col(column) == value)
    if image_ids is None and collection is None and doc_hash is None:
        raise ValueError("say which images")
    return index.join(wanted.select("image_id"), "image_id", "left_anti")


def listed(index: DataFrame, collection: str | None = None, doc_hash: str | None = None) -> DataFrame:
    """Images in the order they were made."""
    rows = index
    for column, value in (("collection", collection), ("doc_hash", doc_hash)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    return rows.orderBy("created_at", "image_id")


def stats(index: DataFrame) -> DataFrame:
    """Rows (collection, n_images, n_documents)."""
    return index.groupBy("collection").agg(F.count("*").alias("n_images"), F.countDistinct("doc_hash").alias("n_documents"))


def paths(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (image_id, file_path) of asked images; null where the register has none."""
    return asked.select("image_id").join(index.select("image_id", "file_path"), "image_id", "left")


def decoded(value: Column, kind: str) -> Column:
    """Structured metadata kept as text: JSON, or the literal that a Python program wrote; null if it's neither."""
    given = F.trim(value)
    python = reduce(lambda t, x: F.regexp_replace(t, f"(?<![\\w'\"]){x[0]}(?![\\w'\"])", x[1]), (("None", "null"), ("True", "true"), ("False", "false")), given)
    return F.coalesce(F.from_json(given, kind), F.from_json(F.regexp_replace(F.regexp_replace(python, "^\\(", "["), ",?\\)$", "]"), kind, {"allowSingleQuotes": "true"}))


def references(results: DataFrame, most: int = 5) -> DataFrame:
    """Rows (query_id, rank, position, image_id, path, page, caption) of the images that results name.

    The structured list in metadata counts, else the placeholders of the text;
    ``most`` of a result at most, as the feature asks.
    """
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    raw = meta("images")
    held = F.coalesce(decoded(raw, IMAGE), F.array(decoded(raw, IMAGE[6:-1])))
    structured = F.filter(F.slice(F.filter(held, lambda x: x.isNotNull()), 1, most), lambda x: x["id"].isNotNull())
    spoken = F.transform(F.slice(image_refs(F.coalesce("text", F.lit(""))), 1, most), lambda i: F.struct(i.alias("id"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("caption")))
    told = F.filter(decoded(meta("image_captions"), "array<struct<id:string,caption:string>>"), lambda x: x["id"].isNotNull() & x["caption"].isNotNull())
    by_list = F.map_from_entries(F.transform(told, lambda x: F.struct(x["id"], x["caption"])))
    captions = F.when(F.size(told) > 0, by_list).otherwise(decoded(meta("image_captions"), "map<string,string>"))
    rows = results.select("query_id", "rank", captions.alias("c"), F.posexplode(F.when(F.size(structured) > 0, structured).otherwise(spoken)).alias("position", "x"))
    return rows.select("query_id", "rank", "position", F.col("x.id").alias("image_id"), F.col("x.path").alias("path"), F.col("x.page").alias("page"), F.coalesce(F.try_element_at("c", F.col("x.id")), F.col("x.caption")).alias("caption"))


def mime_type(path: Column, content: Column) -> Column:
    """An image's type by suffix, else by its first bytes, else PNG."""
    suffix = F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))
    by_suffix = F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), suffix)
    head = F.hex(F.substring(content, 1, 8))
    by_bytes = reduce(lambda rest, kv: F.when(head.startswith(kv[0]), kv[1]).otherwise(rest), reversed(MAGIC.items()), F.lit("image/png"))
    return F.coalesce(by_suffix, by_bytes)


def assembled(refs: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """Image blocks (query_id, rank, position, image_id, mime_type, data base64, caption) of references.

    A reference's own path counts, else the register's; files (path, content)
    that are missing or empty give no block, and of a query's equal images the
    first stays.
    """
    known = index.select("image_id", F.col("file_path").alias("__registered"))
    placed = refs.join(known, "image_id", "left").withColumn("path", F.coalesce("path", "__registered")).drop("__registered")
    read = placed.join(files.select("path", "content"), "path").where(F.length("content") > 0)
    first = F.row_number().over(Window.partitionBy("query_id", F.sha2("content", 256)).orderBy("rank", "position"))
    kept = read.withColumn("__r", first).where("__r = 1")
    return kept.select("query_id", "rank", "position", "image_id", mime_type(F.col("path"), F.col("content")).alias("mime_type"), F.base64("content").alias("data"), "caption")


def counts(refs: DataFrame) -> DataFrame:
    """Rows (query_id, n_images) of references."""
    return refs.groupBy("query_id").agg(F.count("*").alias("n_images"))
