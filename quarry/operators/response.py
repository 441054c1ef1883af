"""Responses: citations, payloads and rendered contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import fixed, half_even
from quarry.operators.tools import first_present

#: Metadata that citations carry.
CITED = ("title", "section", "chunk_index", "doc_type")


def citations(results: DataFrame) -> DataFrame:
    """Rows (query_id, index, chunk_id, source, score, page, cited) of results with map ``metadata``."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    page = F.coalesce(F.nullif(meta("page"), F.lit("")), meta("page_num")).try_cast("int")
    cited = F.map_filter("metadata", lambda k, _: k.isin(*CITED))
    return results.select("query_id", F.col("rank").alias("index"), "chunk_id", F.coalesce(meta("source_path"), F.lit("unknown")).alias("source"), half_even(F.col("score"), 4).alias("score"), page.alias("page"), cited.alias("cited"))


def payload(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each query (query_id, query): result_count, is_empty and the results as an array in rank order."""
    one = F.struct("rank", "chunk_id", half_even(F.col("score"), 6).alias("score"), F.coalesce("text", F.lit("")).alias("text"), F.map_filter("metadata", lambda k, _: k != "text").alias("metadata"))
    listed = results.groupBy("query_id").agg(F.count("*").alias("result_count"), F.collect_list(one).alias("results"))
    joined = queries.join(listed, "query_id", "left")
    ordered = F.array_sort("results", lambda a, b: a["rank"] - b["rank"])
    return joined.select("query_id", "query", F.coalesce("result_count", F.lit(0)).alias("result_count"), F.col("result_count").isNull().alias("is_empty"), F.coalesce(ordered, F.array()).alias("results"))


def contexts(results: DataFrame, limit: int = 5) -> DataFrame:
    """Rows (query_id, context): the first texts, numbered, one under the other."""
    listed = results.where(F.col("rank") <= limit).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return listed.select("query_id", F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), F.coalesce(r["text"], F.lit("")))), "\n\n").alias("context"))


def fallback_answer(results: DataFrame, limit: int = 5) -> DataFrame:
    """Rows (query_id, answer): the first texts joined by blanks."""
    listed = results.where(F.col("rank") <= limit).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return listed.select("query_id", F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("answer"))


def cdata(text: Column) -> Column:
    """Text for XML, with an end mark inside it parted."""
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


#: Metadata that keeps scores of earlier steps, and their names in a payload.
SCORES = {"dense_score": "dense", "sparse_score": "sparse", "fusion_score": "fusion", "rrf_score": "rrf", "original_score": "original", "rerank_score": "rerank"}


def serialised(results: DataFrame) -> DataFrame:
    """Rows (query_id, rank, chunk_id, text, source map, scores map, metadata) of results with map ``metadata``."""
    meta = lambda *k: first_present(F.col("metadata"), *k)
    source = {"doc_id": meta("doc_id", "source_ref"), "path": meta("source_path", "source"), "page_start": meta("page_start", "page_num", "page"), "page_end": meta("page_end", "page_num", "page")}
    scores = {"final": F.col("score")} | {n: meta(k).try_cast("double") for k, n in SCORES.items()}
    there = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    return results.select(
        "query_id",
        "rank",
        "chunk_id",
        F.coalesce("text", F.lit("")).alias("text"),
        there(F.map_from_arrays(F.array(*map(F.lit, source)), F.array(*source.values()))).alias("source"),
        there(F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*(half_even(v, 6) for v in scores.values())))).alias("scores"),
        F.map_filter("metadata", lambda k, _: k != "text").alias("metadata"),
    )


def responses(results: DataFrame, queries: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row for each query (query_id, query, error where the search failed): result_count, is_empty, image_count, error and ``content`` as JSON.

    images (query_id, n_images) says how many images go with a query's results.
    """
    one = F.struct("rank", "chunk_id", "text", "source", "scores", "metadata")
    listed = serialised(results).groupBy("query_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["rank"] - b["rank"]).alias("results"))
    joined = queries.join(listed, "query_id", "left")
    joined = joined.join(images, "query_id", "left") if images is not None else joined.withColumn("n_images", F.lit(0).cast("long"))
    failed = F.col("error") if "error" in queries.columns else F.lit(None).cast("string")
    found = F.when(failed.isNull(), F.col("results"))
    count = F.coalesce(F.size(found), F.lit(0))
    pictures = F.when(count > 0, F.coalesce("n_images", F.lit(0))).otherwise(0)
    content = F.struct("query", count.alias("result_count"), F.coalesce(found, F.array().cast(listed.schema["results"].dataType)).alias("results"), (pictures > 0).alias("has_images"), pictures.alias("image_count"), (count == 0).alias("is_empty"), failed.alias("error"))
    return joined.select("query_id", "query", count.alias("result_count"), (count == 0).alias("is_empty"), pictures.alias("image_count"), failed.alias("error"), F.to_json(content).alias("content"))


def rendered(results: DataFrame, form: str = "xml") -> DataFrame:
    """Rows (query_id, content): each query's results as ``xml`` or ``markdown``; JSON is what :func:`responses` gives."""
    if form not in ("xml", "markdown"):
        raise ValueError("a response is xml, json or markdown")
    rank, source, page = F.col("rank").cast("string"), F.coalesce(F.try_element_at("source", F.lit("path")), F.lit("unknown")), F.try_element_at("source", F.lit("page_start"))
    score = fixed(half_even(F.try_element_at("scores", F.lit("final")), 4), 4)
    if form == "xml":
        one = F.concat(F.lit('<result rank="'), rank, F.lit('" chunk_id="'), attribute(F.col("chunk_id")), F.lit('" score="'), score, F.lit('" source="'), attribute(source), F.lit('"'), F.coalesce(F.concat(F.lit(' page="'), attribute(page), F.lit('"')), F.lit("")), F.lit(">"), cdata(F.col("text")), F.lit("</result>"))
    else:
        one = F.concat(F.lit("### ["), rank, F.lit("] "), single_line(source), F.coalesce(F.concat(F.lit(", page "), page), F.lit("")), F.lit(" ("), score, F.lit(")\n\n"), F.col("text"))
    listed = serialised(results).select("query_id", "rank", one.alias("one")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "one"))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["one"]), "\n" if form == "xml" else "\n\n")
    return listed.select("query_id", F.concat(F.lit("<results>\n"), body, F.lit("\n</results>")).alias("content") if form == "xml" else body.alias("content"))


def attribute(text: Column) -> Column:
    """Text for an XML attribute."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def single_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))
