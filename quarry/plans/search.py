"""Search end to end: a DataFrame of query strings in, ranked results out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import plugins
from quarry.functions import query as q
from quarry.operators import fusion, index
from quarry.operators.dense import dense_topk
from quarry.operators.rerank import rerank
from quarry.operators.rerank import threshold as rerank_threshold
from quarry.operators.response import responses
from quarry.operators.sparse import bm25_topk


def parsed(queries: DataFrame, least: int = 2, also: Sequence[Column] = ()) -> DataFrame:
    """Queries (query_id, query) with keywords of ``least`` characters, as the index holds them, filters (map) and tags."""
    rest = q.remainder(F.col("query"))
    return queries.select("query_id", "query", *also, q.keywords(rest, least).alias("keywords"), q.filters(F.col("query")).alias("filters"), q.tags(F.col("query")).alias("tags"))


def answered(
    queries: DataFrame,
    corpus: DataFrame,
    vectors: DataFrame | None = None,
    embedder: str | None = "hashing",
    index_path: str | None = None,
    reranker: str = "none",
    explicit: Column | None = None,
    top_k: int | None = None,
    path_k: int = 20,
    weights: Sequence[float] = (0.5, 0.5),
    threshold: float | None = None,
) -> DataFrame:
    """Search as the query tool does it: responses (see :func:`quarry.operators.response.responses`) for all queries (query_id, query).

    Queries are parsed; explicit filters (a map column of ``queries``) override
    inline ones.  Keywords go to the stored index at ``index_path``, else to the
    corpus; queries are embedded by the named embedder and meet ``vectors``
    (doc_id, embedding) where there are any.  Twice as many results as asked
    for are fetched if a reranker follows.  A blank query has an error instead
    of results.
    """
    k = q.clamped(top_k)
    asked = queries.withColumn("error", F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "query cannot be empty"))
    plan = parsed(asked.where("error IS NULL"), also=[explicit.alias("explicit")] if explicit is not None else [])
    if explicit is not None:
        plan = plan.withColumn("filters", q.merged(F.col("filters"), F.coalesce("explicit", F.create_map().cast("map<string,string>"))))
    fetched = q.widened(k, reranker != "none", k)
    found = retrieved(plan, corpus, vectors, embedder, index_path, fetched, path_k, weights)
    texts = corpus.select("doc_id", "text", F.create_map(F.lit("source_path"), F.col("source_path"), F.lit("doc_type"), F.col("doc_type"), F.lit("collection"), F.col("collection"), F.lit("doc_id"), F.col("doc_id").cast("string")).alias("metadata"))
    results = found.join(texts, "doc_id").join(plan.select("query_id", F.col("query").alias("__query")), "query_id")
    if reranker != "none":
        scorer = plugins.rerankers.create(reranker)(F.col("__query"), F.col("text"))
        results = rerank(results, scorer, k)
        if threshold is not None:
            results = rerank_threshold(results, threshold)
        kept = F.map_from_arrays(F.array(F.lit("original_score"), F.lit("rerank_score")), F.array(F.col("original_score").cast("string"), F.col("rerank_score").cast("string")))
        results = results.withColumn("metadata", F.map_concat("metadata", F.map_filter(kept, lambda _, v: v.isNotNull())))
    results = results.where(F.col("rank") <= k)
    return responses(results.select("query_id", "rank", F.col("doc_id").cast("string").alias("chunk_id"), "score", "text", "metadata"), asked.select("query_id", "query", "error"))


def retrieved(plan: DataFrame, corpus: DataFrame, vectors: DataFrame | None, embedder: str | None, index_path: str | None, k: int, path_k: int, weights: Sequence[float]) -> DataFrame:
    """Rows (query_id, doc_id, rank, score) for parsed queries, filtered after fusion and ranked anew."""
    terms = plan.select("query_id", F.transform("keywords", F.lower).alias("terms"))
    sparse = index.search(terms, index_path, path_k) if index_path else bm25_topk(terms, corpus, path_k)
    if vectors is not None and embedder:
        embed = plugins.embedders.create(embedder)()
        asked = plan.select("query_id", embed(q.remainder(F.col("query"))).alias("vector"))
        found = fusion.hybrid(dense_topk(asked, vectors, path_k, key="doc_id"), sparse, path_k, weights)
    else:
        found = sparse
    kept = filtered(found, plan, corpus)
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 10, path_k: int = 20, weights: Sequence[float] = (0.5, 0.5)) -> DataFrame:
    """Rows (query_id, doc_id, rank, score) for all queries in one plan.

    Keywords go to BM25, query vectors (query_id, vector) to cosine search over
    vectors (doc_id, embedding); both lists are fused.  Filters apply after
    the fused list is cut to ``k``, so a filtered query may get fewer.
    """
    plan = parsed(queries)
    terms = plan.select("query_id", F.transform("keywords", F.lower).alias("terms"))
    sparse = bm25_topk(terms, corpus, path_k)
    if vectors is not None and query_vectors is not None:
        found = fusion.hybrid(dense_topk(query_vectors, vectors, path_k, key="doc_id"), sparse, k, weights)
    else:
        found = sparse.where(F.col("rank") <= k)
    return filtered(found, plan, corpus)


def filtered(found: DataFrame, plan: DataFrame, corpus: DataFrame) -> DataFrame:
    """The results that pass their query's filters."""
    asked = plan.select("query_id", "filters", F.col("tags").alias("wanted_tags"))
    joined = found.join(asked, "query_id").join(corpus.drop("text"), "doc_id")
    wanted = {n: F.try_element_at("filters", F.lit(n)) for n in ("collection", "doc_type", "source_path")}
    own = F.array().cast("array<string>")
    if "tags" in corpus.columns:
        own = F.col("tags")
        wanted["tags"] = F.when(F.size("wanted_tags") > 0, F.col("wanted_tags"))
    test = fusion.matches(F.col("collection"), F.col("doc_type"), own, F.col("source_path"), wanted)
    return joined.where(test).select("query_id", "doc_id", "rank", "score")
