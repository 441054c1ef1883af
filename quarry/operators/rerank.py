"""Reranking: scorers as columns, thresholds and the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import index_terms


def overlap_score(query: Column, text: Column) -> Column:
    """The offline scorer: the share of the query's distinct terms that the text has."""
    q, t = F.array_distinct(index_terms(query)), F.array_distinct(index_terms(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q)), F.lit(0.0))


def threshold(ranked: DataFrame, least: float, query: str = "query_id") -> DataFrame:
    """Rows scoring ``least`` or more; where a query has none, its first row."""
    best = F.max("score").over(Window.partitionBy(query))
    return ranked.withColumn("__b", best).where((F.col("score") >= least) | ((F.col("__b") < least) & (F.col("rank") == 1))).drop("__b")


def rerank(results: DataFrame, scorer: Column, k: int, failed: Column | None = None, query: str = "query_id") -> DataFrame:
    """Results (query, rank, score, ...) in the order of ``scorer``; one result or a failed query keeps its order.

    Adds original_score, rerank_score (null where not scored), reranked and
    rerank_fallback.  Ties keep their former order.
    """
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    n = F.count("*").over(Window.partitionBy(query))
    base = results.withColumns({"__n": n, "__bad": bad, "original_score": F.col("score"), "__old": F.col("rank")})
    base = base.withColumn("reranked", ~F.col("__bad") & (F.col("__n") > 1))
    base = base.withColumn("rerank_score", F.when(F.col("reranked"), scorer))
    order = Window.partitionBy(query).orderBy(F.round("rerank_score", 9).desc_nulls_last(), "__old")
    out = base.withColumns({"rank": F.row_number().over(order), "score": F.coalesce("rerank_score", "original_score"), "rerank_fallback": F.col("__bad") & (F.col("__n") > 1)})
    return out.where(F.col("rank") <= k).drop("__n", "__bad", "__old")
