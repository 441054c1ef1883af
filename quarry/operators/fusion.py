"""Fusion of ranked lists and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.sparse import ranked

#: Smoothing of reciprocal ranks.
K = 60


def reciprocal(rank: Column, k: int = K) -> Column:
    if not isinstance(k, int) or k <= 0:
        raise ValueError("k is a whole number above 0")
    return 1.0 / (k + rank)


def listed(lists: Sequence[DataFrame], query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The lists (query, key, rank, score) one under the other, with their number ``list`` from 0."""
    each = [x.select(query, key, "rank", "score").withColumn("list", F.lit(i)) for i, x in enumerate(lists)]
    return reduce(DataFrame.unionByName, each)


def rrf(lists: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None, smoothing: int = K, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Rows (query, key, rank, score) by reciprocal rank fusion, weighted if asked for; ties by key."""
    if weights is not None and (len(weights) != len(lists) or any(w < 0 for w in weights) or not any(weights)):
        raise ValueError("one weight of 0 or more for each list, not all 0")
    factor = F.get(F.array(*map(F.lit, map(float, weights))), F.col("list")) if weights is not None else F.lit(1.0)
    scored = listed(lists, query, key).groupBy(query, key).agg(F.sum(factor * reciprocal(F.col("rank"), smoothing)).alias("score"))
    return ranked(scored, k, query, key)


def interleave(lists: Sequence[DataFrame], k: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Rows (query, key, rank, score): the lists taken in turns, each key at its first turn with the score it has there."""
    turn = (len(lists) * F.col("rank") + F.col("list")).alias("turn")
    first = listed(lists, query, key).groupBy(query, key).agg(F.min(F.struct(turn, F.col("score"))).alias("t"))
    order = Window.partitionBy(query).orderBy("t.turn")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, "rank", F.col("t.score").alias("score"))


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, weights: Sequence[float] = (0.5, 0.5), query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Weighted fusion of two lists; where a query has only one, that list passes with its own scores.

    Rows (query, key, rank, score, mode), mode ``fused``, ``dense`` or ``sparse``.
    """
    both = listed((dense, sparse), query, key)
    factor = F.get(F.array(*map(F.lit, map(float, weights))), F.col("list"))
    there = Window.partitionBy(query)
    seen = both.withColumns({"__d": F.max(F.col("list") == 0).over(there), "__s": F.max(F.col("list") == 1).over(there)})
    mode = F.when(F.col("__d") & F.col("__s"), "fused").when(F.col("__d"), "dense").otherwise("sparse")
    part = F.when(mode == "fused", factor * reciprocal(F.col("rank"))).otherwise(F.col("score"))
    scored = seen.groupBy(query, key, mode.alias("mode")).agg(F.sum(part).alias("score"))
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, "rank", "score", "mode")


def matches(collection: Column, doc_type: Column, tags: Column, source_path: Column, wanted: dict[str, Column]) -> Column:
    """Conjunction of metadata filters: exact, but tags need one in common and the path may be a part; a null filter admits all."""
    tests = {
        "collection": lambda w: collection == w,
        "doc_type": lambda w: doc_type == w,
        "tags": lambda w: F.arrays_overlap(tags, w),
        "source_path": lambda w: source_path.contains(w),
    }
    return reduce(lambda a, b: a & b, (w.isNull() | F.coalesce(tests[n](w), F.lit(False)) for n, w in wanted.items()), F.lit(True))
