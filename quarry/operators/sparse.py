"""The inverted index as tables, and BM25 over it.

Scores follow ``idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))``
with ``idf = ln((N - df + 0.5) / (df + 0.5))``, which is negative for terms of
more than half the documents; such hits stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import index_terms
from quarry.operators.frames import dealt, small

K1, B = 1.5, 0.75
#: Stands for a document itself among its terms; no token is empty.
NO_TERM = ""


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, terms, doc_length); documents without terms stay, with length 0."""
    return docs.select(key, index_terms(F.col(text)).alias("terms")).withColumn("doc_length", F.size("terms").cast("long"))


def spread(tokens: DataFrame, key: str) -> DataFrame:
    """Rows (key, doc_length, term), one for each token and one more without (``NO_TERM``) for each document; a document's rows lie in one partition.

    Documents travel as one string each, before their tokens become rows, so
    what is counted by document or ranked in it moves no more.
    """
    joined = dealt(tokens.select(key, "doc_length", F.array_join("terms", " ").alias("__words")), key)  # no token has a blank
    return joined.select(key, "doc_length", F.explode(F.split(F.concat("__words", F.lit(" ")), " ", -1)).alias("term"))


def postings(tokens: DataFrame, key: str = "doc_id", only: DataFrame | None = None) -> DataFrame:
    """Rows (key, term, tf, doc_length); ``only`` (term) restricts the terms before they're counted."""
    each = spread(tokens, key).where(F.col("term") != NO_TERM)
    if only is not None:
        each = each.join(only, "term", "left_semi")
    return each.groupBy(key, "term", "doc_length").agg(F.count("*").alias("tf")).select(key, "term", "tf", "doc_length")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row (num_docs, avg_doc_length, total_tokens)."""
    return tokens.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("total_tokens"))


def idf(num_docs: Column, df: Column) -> Column:
    return F.ln((num_docs - df + 0.5) / (df + 0.5))


def term_table(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows (term, df, idf, total_tf)."""
    terms = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
    return terms.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("num_docs"), F.col("df")).alias("idf"), "total_tf")  # one row


def index_terms_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (term, df, idf, total_tf) of texts that are tokenised once."""
    _, terms, stats = indexed(docs, key, text)
    return terms.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("num_docs"), F.col("df")).alias("idf"), "total_tf")  # one row


def term_score(tf: Column, length: Column, average: Column, weight: Column) -> Column:
    mean = F.when(average == 0, 1.0).otherwise(average)
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """Rows (key, term, doc_length, tf) of texts, and one more for each document, without a term and with frequency 0.

    ``only`` (term) restricts the terms before they are counted; it is
    broadcast if the optimizer knows that it is small.
    """
    each = spread(tokenised(docs, key, text), key)
    if only is not None:
        asked = only.select("term").unionByName(only.sparkSession.range(1).select(F.lit(NO_TERM).alias("term"))).distinct()
        each = each.join(F.broadcast(asked) if small(only) else asked, "term", "left_semi")
    return each.groupBy(key, "term", "doc_length").agg(F.count_if(F.col("term") != NO_TERM).alias("tf"))


def statistics(lengths: DataFrame) -> DataFrame:
    """One row (num_docs, avg_doc_length, total_tokens) of sums (df, length) of documents."""
    return lengths.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("num_docs"), F.coalesce(F.sum("length") / F.sum("df"), F.lit(0.0)).alias("avg_doc_length"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_tokens"))


def indexed(docs: DataFrame, key: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (key, term, doc_length, tf), terms (term, df, total_tf) and statistics of texts that are tokenised once.

    The statistics come from the rows without a term; postings, terms and
    statistics share one shuffle.
    """
    every = counted(docs, key, text, only)
    posts = every.where("tf > 0")  # not a condition on the term, which would part the two readers' plans
    by_term = every.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.sum("doc_length").alias("length"), F.min("tf").alias("low"))
    return posts, by_term.where("low > 0").select("term", "df", "total_tf"), statistics(by_term.where("low = 0"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (query, key, rank, score): the best documents of all queries (query, terms array) at once.

    A term given twice counts twice.  Only the queries' terms are counted.  If
    the optimizer knows that the queries are few, they and their terms' numbers
    are broadcast, so postings stay where their documents are and each
    partition ranks its own; ties go to the smaller key.  For repeated searches
    of a corpus see :mod:`quarry.operators.index`.
    """
    wanted = queries.select(query, F.explode("terms").alias("term"))
    few = F.broadcast if small(queries) else lambda df: df
    posts, terms, stats = indexed(docs, key, text, wanted.select("term").distinct())
    weighted = posts.join(few(terms), "term").crossJoin(F.broadcast(stats))  # one row
    part = term_score(F.col("tf"), F.col("doc_length"), F.col("avg_doc_length"), idf(F.col("num_docs"), F.col("df")))
    scored = weighted.select(key, "term", part.alias("part"))
    total = few(wanted).join(scored, "term").groupBy(query, key).agg(F.sum("part").alias("score"))
    return ranked(total, k, query, key)


def ranked(scored: DataFrame, k: int, query: str = "query_id", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The best ``k`` rows of each query with their rank; ties, to nine decimals, by key."""
    order = Window.partitionBy(query).orderBy(F.round(score, 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, "rank", score)


def top_terms(posts: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Rows (key, rank, term, tf): each document's most frequent terms, ties by term."""
    order = Window.partitionBy(key).orderBy(F.desc("tf"), "term")
    return posts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "term", "tf")


def add_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokenised documents with some replaced or added: a document's old row goes as a whole."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def remove_documents(old: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokenised documents without some; statistics derived from the rest are those of a fresh build."""
    return old.join(gone.select(key), key, "left_anti")
