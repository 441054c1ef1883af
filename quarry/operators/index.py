"""The stored inverted index: built once, read by the terms that queries ask for.

Three tables lie under one path.  ``postings`` (term, key, tf, doc_length)
is partitioned into buckets by a hash of the term and sorted by term within its
files, so a search opens the buckets of its terms and, in their files, the row
groups whose range holds them; it counts their documents as it reads them.
Bucket -1 has a row without a term for each document.  ``stats`` has the one
row of the corpus, and ``layout`` says how many buckets there are and for which
collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import sparse
from quarry.operators.frames import dealt, small

#: Query terms up to so many are literals of the scan; more are joined.
LITERALS = 10_000
#: The bucket of the rows that stand for documents themselves.
DOCUMENTS = -1


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def save(docs: DataFrame, path: str, collection: str = "default", buckets: int = 64, key: str = "doc_id", text: str = "text") -> None:
    """Builds and writes an index; the commit protocol replaces an older one whole, table by table, statistics last.

    Texts are read once; large buckets are parted over several tasks and files.
    """
    spark = docs.sparkSession
    every = sparse.counted(docs, key, text)
    placed = every.select("term", key, "tf", "doc_length", F.when(F.col("tf") > 0, bucket(F.col("term"), buckets)).otherwise(DOCUMENTS).alias("bucket"))
    placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths = spark.read.schema(placed.schema).parquet(f"{path}/postings").where(F.col("bucket") == DOCUMENTS).agg(F.count("*").alias("df"), F.sum("doc_length").alias("length"))
    sparse.statistics(lengths).write.mode("overwrite").parquet(f"{path}/stats")
    spark.createDataFrame([(collection, buckets, key)], "collection string, buckets int, key string").coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load(spark: SparkSession, path: str, collection: str | None = None) -> tuple[DataFrame, DataFrame, int, str]:
    """Postings, statistics, number of buckets and key of an index; one that lacks a table, a column or the collection is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no index at {path}")
    layout = spark.read.schema("collection string, buckets int, key string").json(f"{path}/layout").first()
    if collection is not None and layout["collection"] != collection:
        raise ValueError(f"the index at {path} is of collection {layout['collection']!r}")
    posts, stats = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")
    lacking = {"term", "tf", "doc_length", "bucket", layout["key"]} - set(posts.columns) | {"num_docs", "avg_doc_length"} - set(stats.columns)
    if lacking or not layout["buckets"] or layout["buckets"] < 1:
        raise ValueError(f"the index at {path} lacks {', '.join(sorted(lacking)) or 'buckets'}")
    return posts, stats, layout["buckets"], layout["key"]


def wanted_postings(posts: DataFrame, terms: DataFrame, buckets: int) -> DataFrame:
    """The postings of some terms (term); the scan opens their buckets only."""
    asked = terms.where("term IS NOT NULL").distinct()
    some = [x["term"] for x in asked.limit(LITERALS + 1).collect()]
    if len(some) <= LITERALS:  # a batch of queries: literals reach the scan
        places = [x[0] for x in terms.sparkSession.createDataFrame([(t,) for t in some], "term string").select(bucket(F.col("term"), buckets)).distinct().collect()] if some else []
        return posts.where(F.col("bucket").isin(places) & F.col("term").isin(some))
    asked = asked.withColumn("bucket", bucket(F.col("term"), buckets))
    return posts.join(F.broadcast(asked) if small(asked) else asked, ["bucket", "term"], "left_semi")


def search(queries: DataFrame, path: str, k: int, query: str = "query_id", collection: str | None = None) -> DataFrame:
    """Rows (query, key, rank, score) of BM25 over a stored index for queries (query, terms array); without an index there are none.

    Scores equal those of :func:`quarry.operators.sparse.bm25_topk` over the
    texts that the index was built from.
    """
    spark = queries.sparkSession
    if not exists(spark, path):
        return queries.select(query, F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("score")).where(F.lit(False))
    posts, stats, buckets, key = load(spark, path, collection)
    wanted = queries.select(query, F.explode("terms").alias("term"))
    few = F.broadcast if small(queries) else lambda df: df
    found = wanted_postings(posts, wanted.select("term"), buckets).select(key, "term", "tf", "doc_length")
    dfs = found.groupBy("term").agg(F.count("*").alias("df"))  # all of a term's postings are read
    weighted = dealt(found, key).join(few(dfs), "term").crossJoin(F.broadcast(stats))  # one row
    part = sparse.term_score(F.col("tf"), F.col("doc_length"), F.col("avg_doc_length"), sparse.idf(F.col("num_docs"), F.col("df")))
    scored = weighted.select(key, "term", part.alias("part"))
    return sparse.ranked(few(wanted).join(scored, "term").groupBy(query, key).agg(F.sum("part").alias("score")), k, query, key)
