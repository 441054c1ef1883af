"""Writers of the engine's tables and files; Spark's commit protocol makes each write whole or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_traces(traces: DataFrame, path: str) -> None:
    """Appends traces as JSON lines; an unfinished trace is finished now."""
    done = F.coalesce("finished_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    traces.withColumn("finished_at", done).write.mode("append").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_index(postings: DataFrame, terms: DataFrame, stats: DataFrame, path: str) -> None:
    """The three tables of an inverted index; postings lie clustered by term within a collection's folder."""
    by = [c for c in ("collection",) if c in postings.columns]
    postings.repartition(*map(F.col, (*by, "term"))).sortWithinPartitions(*by, "term").write.mode("overwrite").partitionBy(*by).parquet(f"{path}/postings")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def save_comparison(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)  # a row for each experiment


#: Version of the parsed-document cache; entries of another one don't count.
CACHE = 1


def cache_put(documents: DataFrame, path: str, config_hash: str) -> None:
    """Adds parsed documents (file_hash, ...) to the cache of a loader's configuration; equal files replace nothing they already have."""
    documents.withColumn("version", F.lit(CACHE)).write.mode("append").parquet(f"{path}/config_hash={config_hash}")


def cache_get(spark: SparkSession, files: DataFrame, path: str, config_hash: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`cached`, over a cache on disk: entries of this version only, one for each file."""
    cache = spark.read.option("basePath", path).parquet(f"{path}/config_hash={config_hash}").where(F.col("version") == CACHE).drop("version")
    return cached(files, cache.dropDuplicates(["file_hash"]), config_hash)


def open_vectors(spark: SparkSession, path: str, dims: int, collection: str = "default") -> DataFrame:
    """The vector table at a path (vec_id, embedding, collection), made empty if there is none; other dimensions than it holds are an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dims={dims}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    parent = place.getParent()
    others = [x.getPath().getName() for x in fs.listStatus(parent)] if fs.exists(parent) else []
    if any(x.startswith("dims=") and x != place.getName() for x in others):
        raise ValueError(f"the vectors at {path} have {', '.join(x for x in others if x.startswith('dims='))}")
    schema = "vec_id long, embedding array<float>, collection string"
    if not fs.exists(place):
        spark.createDataFrame([], schema).write.parquet(place.toString())
    return spark.read.schema(schema).parquet(place.toString()).where(F.col("collection") == collection)


def cached(documents: DataFrame, cache: DataFrame, config_hash: str) -> tuple[DataFrame, DataFrame]:
    """Parsed documents the cache holds for (file_hash, config_hash), with their present path, and the files it lacks."""
    own = cache.where(F.col("config_hash") == config_hash).drop("source_path", "config_hash")
    hits = documents.select("file_hash", "source_path").join(own, "file_hash")
    return hits, documents.join(own.select("file_hash"), "file_hash", "left_anti")
