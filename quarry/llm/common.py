"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own where it names one.

    Only a local session may do without, as its driver and executors are one
    process; a cluster that names no shared folder is an error.
    """
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


#: Rows of a checkpoint's file, where their number is known beforehand.
ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, without its lineage.

    ``rows``, about how many there are, keeps small tables in few files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(min(partitions(df.sparkSession), rows // ROWS + 1))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold some MB of text instead of tens.

    Where the session leaves the number of rows at its default, it's set lower:
    texts of some kB would otherwise make batches of tens of MB, of which JVM
    and Python hold several each.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, "1500")
    return df


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: runs without ASCII blanks, A-Z in lower case.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only and split at exactly
    the characters of :data:`BLANKS`.
    """
    return (text or b"").lower().split()


def utf8(column: pa.Array) -> list[bytes | None]:
    """The strings of an Arrow column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def crc_mod(key: Column | str, divisor: int) -> Column:
    """crc32 of a key written in decimal, modulo ``divisor`` (a null key: of the empty text)."""
    text = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row.

    A lambda variable holds the value, so an expensive expression that the
    body uses within another lambda isn't evaluated anew for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def star_components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b), as (node, root).

    Alternates large-star and small-star: each round links a node's neighbours
    to the smallest of them.  Only minima meet at a node (with partial
    aggregation), so a hub's neighbours are never gathered in one task; the
    joins are plain equi-joins which adaptive execution can split.  ``root`` is
    the smallest node of the component.  Links with a null end and loops count
    for nothing.  Every round is cut with a checkpoint.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen, links = None, None
    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.select(b.alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = cut(small.where(a != b).distinct(), links)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen, links = mark, mark[0]  # rounds don't add links


def batches(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (x for x in batch if x.num_rows)


def runs_of(rows: Iterator[pa.RecordBatch], most: int = 8192, size: int = 32 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of about so many rows or bytes, so that what is counted together doesn't depend on the batches' size."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches(rows):
        held.append(batch)
        n, held_bytes = n + batch.num_rows, held_bytes + batch.nbytes
        if n >= most or held_bytes >= size:
            yield held
            held, n, held_bytes = [], 0, 0
    if held:
        yield held


__all__ = ["BLANKS", "batches", "crc_mod", "cut", "documents", "ensure_checkpoint_dir", "let", "partitions", "runs_of", "small_batches", "star_components", "utf8", "words"]
