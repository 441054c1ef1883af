"""Readers of the engine's files; paths may be in any store that Spark reads."""

from __future__ import annotations

import hashlib
import io
import json
import random
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.text import loader_title
from quarry.operators.frames import numbered


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf",)) -> DataFrame:
    """Rows (path, length, modificationTime) of the files below ``path`` with one of the suffixes, each once and sorted.

    Contents aren't read: only the listing's columns are.
    """
    pattern = "*.{" + ",".join(s for x in suffixes for s in (x.lower(), x.upper())) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", "modificationTime").distinct().orderBy("path")


def file_hashes(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """Rows (path, file_hash): sha256 of each file's bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(path)
    return found.select("path", F.sha2("content", 256).alias("file_hash"))


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of a golden JSON file; a file without ``test_cases`` is an error."""
    raw = spark.read.option("multiLine", "true").schema(f"test_cases array<struct<{_fields(schemas.GOLDEN)}>>").json(path)
    cases = F.coalesce("test_cases", F.raise_error(F.lit("the file has no test_cases")).cast(raw.schema["test_cases"].dataType))
    return raw.select(F.inline(cases))


def _fields(ddl: str) -> str:
    return ", ".join(x.strip().replace(" ", ":", 1) for x in ddl.split(", "))


def benchmark_cases(rows: DataFrame) -> DataFrame:
    """Benchmark rows as cases: required fields checked, pages counted from 1, the row's document where an evidence names none.

    A row that lacks what it needs stops the job with its case's name.
    """

    def need(value: Column, what: str) -> Column:
        text = F.trim(value.cast("string"))
        return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.raise_error(F.concat(F.lit(f"{what} is required in row "), F.coalesce(F.col("case_id").cast("string"), F.lit("?")))).cast("string"))

    def one(e: Column) -> Column:
        page = F.when(e["page_num"] >= 0, e["page_num"] + 1).otherwise(F.raise_error(F.lit("a page is a whole number from 0")).cast("int"))
        return F.struct(need(F.coalesce(F.nullif(F.trim(e["doc_name"]), F.lit("")), F.col("doc_name")), "a document").alias("document_name"), page.alias("page_number"), need(e["text"], "an evidence text").alias("text"))

    kept = F.map_from_arrays(F.array(*map(F.lit, ("doc_name", "question_type", "reasoning", "company", "justification"))), F.array("doc_name", "question_type", "question_reasoning", "company", "justification"))
    return rows.select(
        need(F.col("case_id"), "an id").alias("case_id"),
        need(F.col("question"), "a question").alias("query"),
        need(F.col("answer"), "an answer").alias("reference_answer"),
        F.transform(F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(F.raise_error(F.lit("evidence can't be empty")).cast(rows.schema["evidence"].dataType)), one).alias("evidences"),
        F.map_filter(kept, lambda _, v: v.isNotNull()).alias("metadata"),
    )


def benchmark_file(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file; blank lines don't count, a broken line stops the job with its place, and a file without cases is an error."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    kind = spark.read.schema(schemas.BENCHMARK_ROW).json(path).schema
    row = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    checked = F.when(row["case_id"].isNotNull(), row).otherwise(F.raise_error(F.concat(F.lit("no benchmark row: "), F.substring("value", 1, 80), F.lit(" in "), "file")).cast(kind))
    if lines.isEmpty():
        raise ValueError(f"no cases in {path}")
    return benchmark_cases(lines.select(checked.alias("x")).select("x.*"))


def seeded_sample(cases: DataFrame, n: int, seed: int, key: str = "case_id") -> DataFrame:
    """``n`` cases drawn by Python's generator over the cases in the order of their keys, as a semi join.

    Only the drawn places, as many as are asked for, pass through the driver.
    """
    placed = numbered(cases.select(key).distinct(), key)
    whole = placed.count()
    drawn = random.Random(seed).sample(range(whole), min(n, whole))
    chosen = cases.sparkSession.createDataFrame([(x,) for x in drawn], "position long")
    keys = placed.join(F.broadcast(chosen) if n < 1_000_000 else chosen, "position", "left_semi").select(key)
    return cases.join(keys, key, "left_semi")


def present(spark: SparkSession, path: str) -> str:
    """The path, if a file lies there; a folder or nothing is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(place).isFile():
        raise IsADirectoryError(path)
    return path


def load_documents(files: DataFrame, parsers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Documents of files (path, content): doc_id, doc_hash, doc_type, source_path, text, title and error.

    ``parsers`` turn the content of a suffix into text; plain text, Markdown
    and HTML are plain decoding.  A file of another suffix or without text has
    an error instead of a text.
    """
    suffix = F.lower(F.regexp_extract("path", "\\.([^./\\\\]+)$", 1))
    plain = F.decode("content", "UTF-8")
    body = reduce(lambda rest, s: F.when(suffix == s, parsers[s](F.col("content"))).otherwise(rest), parsers, F.when(suffix.isin("txt", "md", "html"), plain))
    rows = files.select(F.sha2("content", 256).alias("doc_hash"), suffix.alias("doc_type"), F.col("path").alias("source_path"), body.alias("text"))
    error = F.when(F.col("text").isNull(), F.concat(F.lit("no parser for "), "doc_type")).when(F.trim("text") == "", "no text")
    return rows.select(F.concat(F.lit("doc_"), F.substring("doc_hash", 1, 16)).alias("doc_id"), "doc_hash", "doc_type", "source_path", "text", loader_title(F.col("text")).alias("title"), error.alias("error"))


def paged(documents: DataFrame, count: str = "page_count") -> DataFrame:
    """Rows (doc_id, page, text): a text's pages by its form feeds where their number is the known page count, else the whole text as one page."""
    parts = F.split("text", "\f", -1)
    blank = F.trim(F.element_at(parts, -1)) == ""
    cut = F.when((F.size(parts) == F.col(count) + 1) & blank, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    fits = F.col(count).isNull() | (F.size(cut) == F.col(count))
    loose = F.when(blank & (F.size(parts) > 1), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    pages = F.when(F.col(count).isNull(), loose).when(fits, F.transform(cut, lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))).otherwise(F.array("text"))
    return documents.select("doc_id", F.posexplode(pages).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page"), "text")


def safe_member(name: Column) -> Column:
    """Whether an archive member's name stays below the folder it's unpacked into."""
    parts = F.split(F.regexp_replace(name, "\\\\", "/"), "/")
    return (name != "") & ~name.rlike("^[/\\\\]") & ~name.rlike("^[A-Za-z]:") & ~F.array_contains(parts, "..")


def archive_members(archives: DataFrame) -> DataFrame:
    """Rows (path, member, content) of zip and tar archives (path, content), links and folders left out; a member outside its folder is an error."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, content in members(raw):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([content], pa.binary())], names=["path", "member", "content"])

    def members(raw: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                yield from ((x.filename, z.read(x)) for x in z.infolist() if not x.is_dir() and (x.external_attr >> 28) != 0xA)
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                yield from ((x.name, t.extractfile(x).read()) for x in t if x.isfile())

    rows = archives.select("path", "content").mapInArrow(unpacked, "path string, member string, content binary")
    named = F.when(safe_member(F.col("member")), F.col("member")).otherwise(F.raise_error(F.concat(F.lit("unsafe archive member "), "member")).cast("string"))
    return rows.select("path", named.alias("member"), "content")


def artifacts(files: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows (artifact, path, found) for named artifacts, each given by the end of its path; of several files the first by path."""
    rows = [files.select(F.lit(name).alias("artifact"), "path").where(F.col("path").endswith(end)).groupBy("artifact").agg(F.min("path").alias("path")) for name, end in wanted.items()]
    names = files.sparkSession.createDataFrame([(x,) for x in wanted], "artifact string")
    return names.join(reduce(DataFrame.unionByName, rows), "artifact", "left").withColumn("found", F.col("path").isNotNull())


def settings(path: str) -> dict:
    """Settings of a YAML or JSON file on the driver; the first needs a YAML parser."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    if path.endswith(".json"):
        return json.loads(content)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML settings need a YAML parser; JSON settings don't") from e
    return yaml.safe_load(content) or {}


def loader_config_hash(config: dict) -> str:
    """The identity of a loader's configuration, part of the parsed-document cache's key."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of JSON lines; lines that aren't JSON are left out."""
    return spark.read.schema(schemas.TRACE).option("mode", "DROPMALFORMED").json(path).where("trace_id IS NOT NULL")


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Results of a checkpoint's lines, the last line of each key; broken lines are left out."""
    from quarry.operators.experiments import latest

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("line"), F.from_json("value", schemas.CHECKPOINT, {"mode": "PERMISSIVE"}).alias("x"))
    return latest(rows.where("x.case_key IS NOT NULL").select("x.*", "line")).drop("line")


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def tolerant_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
