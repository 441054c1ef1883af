"""Trace analytics over rows (trace_id, stage, started_at, elapsed_ms, n, error)."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import half_even
from quarry import schemas

INGESTION = ("load", "split", "transform", "embed", "upsert")


def stage_timings(stages: DataFrame, group: str = "stage") -> DataFrame:
    """Rows (stage, n, total_ms, avg_ms, max_ms)."""
    return stages.groupBy(group).agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("total_ms"), F.avg("elapsed_ms").alias("avg_ms"), F.max("elapsed_ms").alias("max_ms"))


def recent(traces: DataFrame, limit: int = 100) -> DataFrame:
    """The latest traces by started_at; ties by trace_id."""
    return traces.orderBy(F.desc("started_at"), "trace_id").limit(limit)


def query_hints(stages: DataFrame) -> DataFrame:
    """Rows (trace_id, hints): what a query trace lacks, as names in a fixed order."""
    has = lambda s: F.max(F.col("stage") == s)
    hits = lambda s: F.coalesce(F.max(F.when(F.col("stage") == s, F.col("n"))), F.lit(0))
    err = lambda s: F.max(F.when(F.col("stage") == s, F.nullif("error", F.lit(""))))
    by = stages.groupBy("trace_id").agg(
        *(has(s).alias(f"has_{s}") for s in ("dense_retrieval", "sparse_retrieval", "fusion", "rerank")),
        *(hits(s).alias(f"n_{s}") for s in ("dense_retrieval", "sparse_retrieval")),
        *(err(s).alias(f"e_{s}") for s in ("dense_retrieval", "sparse_retrieval")),
    )
    d, s = F.col("n_dense_retrieval"), F.col("n_sparse_retrieval")
    hints = F.array(
        F.when(F.col("e_dense_retrieval").isNotNull(), "dense_failed").when((d == 0) & F.col("has_dense_retrieval"), "dense_empty"),
        F.when(F.col("e_sparse_retrieval").isNotNull(), "sparse_failed").when((s == 0) & F.col("has_sparse_retrieval"), "sparse_empty"),
        F.when(~F.col("has_fusion") & (d > 0) & (s > 0), "fusion_missing").when(~F.col("has_fusion"), "fusion_skipped"),
        F.when(~F.col("has_rerank") & ((d > 0) | (s > 0)), "rerank_skipped"),
        F.when((d == 0) & (s == 0), "no_results"),
    )
    return by.select("trace_id", F.array_compact(hints).alias("hints"))


def ingestion_hints(stages: DataFrame) -> DataFrame:
    """Rows (trace_id, missing, empty): the stages a trace lacks, and those that made nothing, in their order."""
    by = stages.groupBy("trace_id").agg(F.collect_set("stage").alias("seen"), F.collect_set(F.when(F.coalesce("n", F.lit(0)) == 0, F.col("stage"))).alias("none"))
    every = F.array(*map(F.lit, INGESTION))
    return by.select("trace_id", F.array_except(every, "seen").alias("missing"), F.array_intersect(every, "none").alias("empty"))


def score_band(score):
    """A score's band: high from 0.8, middle from 0.5, else low."""
    return F.when(score >= 0.8, "high").when(score >= 0.5, "middle").otherwise("low")


def estimated_tokens(text):
    """About how many tokens a text has: a third of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3).cast("int"))


def flattened(traces: DataFrame) -> DataFrame:
    """Rows (trace_id, position, stage, elapsed_ms, data map) of traces with ``stages``; the elapsed time of a stage that has none is 0.

    Older traces keep a stage's fields beside its name instead of in ``data``
    (``legacy``, a map); they count where there is no ``data``.
    """
    legacy = "legacy" in {f.name for f in traces.schema["stages"].dataType.elementType.fields}
    data = F.coalesce(F.col("x.data"), F.map_filter("x.legacy", lambda k, _: ~k.isin("stage", "timestamp", "elapsed_ms", "data"))) if legacy else F.col("x.data")
    return traces.select("trace_id", F.posexplode("stages").alias("position", "x")).select("trace_id", "position", F.col("x.stage").alias("stage"), F.coalesce("x.elapsed_ms", F.lit(0.0)).alias("elapsed_ms"), data.alias("data"))


def stage_data(stages: DataFrame, stage: str) -> DataFrame:
    """Rows (trace_id, data) of a stage; of several with its name the last."""
    return stages.where(F.col("stage") == stage).groupBy("trace_id").agg(F.max_by("data", "position").alias("data"))


def matching(traces: DataFrame, keyword: str) -> DataFrame:
    """Traces whose metadata or stages mention a keyword, regardless of case."""
    return traces.where(F.contains(F.lower(F.concat(F.coalesce(F.to_json("metadata"), F.lit("")), F.lit(" "), F.coalesce(F.to_json("stages"), F.lit("")))), F.lit(keyword.lower())))


def stage_chunks(stages: DataFrame, finals: DataFrame) -> DataFrame:
    """Rows (trace_id, stage, chunk_id, score, source): the chunk lists that stages keep as JSON in ``data.chunks``, and the final results as stage ``final``.

    finals has (trace_id, results) with results as JSON.
    """
    kind = "array<struct<chunk_id:string,score:double,source:string>>"
    listed = stages.select("trace_id", "stage", F.from_json(F.try_element_at("data", F.lit("chunks")), kind).alias("c"))
    final = finals.select("trace_id", F.lit("final").alias("stage"), F.from_json("results", kind).alias("c"))
    return listed.unionByName(final).where(F.size("c") > 0).select("trace_id", "stage", F.inline("c"))


def snapshot(results: DataFrame) -> DataFrame:
    """Results as a trace keeps them: query_id, chunk_id, score to four digits, text, source."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    return results.select("query_id", "rank", "chunk_id", half_even(F.col("score"), 4).alias("score"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(meta("source_path"), meta("source"), F.lit("")).alias("source"))


class Recorder:
    """One trace as it happens; ``rows`` gives it as a DataFrame of the trace schema."""

    def __init__(self, trace_type: str, metadata: dict[str, str] | None = None):
        self.trace_id, self.trace_type, self.metadata = uuid.uuid4().hex, trace_type, dict(metadata or {})
        self.started_at, self.begun = _now(), time.monotonic()
        self.finished_at: str | None = None
        self.ended: float | None = None
        self.stages: list[tuple[str, str, float | None, dict[str, str]]] = []

    def record(self, stage: str, data: dict[str, object], elapsed_ms: float | None = None) -> None:
        self.stages.append((stage, _now(), None if elapsed_ms is None else round(elapsed_ms, 2), {k: str(v) for k, v in data.items()}))

    @contextmanager
    def timed(self, stage: str, data: dict[str, object] | None = None) -> Iterator[None]:
        """Records a stage with the time that its body takes."""
        start = time.monotonic()
        try:
            yield
        finally:
            self.record(stage, data or {}, (time.monotonic() - start) * 1000)

    def finish(self) -> None:
        self.ended, self.finished_at = time.monotonic(), _now()

    def elapsed_ms(self, stage: str | None = None) -> float:
        """The time of a stage, the last of its name, or of the whole trace so far."""
        if stage is None:
            return ((self.ended or time.monotonic()) - self.begun) * 1000
        timed = [x[2] for x in self.stages if x[0] == stage and x[2] is not None]
        if not timed:
            raise KeyError(stage)
        return timed[-1]

    def stage_data(self, stage: str) -> dict[str, str] | None:
        return next((x[3] for x in reversed(self.stages) if x[0] == stage), None)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.trace_id, self.trace_type, self.started_at, self.finished_at, round(self.elapsed_ms(), 3), self.stages, self.metadata)], schemas.TRACE)


def _now() -> str:
    return datetime.now(UTC).isoformat()


class JsonFormatter(logging.Formatter):
    """Log records as JSON lines, with the fields that callers add."""

    def format(self, record: logging.LogRecord) -> str:
        extra = {k: v for k, v in record.__dict__.items() if k not in logging.makeLogRecord({}).__dict__ and k not in ("message", "asctime")}
        out = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()} | extra
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False, default=str)
