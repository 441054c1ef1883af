"""Evaluation runs on disk: written once for each suite, found again and read in bulk."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluation

RUN = "run string, created_at string, case_count long, elapsed_ms double"
PLAN = "run string, name string, collection string, index_fingerprint string, reuses_index_of string, settings string"
SUMMARY = "run string, experiment string, query_count long, total_elapsed_ms double, aggregate_metrics map<string,double>"
CASES = "run string, experiment string, case_id string, query string, elapsed_ms double, metrics map<string,double>"
TABLES = {"runs": RUN, "plans": PLAN, "summaries": SUMMARY, "cases": CASES}


def save(spark: SparkSession, path: str, run: str, created_at: str, plans: list[evaluation.Plan], cases: DataFrame, summaries: DataFrame, errors: dict[str, str], elapsed_ms: float) -> None:
    """A suite's run, plans, summaries (experiment, query_count, total_elapsed_ms, aggregate_metrics) and cases, each a folder of JSON lines partitioned by run, and its comparison as CSV.

    A run that is written again replaces itself.
    """
    from quarry.functions.ids import canonical_json

    def put(rows: DataFrame, table: str) -> None:
        rows.drop("run").write.mode("overwrite").json(f"{path}/{table}/run={run}")

    n = cases.select("case_id").distinct().count()
    put(spark.createDataFrame([(created_at, n, float(elapsed_ms))], "created_at string, case_count long, elapsed_ms double"), "runs")
    made = [(p.name, p.collection, p.fingerprint, p.reuses_index_of, canonical_json(p.settings)) for p in plans]
    listed = spark.createDataFrame(made, "name string, collection string, index_fingerprint string, reuses_index_of string, settings string")
    put(listed, "plans")
    put(summaries, "summaries")
    put(cases, "cases")
    failed = spark.createDataFrame(list(errors.items()), "name string, error string")
    table = comparison(listed, summaries, failed)
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/comparison/run={run}")  # a row for each experiment


def comparison(plans: DataFrame, summaries: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each plan: experiment, status, collection, index_fingerprint, reuses_index_of, query_count, total_elapsed_ms, metrics as JSON, error."""
    joined = plans.withColumnRenamed("name", "experiment").join(summaries, "experiment", "left").join(errors.withColumnRenamed("name", "experiment"), "experiment", "left")
    good = F.col("query_count").isNotNull()
    return joined.select("experiment", F.when(good, "success").otherwise("failed").alias("status"), "collection", "index_fingerprint", F.coalesce("reuses_index_of", F.lit("")).alias("reuses_index_of"), F.coalesce("query_count", F.lit(0)).alias("query_count"), "total_elapsed_ms", F.to_json("aggregate_metrics").alias("metrics"), F.coalesce("error", F.lit("")).alias("error"))


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All runs' rows of a table; lines that aren't JSON are left out."""
    return spark.read.schema(TABLES[table]).option("basePath", f"{path}/{table}").option("mode", "DROPMALFORMED").json(f"{path}/{table}")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Runs (run, created_at, case_count, elapsed_ms), the newest first."""
    return read(spark, path, "runs").orderBy(F.desc("created_at"), F.desc("run"))


def export_history(spark: SparkSession, path: str) -> DataFrame:
    """The best run of each configuration over all runs, with its report columns."""
    from quarry.operators.experiments import best_runs

    metric = lambda k: F.try_element_at("aggregate_metrics", F.lit(k))
    summaries = read(spark, path, "summaries").select("run", "experiment", "query_count", "total_elapsed_ms", metric("evidence_hit_rate@5").alias("hit_rate"), metric("evidence_mrr@5").alias("mrr"))
    best = best_runs(evaluation.history_rows(read(spark, path, "runs"), read(spark, path, "plans"), summaries))
    return best.select(*(c for c in best.columns if c != "settings"), *evaluation.config_columns())


def append_checkpoint(rows: DataFrame, path: str) -> None:
    """Adds finished cases (case_key, result) to a checkpoint, as JSON lines."""
    rows.write.mode("append").text(path) if rows.columns == ["value"] else rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def clear(spark: SparkSession, root: str, paths: list[str], dry_run: bool = True) -> list[str]:
    """Deletes folders below ``root``, or only names them; a path that leaves the root is an error."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for p in paths:
        if not p.strip("/") or p.startswith("/") or ".." in re.split(r"[/\\]", p) or ":" in p:
            raise ValueError(f"not below {root}: {p!r}")
        place = jvm.org.apache.hadoop.fs.Path(base, p)
        if fs.exists(place):
            gone.append(place.toString())
            if not dry_run:
                fs.delete(place, True)
    return gone
