"""Experiments: index reuse, comparison, history and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def index_reuse(plans: DataFrame) -> DataFrame:
    """Plans (position, name, fingerprint) with the first plan of the same fingerprint, whose index they use; null for that plan itself."""
    first = F.first("name").over(Window.partitionBy("fingerprint").orderBy("position"))
    return plans.withColumn("reuses_index_of", F.when(first != F.col("name"), first))


def best_runs(runs: DataFrame) -> DataFrame:
    """For each config_id the best run by hit rate, reciprocal rank, then time, with run_count and experiment_aliases.

    A missing or zero measure counts as -1.
    """
    score = [F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(-1.0)).desc() for c in ("hit_rate", "mrr")]
    by = Window.partitionBy("config_id")
    aliases = F.array_join(F.array_sort(F.collect_set("experiment").over(by)), "|")
    rows = runs.withColumns({"__r": F.row_number().over(by.orderBy(*score, F.desc("created_at"), "experiment")), "run_count": F.count("*").over(by), "experiment_aliases": aliases})
    return rows.where("__r = 1").drop("__r")


def comparison(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row for each experiment with the means of the named metrics as columns; ``metrics`` has (experiment, case_id, metric, value)."""
    means = [F.avg(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names]
    return metrics.groupBy("experiment").agg(F.countDistinct("case_id").alias("query_count"), *means)


def case_key(case_id, position):
    """The key of a case in a checkpoint: its id, else its place."""
    return F.coalesce(F.concat(F.lit("id:"), case_id), F.concat(F.lit("index:"), position.cast("string")))


def latest(checkpoint: DataFrame, key: str = "case_key", order: str = "line") -> DataFrame:
    """The last row of each key."""
    return checkpoint.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def resume(cases: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Cases (case_key, query) with ``reused``: whether the checkpoint holds the key with the same query."""
    done = latest(checkpoint).select("case_key", F.col("query").alias("__q"))
    return cases.join(done, "case_key", "left").withColumn("reused", F.coalesce(F.col("__q") == F.col("query"), F.lit(False))).drop("__q")
