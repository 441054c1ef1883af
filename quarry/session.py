"""The session the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quarry", **conf: str) -> SparkSession:
    """A session with ANSI mode, adaptive execution, UTC and Arrow on; ``conf`` adds settings (dots as double underscores)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
