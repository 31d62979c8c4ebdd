"""Session defaults: UTC, adaptive execution, typed failures instead of silent ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "vitalgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; an existing one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
