"""A SparkSession with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "orrery", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; ``conf`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
