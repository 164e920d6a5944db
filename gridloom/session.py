"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "gridloom", **config: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, ANSI mode as Spark has it.

    ``config`` adds or replaces settings; master and memory are the caller's.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | config
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
