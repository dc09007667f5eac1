"""Session defaults for jobs that bring no session of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "textloom", **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, Arrow; everything else is the deployment's."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()
