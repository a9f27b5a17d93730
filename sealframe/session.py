"""Session settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "sealframe") -> SparkSession.Builder:
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
