"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "driftline", **conf: str) -> SparkSession:
    """UTC, and adaptive execution with skew handling; anything else is the cluster's to set."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
