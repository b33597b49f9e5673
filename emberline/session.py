"""A session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive plans with skew handling; shuffle partitions stay the cluster's choice unless given."""
    builder = SparkSession.builder.appName("emberline")
    if master:
        builder = builder.master(master)
    held = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | settings
    for k, v in held.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
