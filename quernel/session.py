"""Session settings that the engine is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "quernel", master: str | None = None) -> SparkSession.Builder:
    """UTC, adaptive execution with skewed joins split, zstd shuffles off the default codec only where the cluster sets it. Master and memory are the cluster's."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    return b.master(master) if master else b
