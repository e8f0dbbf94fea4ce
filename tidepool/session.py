"""Session defaults. Settings that depend on the cluster (memory, cores) are left to it."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def session(app: str = "tidepool", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
