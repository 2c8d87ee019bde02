"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "sievegrid", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; other settings are the cluster's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


#: Rows of an Arrow batch, where the session has Spark's own 10,000: texts are long, and both sides hold a batch or two.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH for the session, unless someone has chosen another number."""
    name, default, wanted = BATCH
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, wanted)
