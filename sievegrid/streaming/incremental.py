"""Append-and-resume as a stream: new records are processed once, results appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 100):
    """Runs `step` over JSON files that appeared in source since the last run, and appends its rows to sink.

    Each micro-batch writes its own folder, so a batch that is tried again
    replaces what it wrote: results are exactly once. Items are independent;
    no state is kept between batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").json(f"{sink.rstrip('/')}/batch={number:08d}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
