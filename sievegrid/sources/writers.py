"""Sinks, and what a later run still has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runs import todo


def append_records(records: DataFrame, path: str, batch: str) -> None:
    """Appends a batch of JSON records as its own partition; a batch written again replaces itself."""
    records.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def remaining(items: DataFrame, done_path: str, key: str, redo_errors: bool = True, schema: str = "error STRING") -> DataFrame:
    """Items that the records under done_path don't cover; all of them if there are none yet."""
    spark = items.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return items
    kind = items.schema[key].dataType.simpleString()
    return todo(items, spark.read.json(done_path, schema=f"`{key}` {kind}, {schema}"), key, redo_errors)


def write_embeddings(vectors: DataFrame, path: str, partition: str = "repo_key") -> None:
    vectors.repartition(partition).sortWithinPartitions("id").write.mode("overwrite").partitionBy(partition).parquet(path)


def pending_partitions(keys: DataFrame, written: DataFrame, partition: str = "repo_key") -> DataFrame:
    """Keys without written rows."""
    return keys.join(written.select(partition).distinct(), partition, "left_anti")


def write_pairs(pairs: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    pairs.select(*columns).write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True)


def summary(metrics: DataFrame, **meta: str) -> DataFrame:
    """One JSON string per row of metrics, with metadata."""
    return metrics.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in meta.items()), F.struct("*").alias("metrics"))).alias("value"))


def write_summary(metrics: DataFrame, path: str, **meta: str) -> None:
    """A JSON line for each row of metrics, with metadata, in a file of its own under path; a summary written again replaces itself."""
    summary(metrics, **meta).coalesce(1).write.mode("overwrite").text(path)
