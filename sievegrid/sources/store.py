"""Tables that outlive a call: laid out by repository, extended in batches, read in part.

Folders are those that the cluster names in spark.checkpoint.dir, or a path of
the caller's. A table is partitioned by repo_key, so what asks for some
repositories reads theirs only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commit_id STRING, commit_msg STRING, diff STRING, datetime STRING, author STRING, ts TIMESTAMP, repo_key STRING"
_MADE: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path that driver and executors share; `release` deletes what was made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/sievegrid-{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the folders of `scratch`; call once the results that read them are consumed."""
    n = 0
    while _MADE:
        n += _hadoop(spark, _MADE.pop(), "delete", True)
    return n


def _hadoop(spark: SparkSession, path: str, what: str, *args):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return getattr(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), what)(at, *args)


def exists(spark: SparkSession, path: str) -> bool:
    return _hadoop(spark, path, "exists")


def write_by_repo(rows: DataFrame, path: str, order: tuple[str, ...], by: tuple[str, ...] = ("repo_key",)) -> None:
    """Writes rows under path, replacing only the partitions (by) that they have; sorted by order inside files.

    Adaptive execution rebalances the files: those of small repositories are written together by a task, and a large
    repository's rows are split over as many as their size asks for.
    """
    out = rows.hint("rebalance", *by).sortWithinPartitions(*by, *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_commits(commits: DataFrame, path: str) -> None:
    """A commit store: the commits of each repository that they have replace what it held."""
    write_by_repo(commits, path, ("commit_id",))


def commit_store(spark: SparkSession, path: str, schema: str = COMMITS) -> DataFrame:
    """The store's commits. The schema is declared, so a repository's name stays text, whatever it looks like."""
    return spark.read.schema(schema).parquet(path)


def content_of(store: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("commit_msg", "diff")) -> DataFrame:
    """(repo_key, commit_id, *columns) of the asked (repo_key, commit_id); an id is its repository's own, as forks share ids.

    Only the asked repositories are read: the ids, distinct and not blank, prune the store's partitions while the query runs.
    """
    asked = ids.where("repo_key > '' and commit_id > ''").select("repo_key", "commit_id").distinct()
    return store.select("repo_key", "commit_id", *columns).join(asked, ["repo_key", "commit_id"], "left_semi")


def pair_table(items: DataFrame, candidates: DataFrame, store: DataFrame, most: int) -> DataFrame:
    """(cve, desc, repo, commit_id, commit_message, diff, label, rank): the first `most` candidates of each item with their content.

    items (query_id, description, owner, repo, fix_commit_ids array), candidates (query_id, doc_id, rank). All items
    of a repository share one scan of it; a commit that the store lacks has empty texts.
    """
    rows = candidates.where(F.col("rank") <= most).join(items.withColumn("repo_key", F.concat_ws("@@", "owner", "repo")), "query_id").withColumnRenamed("doc_id", "commit_id")
    texts = content_of(store, rows)
    return rows.join(texts, ["repo_key", "commit_id"], "left").select(
        F.col("query_id").alias("cve"), F.coalesce("description", F.lit("")).alias("desc"), F.concat_ws("/", "owner", "repo").alias("repo"), "commit_id",
        F.coalesce("commit_msg", F.lit("")).alias("commit_message"), F.coalesce("diff", F.lit("")).alias("diff"), F.coalesce(F.array_contains("fix_commit_ids", F.col("commit_id")), F.lit(False)).cast("int").alias("label"), "rank",
    )
