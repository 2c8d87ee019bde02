"""What is worked on: samples, progress, required inputs, usable records, and records of what couldn't be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import todo


def chosen(items: DataFrame, key: str, first: int = 0, sample: int = 0, seed: int = 0, position: str | None = None) -> DataFrame:
    """The first items by position, or a sample of them by a seeded hash of their keys; all without either.

    It is taken of all items, before what is done is left out, so the set stays the same from run to run.
    """
    if first > 0 and sample > 0:
        raise ValueError("take the first items or a sample of them, not both")
    if sample > 0:
        return items.orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample)
    if first > 0:
        return items.orderBy(position or key).limit(first)
    return items


def remaining_of(items: DataFrame, done: DataFrame, key: str, **choice) -> DataFrame:
    """Those of the chosen items that no record of `done` (key, error) covers."""
    return todo(chosen(items, key, **choice), done, key)


def progress(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row (done, target, percent): how many of the items have a record; 100 percent of nothing."""
    held = done.select(key).distinct().withColumn("held", F.lit(1))
    s = items.select(key).distinct().join(held, key, "left").agg(F.count("held").alias("done"), F.count("*").alias("target"))
    return s.select("done", "target", F.round(F.when(F.col("target") > 0, F.col("done") / F.col("target") * 100).otherwise(100.0), 1).alias("percent"))


def require(needed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """needed, if all its keys are present; else raises and names some that aren't."""
    absent = needed.select(key).distinct().join(present.select(key), key, "left_anti")
    some = [r[0] for r in absent.orderBy(key).limit(10).collect()]
    if some:
        raise FileNotFoundError(f"{absent.count()} needed inputs are absent, such as {', '.join(map(str, some))}")
    return needed


def failed(value: Column) -> Column:
    """Whether a record's `failed` field says so, in any case; absent is no failure."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def usable(pairs: DataFrame, field: str = "failed") -> DataFrame:
    return pairs.where(~failed(F.col(field)))


def with_missing(queries: DataFrame, records: DataFrame, flag: str = "missing") -> DataFrame:
    """A record for every query: those without one have no candidates, null best rank, recall 0, and the flag.

    queries (query_id), records (query_id, best_rank, recall, num_candidates).
    """
    out = queries.join(records.withColumn("__has", F.lit(True)), "query_id", "left")
    return out.withColumns({"recall": F.coalesce("recall", F.lit(0.0)), "num_candidates": F.coalesce("num_candidates", F.lit(0).cast("long")), flag: F.col("__has").isNull()}).drop("__has")


def only_tools(calls: DataFrame, tools: tuple[str, ...], column: str = "tool") -> DataFrame:
    """Calls of a tool subset, as an ablation allows them."""
    return calls.where(F.col(column).isin(*tools))
