"""Quantiles by index, exact tests and resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    own = Window.partitionBy(*by)
    return rows.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(own.orderBy(value))).withColumn("n", F.count("*").over(own))


def exclusive_p95(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, median, p95): p95 interpolated at 0.95 (n + 1); the maximum below 20 rows."""
    at = F.col("n") * 19 + 19
    low = F.floor(at / 20)
    part = (at % 20) / 20
    lower, upper = F.max(F.when(F.col("i") == F.least(F.greatest(low, F.lit(1)), F.col("n") - 1), F.col(value))), F.max(F.when(F.col("i") == F.least(F.greatest(low, F.lit(1)), F.col("n") - 1) + 1, F.col(value)))
    share = F.max(F.when(low > F.col("n") - 1, F.lit(1.0)).otherwise(part))
    p95 = F.when(F.max("n") < 20, F.max(value)).otherwise(lower + (upper - lower) * share)
    median = F.avg(F.when((F.col("i") == F.floor((F.col("n") + 1) / 2)) | (F.col("i") == F.floor(F.col("n") / 2) + 1), F.col(value)))
    return _placed(rows, value, by).groupBy(*by).agg(F.max("n").alias("n"), F.round(median, 6).alias("median"), F.round(p95, 6).alias("p95"))


def floor_percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, median, p90, p99, max): a percentile is the element at floor(n p), counted from 0 and clamped."""
    pick = lambda p: F.max(F.when(F.col("i") - 1 == F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)), F.col(value)))
    return _placed(rows, value, by).groupBy(*by).agg(
        F.max("n").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(pick(50), 6).alias("median"), F.round(pick(90), 6).alias("p90"), F.round(pick(99), 6).alias("p99"), F.round(F.max(value), 6).alias("max"),
    )


def binomial_two_sided(b: Column, c: Column) -> Column:
    """min(1, 2 sum_{i <= min(b, c)} C(n, i) / 2^n), n = b + c, with logarithms of factorials; 1 without discordant pairs."""
    n, k = b + c, F.least(b, c)
    term = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("t")), lambda a, i: F.struct(
        (a["p"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(a["t"] + F.log((n - i + 1) / i)) - n * math.log(2))).alias("p"),
        F.when(i == 0, F.lit(0.0)).otherwise(a["t"] + F.log((n - i + 1) / i)).alias("t"),
    ))["p"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * term))


def mcnemar(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row (n, b, c, p_value) from two hit vectors (query_id, hit); a missing query is a miss."""
    both = one.select("query_id", F.col("hit").alias("x")).join(other.select("query_id", F.col("hit").alias("y")), "query_id", "full_outer").fillna(0, ["x", "y"])
    s = both.agg(F.count("*").alias("n"), F.count_if(F.expr("x > y")).alias("b"), F.count_if(F.expr("x < y")).alias("c"))
    return s.select("n", "b", "c", F.round(binomial_two_sided(F.col("b"), F.col("c")), 9).alias("p_value"))


def length_stats(rows: DataFrame, text: str) -> DataFrame:
    """One row (n, min, max, mean, median, p95) of the lengths of texts that aren't empty; a percentile is the element at floor(n p), from 0.

    Lengths are counted first, so what is ordered is one row per length, not per text.
    """
    counted = rows.select(F.length(text).alias("x")).where("x > 0").groupBy("x").agg(F.count("*").alias("c"))
    s = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"), F.array_sort(F.collect_list(F.struct("x", "c"))).alias("all"))

    def element(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("x"))
        return F.aggregate("all", start, lambda a, v: F.when(a["x"].isNotNull(), a).otherwise(F.struct((a["seen"] + v["c"]).alias("seen"), F.when(a["seen"] + v["c"] > at, v["x"]).alias("x"))))["x"]

    at95 = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return s.select("n", "min", "max", F.round("mean", 6).alias("mean"), element(F.floor(F.col("n") / 2)).alias("median"), element(at95).alias("p95"))


def bootstrap_ci(hits: DataFrame, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """One row (n, mean, low, high): percentile interval of the mean of (query_id, hit), hits 0 or 1; none without rows.

    Each of a resample's n draws takes a row by a hash of seed, resample and draw, modulo n; rows of one value can't be
    told apart, so the hits are the first rows. All draws are made where they are counted, and the same seed gives the
    same result.
    """
    size = hits.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("k")).where("n > 0")
    draws = hits.sparkSession.range(resamples).withColumnRenamed("id", "b").join(F.broadcast(size)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "i")), 1, 8), 16, 10).cast("long") % F.col("n")
    means = draws.groupBy("b", "n", "k").agg(F.avg((place < F.col("k")).cast("double")).alias("m"))
    at = lambda p: F.round(F.get(F.col("all"), F.lit(min(resamples - 1, int(p * resamples)))), 6)
    out = means.groupBy("n", "k").agg(F.array_sort(F.collect_list("m")).alias("all"))
    return out.select("n", F.round(F.col("k") / F.col("n"), 6).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))
