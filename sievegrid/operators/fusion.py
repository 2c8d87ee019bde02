"""Reciprocal rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import ranked

K = 60


def rrf(lexical: DataFrame, dense: DataFrame, k: int = K, top: int | None = 100) -> DataFrame:
    """(query_id, doc_id, score, rank, source, bm25_rank, dense_rank): sums of 1 / (k + rank) over a full outer join.

    Ties: lexical rank (absent ones last), then dense rank, then doc_id.
    """
    a = lexical.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"))
    b = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    source = F.when(F.col("bm25_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "bm25").otherwise("both")
    both = both.select("query_id", "doc_id", F.round(part("bm25_rank") + part("dense_rank"), 9).alias("score"), source.alias("source"), "bm25_rank", "dense_rank")
    return ranked(both, ["query_id"], [F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("dense_rank"), F.col("doc_id")], top)


def single_leg(ranking: DataFrame, leg: str, top: int = 100) -> DataFrame:
    """A fused ranking's shape from one leg alone."""
    return ranking.where(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank", F.lit(leg).alias("source"))
