"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, upper: bool) -> DataFrame:
    """One star step over edges (a, b), a > b.

    upper: every larger neighbour of a node is tied to the node's least
    neighbour; else every node is tied to its least smaller neighbour, and its
    other smaller neighbours too.
    """
    if upper:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge, with the least node it reaches.

    edges: columns a, b (any order, repeats and loops allowed). Large and small
    star steps alternate until the edge set stays the same; each round is
    written out, so lineage does not grow. Degrees are never gathered: hubs are
    pre-aggregated, and joins on them may be split.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = materialize(edges, f"{tag}-edges")

    def sign(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()

    before = sign(state)
    for _ in range(rounds):
        if not before["n"]:
            break
        last, state = state, materialize(_stars(_stars(state, True), False), f"{tag}-star")
        discard(last)
        now = sign(state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
