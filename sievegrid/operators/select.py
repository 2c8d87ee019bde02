"""The selection stage: a pluggable selector per item, its trace, and results of review."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "query_id STRING, best_doc_id STRING, reasoning STRING, iterations INT, tokens_in BIGINT, tokens_out BIGINT, error STRING"
Selector = Callable[[dict], dict]


def run_selector(items: DataFrame, build: Callable[[], Selector]) -> DataFrame:
    """One result per item (query_id, description, candidates); a failing item gives a record with its error.

    `build` makes the selector, with whatever client it needs, once per task.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        select = build()
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                blank = {"query_id": row["query_id"], "best_doc_id": None, "reasoning": "", "iterations": 0, "tokens_in": 0, "tokens_out": 0, "error": None}
                try:
                    out.append(blank | select(row))
                except Exception as e:  # an item's failure is a result, not the job's
                    out.append(blank | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=list(blank) if not out else None)

    return items.mapInPandas(run, RESULT)


def first_candidate() -> Selector:
    """A stand-in without a model: takes the first candidate."""

    def select(row: dict) -> dict:
        found = list(row["candidates"])
        return {"best_doc_id": found[0] if found else None, "reasoning": "first candidate" if found else "no candidates", "iterations": 1}

    return select


def replay(calls: DataFrame) -> DataFrame:
    """(item, inspected, answer, n_calls) of traces (item, turn, tool, doc_id); after a submission nothing counts; what is submitted is inspected."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "tool", "doc_id")))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(None).cast("string").alias("answer"), F.lit(False).alias("closed"), F.lit(0).alias("n"))

    def step(a, c):
        read = F.when(c["tool"].isin("read", "read_file", "submit"), F.array_union(a["seen"], F.array(c["doc_id"]))).otherwise(a["seen"])
        return F.when(a["closed"], a).otherwise(F.struct(read.alias("seen"), F.when(c["tool"] == "submit", c["doc_id"]).otherwise(a["answer"]).alias("answer"), (c["tool"] == "submit").alias("closed"), (a["n"] + 1).alias("n")))

    out = calls.groupBy("item").agg(rows.alias("r")).withColumn("a", F.aggregate("r", start, step))
    return out.select("item", F.col("a.seen").alias("inspected"), F.col("a.answer").alias("answer"), F.col("a.n").alias("n_calls"))


def reviewed(main: DataFrame, critic: DataFrame) -> DataFrame:
    """Main results with a reviewer's answer, if there was one to review and it gave another: merged traces, summed use, whether it changed the pick."""
    side = critic.select("query_id", F.col("best_doc_id").alias("c_pick"), F.col("tokens_in").alias("c_in"), F.col("tokens_out").alias("c_out"), F.col("inspected").alias("c_seen"))
    none, had = F.array().cast("array<string>"), F.coalesce(F.col("best_doc_id") != "", F.lit(False))
    some = F.when(had, F.nullif("c_pick", F.lit("")))
    used = lambda c: F.when(had, F.coalesce(c, F.lit(0))).otherwise(0)
    return main.join(side, "query_id", "left").select(
        "query_id", F.coalesce(some, "best_doc_id").alias("best_doc_id"), F.coalesce(some != F.col("best_doc_id"), F.lit(False)).alias("overrode"),
        (F.col("tokens_in") + used("c_in")).alias("tokens_in"), (F.col("tokens_out") + used("c_out")).alias("tokens_out"),
        F.array_distinct(F.concat(F.coalesce("inspected", none), F.when(had, F.coalesce("c_seen", none)).otherwise(none))).alias("inspected"),
    )


#: The columns of a pass's results, and those that composing two passes works on.
PASS = "query_id STRING, best_doc_id STRING, reasoning STRING, error STRING, stopped_reason STRING, iterations INT, inspected ARRAY<STRING>, calls ARRAY<STRUCT<turn: INT, tool: STRING, args: MAP<STRING, STRING>>>, tokens_in BIGINT, tokens_out BIGINT, cost DOUBLE"


def with_review(main: DataFrame, critic: DataFrame, pools: DataFrame, ranking: DataFrame, truth: DataFrame, top: int = 100) -> DataFrame:
    """One result per query of two passes (both PASS): the main one, and a reviewer's over a small pool.

    pools (query_id, doc_id): what the reviewer saw; ranking (query_id, doc_id, rank): the whole first stage; truth
    (query_id, doc_id). A main pass without a pick, with an error, or with fewer than two in its pool is returned as
    it is. Else the reviewer's calls are appended under `critic.` and numbered on, use is summed and traces merged;
    another pick replaces the main one, with its reason, error, hit and its rank in the whole first stage; the same
    or no pick confirms it. Adds outcome (alone, overridden, confirmed), hit, first_rank of the pick, and truth_rank,
    the best rank of a true document among the first `top`.
    """
    calls = "array<struct<turn:int,tool:string,args:map<string,string>>>"
    side = critic.select("query_id", F.struct(*(c for c in critic.columns if c != "query_id")).alias("c"))
    pooled = pools.groupBy("query_id").agg(F.count("*").alias("pooled"))
    both = main.join(side, "query_id", "left").join(pooled, "query_id", "left")
    met = F.coalesce((F.col("best_doc_id") != "") & (F.coalesce("error", F.lit("")) == "") & (F.col("pooled") >= 2) & F.col("c").isNotNull(), F.lit(False))
    another = met & F.coalesce((F.col("c.best_doc_id") != "") & (F.col("c.best_doc_id") != F.col("best_doc_id")), F.lit(False))
    both = both.withColumn("outcome", F.when(another, "overridden").when(met, "confirmed").otherwise("alone"))

    def told(main_side: Column, override: Column, confirm: Column) -> Column:
        return F.when(F.col("outcome") == "overridden", override).when(F.col("outcome") == "confirmed", confirm).otherwise(main_side)

    def merged(c: str, join) -> Column:
        return F.when(F.col("outcome") == "alone", F.col(c)).otherwise(join(F.col(c), F.col(f"c.{c}")))

    own = F.coalesce("calls", F.array().cast(calls))
    more = F.transform(F.coalesce("c.calls", F.array().cast(calls)), lambda x, i: F.struct((F.size(own) + i + 1).cast("int").alias("turn"), F.concat(F.lit("critic."), x["tool"]).alias("tool"), x["args"].alias("args")))
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    none = F.array().cast("array<string>")
    out = both.select(
        "query_id", "outcome", told(F.col("best_doc_id"), F.col("c.best_doc_id"), F.col("best_doc_id")).alias("best_doc_id"),
        told(F.col("reasoning"), F.concat(F.lit("[critic override] "), F.coalesce("c.reasoning", F.lit(""))), F.concat(F.lit("[critic confirmed] "), F.coalesce("reasoning", F.lit("")))).alias("reasoning"),
        told(F.col("error"), F.col("c.error"), F.col("error")).alias("error"),
        told(F.col("stopped_reason"), F.concat(F.lit("critic_override:"), F.coalesce("c.stopped_reason", F.lit(""))), F.concat(F.lit("critic_confirmed:"), F.coalesce("stopped_reason", F.lit("")))).alias("stopped_reason"),
        merged("iterations", add).alias("iterations"), merged("inspected", lambda a, b: F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))).alias("inspected"),
        F.when(F.col("outcome") == "alone", F.col("calls")).otherwise(F.concat(own, more)).alias("calls"),
        merged("tokens_in", add).alias("tokens_in"), merged("tokens_out", add).alias("tokens_out"), merged("cost", add).alias("cost"),
    )
    known = truth.select("query_id", "doc_id").distinct().withColumn("true", F.lit(True))
    placed = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first_rank"))
    best = placed.where(F.col("first_rank") <= top).join(known, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("first_rank").alias("truth_rank"))
    out = out.withColumn("doc_id", F.col("best_doc_id")).join(known, ["query_id", "doc_id"], "left").join(placed, ["query_id", "doc_id"], "left").join(best, "query_id", "left")
    return out.withColumn("hit", F.coalesce("true", F.lit(False))).drop("true", "doc_id")


def reranked(main: DataFrame, listwise: DataFrame) -> DataFrame:
    """Main results with the first of a listwise order; an empty order leaves the pick."""
    chosen = F.get(F.col("ranking"), F.lit(0))
    return main.join(listwise.select("query_id", "ranking"), "query_id", "left").select("query_id", F.col("best_doc_id").alias("main_pick"), F.coalesce(chosen, "best_doc_id").alias("best_doc_id"), F.coalesce(chosen != F.col("best_doc_id"), F.lit(False)).alias("overrode"))
