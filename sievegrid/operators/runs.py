"""Analytics of selection runs: one row per item, with traces and token use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.round(a / F.greatest(b, F.lit(1)), 6)


def run_summary(runs: DataFrame) -> DataFrame:
    """One row of measures of runs (n_truths, hit, truth_rank, iterations, n_inspected, tokens_in, tokens_out, cost, seconds, stopped, error).

    Rows without a truth count in n only. Averages of tokens and time leave out zero and absent values; those of
    iterations and of what was inspected leave out absent ones only. stops: reason:count, most frequent first.
    """
    own = F.col("n_truths") > 0
    num = lambda c: F.when(own, F.col(c))
    some = lambda c: F.nullif(num(c), F.lit(0).cast("double"))
    hit, top = F.coalesce(F.col("hit"), F.lit(False)), F.col("truth_rank").isNotNull()
    s = runs.agg(
        F.count("*").alias("n"), F.count_if(own).alias("with_truth"), F.count_if(own & hit).alias("hits"), F.count_if(own & top).alias("reachable"),
        F.count_if(own & ~top).alias("first_stage_missed"), F.count_if(own & top & ~hit).alias("wrong_picks"), F.count_if(own & F.expr("error <> ''")).alias("errors"),
        F.avg(num("iterations")).alias("i"), F.avg(num("n_inspected")).alias("insp"), F.avg(some("tokens_in")).alias("ti"), F.avg(some("tokens_out")).alias("to"), F.avg(some("seconds")).alias("sec"),
        *(F.coalesce(F.sum(num(c)), F.lit(0)).alias(f"sum_{c}") for c in ("tokens_in", "tokens_out", "cost", "seconds")),
    )
    stops = runs.where(own & F.expr("stopped <> ''")).groupBy("stopped").count()
    stops = stops.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("m"), "stopped", "count"))), lambda x: F.concat(x["stopped"], F.lit(":"), x["count"].cast("string"))), " ").alias("stops"))
    avg = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return s.crossJoin(stops).select(
        "n", "with_truth", "hits", ratio(F.col("hits"), F.col("with_truth")).alias("hit_rate"), "reachable", ratio(F.col("reachable"), F.col("with_truth")).alias("reachable_rate"), ratio(F.col("hits"), F.col("reachable")).alias("efficacy"),
        "first_stage_missed", "wrong_picks", avg("i").alias("avg_iterations"), avg("insp").alias("avg_inspected"), F.round("sum_tokens_in", 3).alias("total_in"), F.round("sum_tokens_out", 3).alias("total_out"),
        avg("ti").alias("avg_tokens_in"), avg("to").alias("avg_tokens_out"), F.round("sum_cost", 4).alias("total_cost"), avg("sec").alias("avg_seconds"), F.round("sum_seconds", 3).alias("total_seconds"), "errors", "stops",
    )


def method_totals(runs: DataFrame, by: str = "method") -> DataFrame:
    """(method, n, calls, tokens_in, tokens_out): totals of runs (method, n_calls, tokens_in, tokens_out); absent counts are 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return runs.groupBy(by).agg(F.count("*").alias("n"), total("n_calls").alias("calls"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"))


def submission_rate(runs: DataFrame, by: str = "method") -> DataFrame:
    """(method, n, submitted, percent, avg_steps): runs (method, stopped, pick, iterations) that ended by submitting a pick."""
    done = F.coalesce((F.col("stopped") == "submit_answer") & (F.col("pick") != ""), F.lit(False))
    s = runs.groupBy(by).agg(F.count("*").alias("n"), F.count_if(done).alias("submitted"), F.avg("iterations").alias("x"))
    return s.select(by, "n", "submitted", F.round(100 * F.col("submitted") / F.greatest("n", F.lit(1)), 4).alias("percent"), F.round("x", 6).alias("avg_steps"))


def cost_projection(costs: DataFrame, items: int) -> DataFrame:
    """costs (model, n, cost, per_item) with the cost of a full pass over `items`."""
    return costs.withColumn("projected", F.round(F.col("per_item") * items, 6))


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the columns of order; an aggregate, so repeats are combined before anything moves."""
    rest = [c for c in rows.columns if c != key]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(key, *(F.col(f"__r.{c}").alias(c) for c in rest))


def hybrid_ranks(picks: DataFrame, best_without: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(query_id, rank): 1 for a right pick, else the truth's rank once the pick stands first and is taken out below.

    picks (query_id, hit, pick_rank or null), best_without (query_id, best_rank or null). With order, columns of
    best_without, a query's last row there counts, as where its records were written again.
    """
    best_without = (last_of(best_without, "query_id", order) if order else best_without).select("query_id", "best_rank")
    moved = F.col("best_rank") + F.when(F.col("pick_rank").isNull() | (F.col("pick_rank") > F.col("best_rank")), 1).otherwise(0)
    return picks.join(best_without, "query_id").select("query_id", F.when(F.col("hit"), 1).otherwise(moved).cast("int").alias("rank"))


def recall_mrr(ranks: DataFrame, ks=(1, 3, 5, 10, 100)) -> DataFrame:
    at = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"r_at_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n"), *at, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def lift(before: DataFrame, after: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row: hit rates of (query_id, hit) before and after, gain and relative gain (null over nothing); with order, of each query's last rows."""
    before, after = (last_of(x, "query_id", order) if order else x for x in (before, after))
    s = before.select("query_id", F.col("hit").cast("int").alias("x")).join(after.select("query_id", F.col("hit").cast("int").alias("y")), "query_id").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return s.select("n", F.round("x", 6).alias("before"), F.round("y", 6).alias("after"), F.round(F.col("y") - F.col("x"), 6).alias("gain"), F.round((F.col("y") - F.col("x")) / F.nullif("x", F.lit(0.0)), 6).alias("relative_gain"))


def tool_breakdown(calls: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(tool, calls, items, usage_rate, per_item) of calls (item, tool), rates over all items (column item), also those without a call."""
    n = (calls if items is None else items).agg(F.count_distinct("item").alias("n"))
    per = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_distinct("item").alias("items"))
    return per.join(F.broadcast(n)).select("tool", "calls", "items", ratio(F.col("items"), F.col("n")).alias("usage_rate"), ratio(F.col("calls"), F.col("n")).alias("per_item"))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, n, cost, per_item) of usage (model, tokens_in, tokens_out); prices per million; unknown models cost 0."""
    priced = usage.join(prices, "model", "left")  # small tables are broadcast by their size
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return priced.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"), F.round(F.sum(cost) / F.count("*"), 9).alias("per_item"))


def best_record(records: DataFrame, keys: list[str]) -> DataFrame:
    """The record to keep of several sources: the latest valid one, else the earliest failed one."""
    order = Window.partitionBy(*keys).orderBy(F.desc("valid"), F.when(F.col("valid"), -F.col("source_order")).otherwise(F.col("source_order")))
    return records.withColumn("__i", F.row_number().over(order)).where("__i = 1").drop("__i")


def marginal(rungs: DataFrame) -> DataFrame:
    """(place, name, value, gain): gain over the rung before."""
    return rungs.withColumn("gain", F.round(F.col("value") - F.lag("value").over(Window.orderBy("place")), 6))


def capability_ladder(rungs: DataFrame, floor: float, bottom: float) -> DataFrame:
    """(interface, place, tier, value, gain): what each capability adds, over the rung before in its interface.

    rungs (interface, place from 2, tier, value or null); rungs are told apart by interface and tier, as tiers of two
    interfaces may share a label. All interfaces stand on a floor (place 0, without a tool) and one bottom rung
    (place 1). A rung without a value has no gain, and the next one stands on the last that has one.
    """
    shared = F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(t).alias("tier"), F.lit(float(v)).alias("value")) for i, t, v in ((0, "floor", floor), (1, "bottom", bottom)))))
    base = rungs.select("interface").distinct().select("interface", shared)
    rows = base.unionByName(rungs.select("interface", F.col("place").cast("int").alias("place"), "tier", F.col("value").cast("double").alias("value")))
    before = F.last("value", ignorenulls=True).over(Window.partitionBy("interface").orderBy("place", "tier").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("interface", "place", "tier", "value", F.round(F.col("value") - before, 6).alias("gain"))


def stop_reason(answered: Column, error: Column, iterations: Column, most: int) -> Column:
    return F.when(error.isNotNull() & (error != ""), "error").when(answered, "submit_answer").when(iterations >= most, "max_iterations").otherwise("no_answer")


def context_overflow(error: Column) -> Column:
    """Whether an error text tells of a context that was too long."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return low.contains("contextwindowexceeded") | low.contains("maximum context length")


def todo(items: DataFrame, done: DataFrame, key: str, redo_errors: bool = True) -> DataFrame:
    """Items that no record of `done` (key, error) covers; errored ones are done again unless told otherwise."""
    held = done.where("error is null or error = ''") if redo_errors else done
    return items.join(held.select(key), key, "left_anti")


def keep_last(rows: DataFrame, key: str, order: list) -> DataFrame:
    last = Window.partitionBy(key).orderBy(*(c.desc() for c in order))
    return rows.where(F.col(key).isNotNull()).withColumn("__i", F.row_number().over(last)).where("__i = 1").drop("__i")
