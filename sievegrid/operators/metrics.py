"""Retrieval metrics over long rankings (query_id, doc_id, rank) and truths (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def truth_of(csv_rows: DataFrame, query: str, docs: str) -> DataFrame:
    """(query_id, doc_id) from rows whose column lists ids between bars: split, trimmed, without blanks, distinct."""
    each = F.explode(F.split(F.coalesce(docs, F.lit("")), r"\|")).alias("doc_id")
    return csv_rows.select(F.col(query).alias("query_id"), each).select("query_id", F.trim("doc_id").alias("doc_id")).where("doc_id <> ''").distinct()


def marked(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """ranking with hit 0/1."""
    flag = truth.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return ranking.join(flag, ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def best_rank(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, best_rank) for every query with truth; null if none of it was ranked."""
    found = ranking.join(truth, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").cast("int").alias("best_rank"))
    return truth.select("query_id").distinct().join(found, "query_id", "left")


def hit_at_k(ranking: DataFrame, truth: DataFrame, ks=(10, 100, 500, 1000)) -> DataFrame:
    """(k, n_queries, recall): share of queries with truth that have some of it in their first k."""
    best = best_rank(ranking, truth)
    one = best.agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("best_rank") <= k, 1).otherwise(0)).alias(f"k{k}") for k in ks))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("h")) for k in ks))).alias("x")
    return one.select("n", rows).select(F.col("x.k").alias("k"), F.col("n").alias("n_queries"), F.round(F.col("x.h") / F.greatest("n", F.lit(1)), 6).alias("recall"))


def recall_fraction(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, found, truths, recall): share of a query's truths in its first k."""
    got = ranking.where(F.col("rank") <= k).join(truth, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"))
    all_of = truth.groupBy("query_id").agg(F.count("*").alias("truths"))
    found = F.coalesce("found", F.lit(0))
    return all_of.join(got, "query_id", "left").select("query_id", found.alias("found"), "truths", F.round(found / F.col("truths"), 6).alias("recall"))


def ndcg_at_k(ranking: DataFrame, truth: DataFrame, ks=KS) -> DataFrame:
    """(query_id, k, ndcg): binary gains; the ideal has the hits that the ranking itself holds first."""
    hits = marked(ranking, truth).where("hit = 1")
    place = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("i", F.row_number().over(place))
    gain = lambda at: 1 / F.log2(F.col(at) + 1)
    sums = [F.sum(F.when(F.col(c) <= k, gain(c)).otherwise(0.0)).alias(f"{c}{k}") for c in ("rank", "i") for k in ks]
    per = truth.select("query_id").distinct().join(hits.groupBy("query_id").agg(*sums), "query_id", "left")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"rank{k}") / F.nullif(f"i{k}", F.lit(0.0)), F.lit(0.0)).alias("v")) for k in ks))).alias("x")
    return per.select("query_id", rows).select("query_id", F.col("x.k").alias("k"), F.round("x.v", 6).alias("ndcg"))


def reciprocal_rank(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rr): 0 where no truth was ranked."""
    return best_rank(ranking, truth).select("query_id", F.round(F.coalesce(1 / F.col("best_rank"), F.lit(0.0)), 6).alias("rr"))


def denominator(rankings: dict[str, DataFrame], truth: DataFrame, mode: str) -> dict[str, DataFrame]:
    """Queries that count for each method: all with truth (full), those the method covers (coverage), or all cover (common)."""
    full = truth.select("query_id").distinct()
    covered = {m: full.join(r.select("query_id").distinct(), "query_id", "left_semi") for m, r in rankings.items()}
    if mode == "full":
        return dict.fromkeys(rankings, full)
    if mode == "coverage":
        return covered
    if mode != "common":
        raise ValueError(f"no such denominator: {mode}")
    common = full
    for c in covered.values():
        common = common.join(c, "query_id", "left_semi")
    return dict.fromkeys(rankings, common)


def metric_table(rankings: dict[str, DataFrame], truth: DataFrame, mode: str = "common", ks=KS) -> DataFrame:
    """(method, n, r@1.., ndcg@3.., mrr) of each method over its denominator; queries without hits add nothing but count."""
    out = None
    for method, counted in denominator(rankings, truth, mode).items():
        own = truth.join(counted, "query_id", "left_semi")
        rr = reciprocal_rank(rankings[method], own).join(best_rank(rankings[method], own), "query_id")
        gains = ndcg_at_k(rankings[method], own, ks).groupBy("query_id").pivot("k", list(ks)).agg(F.first("ndcg"))
        row = rr.join(gains, "query_id").agg(
            F.count("*").alias("n"),
            *(F.round(F.avg(F.when(F.col("best_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"r_at_{k}") for k in ks),
            *(F.round(F.avg(F.col(str(k))), 6).alias(f"ndcg_at_{k}") for k in ks),
            F.round(F.avg("rr"), 6).alias("mrr"),
        ).select(F.lit(method).alias("method"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def micro_macro(picks: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of Hit@1, micro and macro precision, recall, F1 and abstentions; picks (query_id, doc_id or null).

    A query without a pick counts, but neither as right nor as wrong; misses
    are the truths that no pick names.
    """
    size = truth.groupBy("query_id").agg(F.count("*").alias("positives"))
    right = picks.join(truth.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    each = right.join(size, "query_id", "left").select(
        F.coalesce("hit", F.lit(0)).alias("tp"), (F.col("doc_id").isNotNull() & F.col("hit").isNull()).cast("int").alias("fp"), F.coalesce("positives", F.lit(0)).alias("p"), F.col("doc_id").isNull().cast("int").alias("abstained"),
    )
    each = each.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).withColumn("recall", F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0))
    each = each.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    s = each.agg(F.count("*").alias("n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("p").alias("p"), F.sum("abstained").alias("abstained"), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    micro_p, micro_r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("p"))
    return s.select(
        "n", F.col("tp"), "fp", (F.col("p") - F.col("tp")).alias("fn"), "abstained", F.round(ratio(F.col("tp"), F.col("n")), 4).alias("hit_at_1"),
        F.round(micro_p, 4).alias("micro_precision"), F.round(micro_r, 4).alias("micro_recall"), F.round(F.coalesce(2 * micro_p * micro_r / F.nullif(micro_p + micro_r, F.lit(0.0)), F.lit(0.0)), 4).alias("micro_f1"),
        *(F.round(F.coalesce(f"macro_{c}", F.lit(0.0)), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")),
    )


def rank1_baseline(best: DataFrame) -> DataFrame:
    """One row (n, recoverable, right_at_1, accuracy) of best ranks (query_id, best_rank or null): what taking the first candidate gets."""
    s = best.agg(F.count("*").alias("n"), F.count("best_rank").alias("recoverable"), F.count_if(F.expr("best_rank = 1")).alias("right_at_1"))
    return s.withColumn("accuracy", F.round(F.col("right_at_1") / F.greatest("n", F.lit(1)), 6))


def recoverable(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id): queries with a true document anywhere in their ranking."""
    return ranking.join(truth, ["query_id", "doc_id"], "left_semi").select("query_id").distinct()


def confusion(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: hits of two runs (query_id, pick, hit) against each other, overrides, their precision, net change."""
    both = before.select("query_id", F.col("pick").alias("p0"), F.col("hit").alias("h0")).join(after.select("query_id", F.col("pick").alias("p1"), F.col("hit").alias("h1")), "query_id")
    over = ~F.col("p0").eqNullSafe(F.col("p1"))
    s = both.agg(
        F.count("*").alias("n"), F.count_if(F.expr("h0 and h1")).alias("both_right"), F.count_if(F.expr("h0 and not h1")).alias("lost"), F.count_if(F.expr("not h0 and h1")).alias("gained"), F.count_if(F.expr("not h0 and not h1")).alias("both_wrong"),
        F.count_if(over).alias("overrides"), F.count_if(over & F.col("h1")).alias("right_overrides"),
    )
    return s.select("*", F.round(F.coalesce(F.col("right_overrides") / F.nullif("overrides", F.lit(0)), F.lit(0.0)), 6).alias("override_precision"), (F.col("gained") - F.col("lost")).alias("net_change"))


def with_labelled(truth: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """truth, and the pairs (query_id, doc_id, label) with label 1 unless it is to be strict (no pairs); each once."""
    if pairs is None:
        return truth.select("query_id", "doc_id").distinct()
    more = pairs.where(F.col("query_id").isNotNull() & (F.col("label").cast("int") == 1)).select("query_id", "doc_id")
    return truth.select("query_id", "doc_id").unionByName(more).distinct()


def pool_sanity(pairs: DataFrame, short: int = 60) -> DataFrame:
    """One row (n, queries, positives, short_texts, with_positive) of a pool (query_id, label, diff)."""
    per = pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.count_if(F.length("diff") < short).alias("s"), F.max("label").alias("m"))
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("queries"), F.sum("p").alias("positives"), F.sum("s").alias("short_texts"), F.sum("m").alias("with_positive"))
