"""Naming candidates, pools, and rankings made of picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.diffs import lines, stripped, told
from ..functions.parsing import show_author, show_date, show_diff

# The tags of a candidate's files in its line, and their short names.
SHORT_TAGS = {"source": "src", "test": "test", "doc": "doc", "fixture": "bin", "config": "cfg"}


def _begun(asked: DataFrame, pool: DataFrame, *more: str) -> DataFrame:
    """(ask_id, more, doc_id): ids of asked's (ask_id, query_id, p) queries in pool (query_id, doc_id) that begin with p, in any case.

    Ids are cut to the lengths that their query asks for, and joined to the asks by equality, so no ask meets the ids
    that it doesn't name.
    """
    lengths = asked.select("query_id", F.length("p").alias("n")).distinct()
    cut = pool.join(lengths, "query_id").where(F.length("doc_id") >= F.col("n")).select("query_id", F.left(F.lower("doc_id"), F.col("n")).alias("p"), "doc_id")
    return asked.select("ask_id", "query_id", "p").join(cut, ["query_id", "p"]).select("ask_id", *more, "doc_id")


def resolve(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ask_id, doc_id or null) for asked (ask_id, query_id, part) among candidates (query_id, position, doc_id string).

    Digits alone (at most three), or after any # and blanks, are a position;
    anything else is an id in lower case, or else the beginning of exactly one
    id in any case. A position out of range, however large, stays unresolved,
    and so do blank asks.
    """
    part = F.lower(F.trim("part"))
    digits = F.trim(F.regexp_replace(part, "^#+", ""))
    placed = digits.rlike("^[0-9]+$") & (part.startswith("#") | (F.length(digits) <= 3))
    asked = asked.withColumn("p", part).withColumn("placed", F.coalesce(placed, F.lit(False))).withColumn("at", F.when(placed, digits.try_cast("long")))
    by_place = asked.where("placed").join(candidates, (asked.query_id == candidates.query_id) & (F.col("at") == F.col("position")), "left").select("ask_id", "doc_id")
    rest = asked.where("not placed")
    met = _begun(rest.where("p <> ''"), candidates).join(rest.select("ask_id", "p"), "ask_id")
    found = met.groupBy("ask_id").agg(F.max(F.when(F.col("doc_id") == F.col("p"), F.col("doc_id"))).alias("exact"), F.count("*").alias("n"), F.min("doc_id").alias("one"))
    return by_place.unionByName(rest.select("ask_id").join(found, "ask_id", "left").select("ask_id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("doc_id")))


def resolve_either(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """(ask_id, doc_id or null) of asked (ask_id, query_id, part) in pool (query_id, doc_id), in any case.

    An id equal to the part (the least of several), else the one that begins with the part or that the part begins
    with; blank asks, and those that several answer, stay unresolved.
    """
    text = asked.select("ask_id", "query_id", F.lower(F.trim("part")).alias("p")).where("p <> ''")
    # Both directions are joins by equality: on ids cut to a part's length, and on parts cut to an id's.
    longer = _begun(text, pool, "p")
    lengths = pool.select("query_id", F.length("doc_id").alias("n")).distinct()
    cut = text.join(lengths, "query_id").where((F.length("p") > F.col("n")) & (F.col("n") > 0)).select("ask_id", "query_id", "p", F.left("p", F.col("n")).alias("d"))
    shorter = cut.join(pool.select("query_id", F.lower("doc_id").alias("d"), "doc_id"), ["query_id", "d"]).select("ask_id", "p", "doc_id")
    # Every ask goes along as a row of its own, so one grouping answers them and nothing is joined again.
    none = asked.select("ask_id", F.lit(None).cast("string").alias("p"), F.lit(None).cast(pool.schema["doc_id"].dataType).alias("doc_id"))
    met = none.unionByName(longer).unionByName(shorter)
    found = met.groupBy("ask_id").agg(F.min(F.when(F.lower("doc_id") == F.col("p"), F.col("doc_id"))).alias("exact"), F.count("doc_id").alias("n"), F.min("doc_id").alias("one"))
    return found.select("ask_id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("doc_id"))


def match_path(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(ask_id, path, tier): the first file equal to the asked path, else equal in any case, else the first that ends in its base name."""
    # A path that stands again later is never the first, and asks of one text have one answer: each is taken once.
    # All tiers are joins by equality, the last on endings of the lengths that base names of the same doc_id have.
    once = files.groupBy("doc_id", "path").agg(F.min("position").alias("position"))
    texts = asked.select("doc_id", "asked").distinct().select("doc_id", "asked", F.substring_index("asked", "/", -1).alias("base"))
    place = lambda tier: F.struct(F.lit(tier).alias("tier"), "position", "path")
    low = once.groupBy("doc_id", F.lower("path").alias("low")).agg(F.min(place(2)).alias("x"))
    bases = texts.select("doc_id", "base").distinct()
    lengths = bases.select("doc_id", F.length("base").alias("n")).distinct()
    ends = once.join(lengths, "doc_id").where(F.length("path") >= F.col("n")).select("doc_id", F.when(F.col("n") > 0, F.right("path", F.col("n"))).otherwise("").alias("base"), place(3).alias("x"))
    found = (
        texts.join(once.withColumnRenamed("path", "asked"), ["doc_id", "asked"]).select("doc_id", "asked", F.struct(F.lit(1).alias("tier"), "position", F.col("asked").alias("path")).alias("x"))
        .unionByName(texts.withColumn("low", F.lower("asked")).join(low, ["doc_id", "low"]).select("doc_id", "asked", "x"))
        .unionByName(texts.join(ends.groupBy("doc_id", "base").agg(F.min("x").alias("x")), ["doc_id", "base"]).select("doc_id", "asked", "x"))
    )
    best = found.groupBy("doc_id", "asked").agg(F.min("x").alias("x"))
    return asked.join(best, ["doc_id", "asked"]).select("ask_id", "x.path", "x.tier")


def fill_empty(rows: DataFrame, more: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with their empty columns filled from `more`, by key."""
    side = more.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"), F.lit(""))
    return rows.join(side, key, "left").withColumns({c: value(c) for c in columns}).drop(*(f"__{c}" for c in columns))


def keep_lowest_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("rank")
    return rows.withColumn("__i", F.row_number().over(order)).where("__i = 1").drop("__i")


def review_pool(ranking: DataFrame, picks: DataFrame, inspected: DataFrame, extra: int) -> DataFrame:
    """(query_id, doc_id, new_rank): the pick, then what was inspected (query_id, doc_id, at) in its order, then the best of the ranking, 1 + extra in all.

    The limit is tested after each inspected one is added, so where there is a pick the first inspected one comes
    in whatever the limit. What isn't ranked is not in the pool.
    """
    seen = inspected.groupBy("query_id", "doc_id").agg(F.min("at").alias("at"))
    rows = ranking.join(picks.select("query_id", "doc_id", F.lit(True).alias("is_pick")).distinct(), ["query_id", "doc_id"], "left").join(seen, ["query_id", "doc_id"], "left")
    tier = F.when(F.col("is_pick"), 0).when(F.col("at").isNotNull(), 1).otherwise(2)
    own = Window.partitionBy("query_id")
    rows = rows.withColumn("tier", tier).withColumn("i", F.row_number().over(own.orderBy("tier", F.when(F.col("tier") == 1, F.col("at")), "rank")))
    rows = rows.withColumn("forced", (F.col("tier") == 1) & (F.col("i") == 2) & (F.min("tier").over(own) == 0))
    chosen = rows.where((F.col("i") <= 1 + extra) | F.col("forced"))
    return chosen.withColumn("new_rank", F.row_number().over(own.orderBy("rank"))).select("query_id", "doc_id", "new_rank")


def compose(best: Column, seen: Column, ranking: Column | None = None, k: int | None = 10) -> Column:
    """The pick if there is one, what was seen, then the rest of the ranking; the pick and the ranking never repeat, at most k (all for None)."""
    none = F.array().cast("array<string>")
    pick = F.when(best.isNull() | (best == ""), none).otherwise(F.array(best))
    mine = F.concat(pick, F.filter(F.coalesce(seen, none), lambda x: ~F.array_contains(pick, x)))
    full = mine if ranking is None else F.concat(mine, F.filter(F.coalesce(ranking, none), lambda x: ~F.array_contains(mine, x)))
    return full if k is None else F.slice(full, 1, k)


def manifest(rows: DataFrame, places: int | None = None) -> DataFrame:
    """(query_id, manifest): a line or two for each candidate (query_id, rank, doc_id, message, files or null where its content is absent).

    Ranks are padded to four places and written whole; with `places`, in a field of exactly that many, whose first digits a longer rank keeps.
    """
    head = F.get(lines(stripped(F.coalesce("message", F.lit("")))), F.lit(0))
    head = F.coalesce(F.nullif(head, F.lit("")), F.lit("(empty msg)"))
    head = F.when(F.length(head) > 80, F.concat(F.left(head, F.lit(77)), F.lit("..."))).otherwise(head)
    count = lambda t: F.size(F.filter("files", lambda f: f["tag"] == t))
    tags = F.concat_ws("/", *(F.when(count(t) > 0, told(count(t), short)) for t, short in SHORT_TAGS.items()))
    number = F.col("rank").cast("string")
    start = told("  #", F.lpad(number, F.greatest(F.length(number), F.lit(4)) if places is None else F.lit(places), " "), "  ", F.left("doc_id", F.lit(12)), "  ")
    known = told(start, '"', head, '"\n            files: ', F.size("files"), " (", F.coalesce(F.nullif(tags, F.lit("")), F.lit("0 files")), ")")
    line = F.when(F.col("files").isNull(), told(start, "[commit not found in repo2commits_diff]")).otherwise(known)
    out = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return out.select("query_id", told("Top-", F.size("x"), " candidates from Phase 1:\n\n", F.array_join("x.line", "\n")).alias("manifest"))


def single_pick(pick: Column) -> Column:
    return F.filter(F.array(pick), lambda x: x.isNotNull() & (x != ""))


def pair_ranking(pairs: DataFrame) -> DataFrame:
    """Ranks classifier answers: yes by confidence, then no by low confidence, then none; ties by position."""
    group = F.when(F.col("answer"), 1).when(~F.col("answer"), 0).otherwise(-1)
    signed = F.when(F.col("answer"), F.col("confidence")).when(~F.col("answer"), -F.col("confidence")).otherwise(0)
    order = Window.partitionBy("query_id").orderBy(F.desc(group), F.desc(signed), "position")
    return pairs.withColumn("rank", F.row_number().over(order))


def position_score(position: Column, n: Column) -> Column:
    """Scores of a listwise order: (n - i) / n, i from 0."""
    return (n - position + 1) / n


def nest(ranking: DataFrame, keep: int = -1) -> DataFrame:
    """(query_id, num_candidates, candidates): ordered array of structs; keep -1 for all, 0 for none."""
    fields = [c for c in ranking.columns if c != "query_id"]
    rows = ranking.groupBy("query_id").agg(F.count("*").alias("num_candidates"), F.array_sort(F.collect_list(F.struct("rank", *(c for c in fields if c != "rank")))).alias("candidates"))
    return rows if keep < 0 else rows.withColumn("candidates", F.slice("candidates", 1, keep))


def first_stage_records(items: DataFrame, ranking: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 100), keep: int = -1) -> DataFrame:
    """The record of each item's first stage, nested as it is written out.

    items (query_id, owner, repo, fix_commit_ids), ranking (query_id, doc_id, rank, score, source, bm25_rank,
    dense_rank, datetime). (query_id, owner, repo, repo_key, fix_commit_ids, best_rank, recall, fix_ranks,
    num_candidates, saved_candidates_k, candidates): best_rank, recall (k -> whether a true one is among the first k)
    and fix_ranks (every true one) come from the whole ranking; only candidates is cut at keep, -1 for all and 0 for
    none. Items without a ranking or a truth have a record too, without ranks.
    """
    row = F.struct("rank", F.col("doc_id").alias("commit_id"), "score", "source", "bm25_rank", "dense_rank", "datetime")
    listed = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    kind = listed.schema["all"].dataType.simpleString()
    truth = F.coalesce("fix_commit_ids", F.array().cast("array<string>"))
    out = items.join(listed, "query_id", "left").withColumn("all", F.coalesce("all", F.array().cast(kind)))
    out = out.withColumn("true", F.filter("all", lambda c: F.array_contains(truth, c["commit_id"]))).withColumn("best_rank", F.array_min(F.transform("true", lambda c: c["rank"])))
    recall = F.map_from_arrays(F.array(*(F.lit(f"@{k}") for k in ks)), F.array(*(F.coalesce(F.col("best_rank") <= k, F.lit(False)) for k in ks)))
    n = F.size("all")
    saved = n if keep < 0 else F.least(F.lit(keep), n)
    return out.select(
        "query_id", "owner", "repo", F.concat_ws("@@", "owner", "repo").alias("repo_key"), "fix_commit_ids", "best_rank", recall.alias("recall"),
        F.transform("true", lambda c: F.struct(c["commit_id"].alias("commit_id"), c["rank"].alias("rank"), c["score"].alias("score"), c["bm25_rank"].alias("bm25_rank"), c["dense_rank"].alias("dense_rank"))).alias("fix_ranks"),
        n.alias("num_candidates"), saved.alias("saved_candidates_k"), F.slice("all", F.lit(1), saved).alias("candidates"),
    )


def unnest(records: DataFrame) -> DataFrame:
    return records.select("query_id", F.inline("candidates"))


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(position).alias("first_position"))


def round_robin(rows: DataFrame, order: list, shards: int) -> DataFrame:
    """rows with shard = (place - 1) mod shards, places by `order` over the whole table (one row per unit of work)."""
    return rows.withColumn("shard", ((F.row_number().over(Window.orderBy(*order)) - 1) % shards).cast("int"))


def from_scores(queries: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of the score files (repo_key, query_id, doc_id, position, score) of queries (query_id, repo_key).

    Ties keep the file's order. Queries without a file have no rows.
    """
    own = scores.join(queries.select("query_id", "repo_key").distinct(), ["repo_key", "query_id"], "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def resolve_answers(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ask_id, doc_id or null) of answers (ask_id, query_id, number, hash) among candidates (query_id, rank, doc_id).

    The candidate of that rank, else the first whose id begins with the hash.
    """
    by_rank = answers.join(candidates, (answers.query_id == candidates.query_id) & (answers.number == candidates["rank"])).select("ask_id", F.lit(0).alias("tier"), "rank", "doc_id")
    hashed = answers.where("hash <> ''").select("ask_id", "query_id", F.col("hash").alias("p"))
    lengths = hashed.select("query_id", F.length("p").alias("n")).distinct()
    cut = candidates.join(lengths, "query_id").where(F.length("doc_id") >= F.col("n")).select("query_id", F.left("doc_id", F.col("n")).alias("p"), "rank", "doc_id")
    by_hash = hashed.join(cut, ["query_id", "p"]).select("ask_id", F.lit(1).alias("tier"), "rank", "doc_id")
    best = by_rank.unionByName(by_hash).groupBy("ask_id").agg(F.min_by("doc_id", F.struct("tier", "rank")).alias("doc_id"))
    return answers.select("ask_id").join(best, "ask_id", "left")


def rank_of(picks: DataFrame, ranking: DataFrame) -> DataFrame:
    """picks (query_id, doc_id) with first_rank, the pick's rank in the ranking; null where it isn't there."""
    return picks.join(ranking.select("query_id", "doc_id", F.col("rank").alias("first_rank")), ["query_id", "doc_id"], "left")


def of_sample(records: DataFrame, sample: DataFrame, key: str = "query_id") -> DataFrame:
    """Records of a sample's queries, one row per candidate."""
    return records.join(sample.select(key).distinct(), key, "left_semi").select(key, F.inline("candidates"))


def extended(records: DataFrame, ranking: DataFrame, k: int | None = 10) -> DataFrame:
    """(query_id, doc_id, rank): rankings of selection records (query_id, best, inspected), extended by a first stage's (query_id, doc_id, rank)."""
    order = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    full = compose(F.col("best"), F.col("inspected"), F.col("r.doc_id"), k)
    return records.join(order, "query_id", "left").select("query_id", F.posexplode(full).alias("i", "doc_id")).select("query_id", "doc_id", (F.col("i") + 1).alias("rank"))


def pair_items(pairs: DataFrame) -> DataFrame:
    """One item for each query of a pair table (cve, desc, repo, commit_id, commit_message, diff, label, rank).

    (query_id, description, owner, repo, fix_commit_ids, candidates): candidates by rank, each id once, with the
    message, the diff without its header, author and date.
    """
    text, id_ = F.coalesce("diff", F.lit("")), F.col("commit_id")
    rows = pairs.select(
        F.col("cve").alias("query_id"), "desc", F.col("repo").alias("full"), id_, "rank", "label", F.coalesce("commit_message", F.lit("")).alias("message"),
        show_diff(text).alias("diff"), show_author(text).alias("author"), show_date(text).alias("date"),
    )
    each = rows.groupBy("query_id", "commit_id").agg(F.min_by(F.struct("rank", "commit_id", "message", "diff", "author", "date"), "rank").alias("c"), F.max("label").alias("label"), F.min(F.struct("rank", "desc", "full")).alias("head"))
    out = each.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("candidates"), F.array_sort(F.collect_set(F.when(F.col("label") == 1, F.col("commit_id")))).alias("fix_commit_ids"), F.min("head").alias("head"))
    full, cut = F.col("head.full"), F.instr(F.col("head.full"), "/")
    owner, repo = F.when(cut > 0, F.left(full, cut - 1)).otherwise(""), F.when(cut > 0, F.substring(full, cut + 1, F.length(full))).otherwise(full)
    return out.select("query_id", F.coalesce("head.desc", F.lit("")).alias("description"), owner.alias("owner"), repo.alias("repo"), "fix_commit_ids", "candidates")


#: The methods whose records make rankings.
METHODS = ("pairs", "selection", "single")


def method_rankings(method: str, records: DataFrame, ranking: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, rank) of a method's records, from however many files they were read.

    pairs: per-pair answers (query_id, doc_id, answer, confidence, position); single: picks (query_id, best);
    selection: (query_id, best, inspected), extended by a first stage's ranking if given.
    """
    if method == "pairs":
        return pair_ranking(records).select("query_id", "doc_id", "rank")
    if method == "single":
        return records.select("query_id", F.explode(single_pick(F.col("best"))).alias("doc_id"), F.lit(1).alias("rank"))
    if method != "selection":
        raise ValueError(f"no such method: {method}; there are pairs, selection, single")
    if ranking is not None:
        return extended(records, ranking)
    return records.select("query_id", F.posexplode(compose(F.col("best"), F.col("inspected"), None, None)).alias("i", "doc_id")).select("query_id", "doc_id", (F.col("i") + 1).alias("rank"))
