"""BM25 over one or two text fields, and scores blended with nearness in time."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_batches

#: Defaults of published BM25.
K1, B = 1.2, 0.75
#: Queries whose terms are sent to all tasks; more are taken in parts. Scores of a block of documents held at once.
QUERY_BLOCK, GRID = 4096, 4_000_000


def tokens(text: Column) -> Column:
    """Runs of letters, marks, digits and underscores, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+"), lambda x: x != "")


class _Asked:
    """The terms that queries ask for, by group: sorted keys (group, term), and the queries of each."""

    def __init__(self, rows: pa.Table):
        query, group, term = (rows[c].combine_chunks().dictionary_encode() for c in ("query_id", "g", "term"))
        self.queries, self.groups, self.terms = query.dictionary, group.dictionary, term.dictionary
        key = group.indices.to_numpy().astype(np.int64) * len(self.terms) + term.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        self.query = query.indices.to_numpy()[order]
        self.keys, self.first, self.size = np.unique(key[order], return_index=True, return_counts=True)

    def postings(self, group: pa.Array, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place in keys, frequency) of a batch's terms that its documents' groups ask for."""
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(size)), size)
        g = pc.fill_null(pc.index_in(group, self.groups), -1).to_numpy()
        t = pc.fill_null(pc.index_in(words.flatten(), self.terms), -1).to_numpy()
        some = (t >= 0) & (g[doc] >= 0)
        doc, key = doc[some], g[doc[some]].astype(np.int64) * len(self.terms) + t[some]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        some = self.keys[at] == key
        pair, tf = np.unique(doc[some] * len(self.keys) + at[some], return_counts=True)
        return pair // len(self.keys), pair % len(self.keys), tf


def bm25(docs: DataFrame, queries: DataFrame, top: int | None = 10_000, k1: float = K1, b: float = B, digits: int = 6, by: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) for docs (doc_id, text) and queries (query_id, text); any query term matches.

    With `by`, a column of both (a repository), queries meet the documents of
    their own group only, and each group has its own corpus statistics.

    The queries' terms are sent to the documents: one pass counts the
    statistics, a second multiplies blocks of documents with the queries, and
    only each block's `top` per query leave it, so neither texts nor the
    postings of common words are shuffled. Ties go to the smaller doc_id; null
    texts have no terms, and count as documents.
    """
    small_batches(docs.sparkSession)
    n = queries.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    group = F.col(by).cast("string") if by else F.lit("")
    words = docs.select("doc_id", group.alias("g"), tokens(F.col("text")).alias("t"))
    out = None
    for i in range(parts):
        part = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        found = _bm25_part(words, part.select("query_id", group.alias("g"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), top, k1, b, digits)
        out = found if out is None else out.unionByName(found)
    return ranked(out, ["query_id"], [F.desc("score"), F.col("doc_id")], top)


def _bm25_part(words: DataFrame, terms: DataFrame, top: int | None, k1: float, b: float, digits: int) -> DataFrame:
    spark, kinds = words.sparkSession, (terms.schema["query_id"].dataType.simpleString(), words.schema["doc_id"].dataType.simpleString())
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    asked = _Asked(terms.where("g is not null").toArrow())
    if not len(asked.keys):
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(asked)

    def count(batches):
        a = sent.value
        for x in batches:
            _, at, _ = a.postings(x.column(0), x.column(1))
            g = pc.fill_null(pc.index_in(x.column(0), a.groups), -1).to_numpy()
            size = pc.list_value_length(x.column(1)).to_numpy(zero_copy_only=False)
            key, df = np.unique(at, return_counts=True)
            known = np.unique(g[g >= 0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(len(key), np.int32), np.full(len(known), 1, np.int32)])), pa.array(np.concatenate([key, known]).astype(np.int64)),
                    pa.array(np.concatenate([df, [(g == i).sum() for i in known]]).astype(np.int64)), pa.array(np.concatenate([np.zeros(len(key)), [size[g == i].sum() for i in known]]).astype(np.int64)),
                ],
                ["kind", "at", "n", "size"],
            )

    # One row for each asked term and group.
    counted = words.select("g", "t").mapInArrow(count, "kind int, at long, n long, size long").groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).toArrow()
    kind, at, number, size = (counted[c].to_numpy() for c in ("kind", "at", "n", "size"))
    docs_of, mean_of, df = np.zeros(len(asked.groups)), np.ones(len(asked.groups)), np.zeros(len(asked.keys))
    df[at[kind == 0]] = number[kind == 0]
    docs_of[at[kind == 1]] = number[kind == 1]
    mean_of[at[kind == 1]] = size[kind == 1] / number[kind == 1]
    own = asked.keys // len(asked.terms)
    idf = np.log(1 + (docs_of[own] - df + 0.5) / (df + 0.5))
    weights = spark.sparkContext.broadcast((idf, np.where(mean_of == 0, 1.0, mean_of)[own]))

    def score(batches):
        a, (idf, mean) = sent.value, weights.value
        n = len(a.queries)
        floor = np.zeros(n)
        for whole in batches:
            step = max(1, GRID // n)
            for i in range(0, whole.num_rows, step):
                x = whole.slice(i, step)
                doc, at, tf = a.postings(x.column(1), x.column(2))
                size = pc.list_value_length(x.column(2)).to_numpy(zero_copy_only=False)
                w = idf[at] * tf / (tf + k1 * (1 - b + b * size[doc] / mean[at]))
                count = a.size[at]
                ends = np.cumsum(count)
                place = np.arange(int(count.sum())) - np.repeat(ends - count, count) + np.repeat(a.first[at], count)
                grid = np.bincount(np.repeat(doc, count) * n + a.query[place], weights=np.repeat(w, count), minlength=x.num_rows * n).astype(float).reshape(-1, n).T
                yield _best(grid, a.queries, x.column(0), top, digits, 0.0, floor)

    return words.mapInArrow(score, schema)


def _best(grid: np.ndarray, queries: pa.Array, docs: pa.Array, top: int | None, digits: int, above: float, floor: np.ndarray | None = None) -> pa.RecordBatch:
    """The best of a grid of scores (queries by documents), ties with the last of them included.

    floor, of a task's grids so far: the most that any of them has as a query's `top`-th score; what is below it is none of the best.
    """
    grid = np.round(grid, digits)
    keep = grid > above
    if top is not None and top < grid.shape[1]:
        last = np.partition(grid, grid.shape[1] - top, axis=1)[:, grid.shape[1] - top]
        if floor is not None:
            last = np.maximum(floor, last, out=floor)
        keep &= grid >= last[:, None]
    q, d = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([queries.take(pa.array(q)), docs.take(pa.array(d)), pa.array(grid[q, d])], ["query_id", "doc_id", "score"])


def ranked(df: DataFrame, by: list[str], order: list[Column], top: int | None = None, rank: str = "rank") -> DataFrame:
    """df with 1-based ranks per `by`; with `top`, only that many (planned as a partial and a final group limit)."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if top is None else out.where(F.col(rank) <= top)


def by_max(score: Column, *by: str) -> Column:
    """Score divided by its group's maximum, which counts as 1 when it is 0 or absent."""
    top = F.max(score).over(Window.partitionBy(*by))
    return score / F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0))


def decay(at: Column, anchor: Column) -> Column:
    return 1 / (1 + 2 * F.abs(at - anchor))


def field_hybrid(first: DataFrame, second: DataFrame, times: DataFrame, anchors: DataFrame, weights=(0.35, 0.15, 0.30, 0.20)) -> DataFrame:
    """(query_id, doc_id, score, rank): two fields' BM25, and nearness in commit order to two dates.

    first, second: rankings; times (doc_id, ts); anchors (query_id, early, late).
    A candidate is what either field found; its place is its index by time
    among the query's candidates, those without a time first.
    """
    a = first.select("query_id", "doc_id", F.col("score").alias("a"))
    b = second.select("query_id", "doc_id", F.col("score").alias("b"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").join(times, "doc_id", "left").join(anchors, "query_id", "left")
    own = Window.partitionBy("query_id")
    both = both.withColumn("i", F.row_number().over(own.orderBy(F.asc_nulls_first("ts"), "doc_id")) - 1).withColumn("n", F.count("*").over(own))
    for name in ("early", "late"):
        both = both.withColumn(f"{name}_i", forward_index(F.col(name), F.col("ts"), F.col("i"), F.col("n"), own))
    score = (
        weights[0] * by_max(F.coalesce("a", F.lit(0.0)), "query_id") + weights[1] * by_max(F.coalesce("b", F.lit(0.0)), "query_id")
        + weights[2] * decay(F.col("i"), F.col("early_i")) + weights[3] * decay(F.col("i"), F.col("late_i"))
    )
    return ranked(both.select("query_id", "doc_id", F.round(score, 6).alias("score")), ["query_id"], [F.desc("score"), F.col("doc_id")])


def forward_index(date: Column, ts: Column, index: Column, n: Column, own) -> Column:
    """Index of the first row at or after date in its group; the last if none; the middle without a date."""
    found = F.min(F.when(ts >= date, index)).over(own)
    return F.when(date.isNull(), F.floor(n / 2)).otherwise(F.coalesce(found, n - 1)).cast("long")


def asof_index(rows: DataFrame, probes: DataFrame, by: str) -> DataFrame:
    """(by, probe_id, index): forward as-of of each probe (by, probe_id, date) in rows (by, row_id, ts) by time."""
    own = Window.partitionBy(by).orderBy("ts", "row_id")
    placed = rows.withColumn("i", F.row_number().over(own) - 1)
    sizes = placed.groupBy(by).agg(F.count("*").alias("n"))
    # Rows and probes in one order, latest first: a probe's place is the least index so far. One sort, no pairs.
    events = placed.select(by, F.col("ts").alias("t"), F.lit(0).alias("kind"), F.col("i"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    asked = probes.select(by, F.col("date").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("i"), "probe_id")
    seen = Window.partitionBy(by).orderBy(F.desc_nulls_last("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.unionByName(asked).withColumn("first", F.min("i").over(seen)).where("kind = 1").join(sizes, by)
    index = F.when(F.col("t").isNull(), F.floor(F.col("n") / 2)).otherwise(F.coalesce("first", F.col("n") - 1))
    return found.select(by, "probe_id", index.cast("long").alias("index"))


def time_rank_score(rows: DataFrame, weights=(0.5, 0.3, 0.2)) -> DataFrame:
    """Blend of reciprocal ordinals: by score, by |early offset| then the first, by |late offset| then the second.

    rows: (query_id, doc_id, score, early, late); ties of score go to the smaller doc_id.
    """
    own = Window.partitionBy("query_id")
    out = rows.withColumn("o1", F.row_number().over(own.orderBy(F.desc("score"), "doc_id")))
    out = out.withColumn("o2", F.row_number().over(own.orderBy(F.abs("early"), "o1")))
    out = out.withColumn("o3", F.row_number().over(own.orderBy(F.abs("late"), "o2")))
    blend = weights[0] / F.col("o1") + weights[1] / F.col("o2") + weights[2] / F.col("o3")
    return out.select("query_id", "doc_id", (1 / F.col("o1")).alias("rank_score"), (1 / F.col("o2")).alias("early_score"), (1 / F.col("o3")).alias("late_score"), blend.alias("new_score"))


def with_fallback(precomputed: DataFrame, queries: DataFrame, fallback) -> DataFrame:
    """precomputed rankings, and fallback(queries without any) for the rest."""
    missing = queries.join(precomputed.select("query_id").distinct(), "query_id", "left_anti")
    return precomputed.unionByName(fallback(missing))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents that hold an item's whole text, each item (query_id, text).

    The items' texts form one automaton, so a document is read once
    whatever their number; they are few against the documents, and are sent to
    all tasks only up to a bound in number and characters (MOST_ITEMS,
    MOST_CHARS), in parts beyond it. A worker builds an automaton once.
    """
    small_batches(docs.sparkSession)
    heads = items.select("query_id", F.col("text").alias("head")).where("head <> ''")
    n, size = heads.agg(F.count("*"), F.coalesce(F.sum(F.length("head")), F.lit(0))).first()
    parts = max(-(-n // MOST_ITEMS), -(-size // MOST_CHARS))
    out = None
    for i in range(max(1, parts)):
        rows = heads.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts))) == i).toArrow()
        by_head: dict[str, list[int]] = {}
        for q, h in zip(rows["query_id"].to_pylist(), rows["head"].to_pylist(), strict=True):
            by_head.setdefault(h, []).append(q)
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(by_head)), "query_id long, doc_id long")
        out = found if out is None else out.unionByName(found)
    return out


#: Passages searched at once, and their characters.
MOST_ITEMS, MOST_CHARS = 200_000, 32_000_000
#: The last automaton that this worker built, by the number of what was sent.
_BUILT: dict = {}


def _search(sent):
    number = uuid.uuid4().hex

    def automaton():
        import ahocorasick

        if number not in _BUILT:
            find = ahocorasick.Automaton()
            for head, ids in sent.value.items():
                find.add_word(head, ids)
            if sent.value:
                find.make_automaton()
            _BUILT.clear()
            _BUILT[number] = find
        return _BUILT[number]

    def run(batches):
        find = automaton()
        for b in batches:
            pairs = [(q, d) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x and len(find) for q in {q for _, ids in find.iter(x) for q in ids}]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in pairs], pa.int64()), pa.array([d for _, d in pairs], pa.int64())], ["query_id", "doc_id"])

    return run
