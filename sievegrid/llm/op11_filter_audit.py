"""Audit of how text filters interact, over every order of applying them.

Words are exploded, counted by (document, word) and then by document for totals
and distinct words; the other conditions come from their own scan and are joined
on. Which of the five filters a document fails makes a number of 0 to 31, and 32
conditional counts for each part say all that any order of the filters can do:
what a step keeps and removes, what an earlier step removed already, what no
other filter removes, and each filter's share over all 120 orders.

    A  under 200 words                      B  100 * distinct words < 50 * words
    C  100 * [A-Z] > 3 * code points        D  holds any of # $ % & * |
    E  the text of a document with a smaller id

Texts move once, dealt out by document, so that both aggregations stand on that
exchange; E moves digests only, and joins on (text digest, id), which no group
of copies makes hot. Rows that agree in id, part and text are one class with a
size before anything else.

Cases: a null text counts as empty, a null part as the empty string; an empty
text has no words, fails A and no other but E; a null id is smaller than none, so
such rows never fail E and make none fail; labels that repeat an id say yes if
any of them does, missing and null labels say no; repeated rows count each;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = 1 << len(FILTERS)


def _classes(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(id, k, part, text): k tells rows of one id apart; rows without one are told apart by 128 bits."""
    text, part = F.coalesce(text, F.lit("")), F.coalesce(F.col(part).cast("string"), F.lit(""))
    own = F.col(key).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.xxhash64(F.lit(1), text)).alias("id"), F.xxhash64(own.isNull(), part, text).alias("k"), part.alias("part"), text.alias("text"))


def word_counts(classes: DataFrame) -> DataFrame:
    """(id, k, words, distinct) of each class that has words."""
    once = classes.groupBy("id", "k").agg(F.any_value("text").alias("text"))
    words = once.select("id", "k", F.explode(F.split("text", SPACE)).alias("word")).where(F.col("word") != "")
    by_word = words.groupBy("id", "k", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("id", "k").agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, own, part, rows, fails): classes of equal rows with their number, and the filters that they fail as bits, A the lowest.

    own: whether id is the documents' own, and not made for rows without one.
    """
    classes = _classes(docs, key, text, part)
    flags = classes.select(
        "doc_id", "id", "k", "part", F.sha2("text", 256).alias("digest"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text")).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"),
    ).groupBy("doc_id", "id", "k", "part", "digest").agg(F.count("*").alias("rows"), F.max("c").alias("c"), F.max("d").alias("d"))
    # The first of each text, by id; any other row with an id is a copy of it.
    first = flags.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = flags.join(first, ["digest", "doc_id"], "left").withColumn("e", F.col("doc_id").isNotNull() & F.col("first").isNull())
    both = flags.join(word_counts(classes), ["id", "k"], "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = [words < 200, 100 * distinct < 50 * words, F.col("c"), F.col("d"), F.col("e")]
    return both.select("id", F.col("doc_id").isNotNull().alias("own"), "part", "rows", sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0)).alias("fails"))


def _of(counts: str, wanted) -> Column:
    """The sum of those of the 32 counts whose failures, a column, are wanted."""
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(COUNTS - 1)), wanted), F.lit(0).cast("long"), lambda total, m: total + F.get(counts, m))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step, with what the step does."""
    told = labels.select(F.col(key).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("own", F.lit(True))
    rows = failures(docs, key, text, part).join(told, ["id", "own"], "left")

    def counts(of: Column, name: str) -> list[Column]:
        return [F.sum(F.when(of & (F.col("fails") == m), F.col("rows")).otherwise(0)).alias(f"{name}{m}") for m in range(COUNTS)]

    kinds = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    parts = rows.groupBy("part").agg(*(c for name, of in kinds.items() for c in counts(of, name)))
    parts = parts.select("part", *(F.array(*(f"{name}{m}" for m in range(COUNTS))).alias(name) for name in kinds))

    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit_of = F.create_map(*(F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i)))
    steps = steps.withColumn("bits", F.transform(F.split("filter_order", ""), lambda f: F.element_at(bit_of, f))).withColumn("bit", F.get("bits", F.col("step") - 1))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    fails, gone = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    # A document is a filter's own in as many of the 120 orders as the filter comes first among those that it fails.
    shares = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(COUNTS - 1)), fails), F.lit(0).cast("long"), lambda total, m: total + F.get("n", m) * (F.lit(120) / F.bit_count(m)).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        _of("n", lambda m: ~gone(m) & ~fails(m)).alias("kept"), _of("n", here).alias("removed"), _of("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"), _of("good", here).alias("good_lost"), _of("toxic", here).alias("toxic_lost"), shares.alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM d),
c AS (SELECT r, sum(n) AS words, count(*) AS dist FROM (SELECT r, w, count(*) AS n FROM w GROUP BY ALL) GROUP BY r),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, unnest([
    struct_pack(f := 'A', x := coalesce(words, 0) < 200), struct_pack(f := 'B', x := coalesce(100 * dist < 50 * words, false)),
    struct_pack(f := 'C', x := 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)), struct_pack(f := 'D', x := regexp_matches(t, '[#$%&*|]')),
    struct_pack(f := 'E', x := coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false))]) AS u, r
  FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, r, any_value(good) AS good, any_value(toxic) AS toxic, coalesce(string_agg(u.f, '' ORDER BY u.f) FILTER (WHERE u.x), '') AS fails FROM f GROUP BY ALL
), n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || s.x || t.x || u.x AS filter_order FROM a p, a q, a s, a t, a u WHERE p.x NOT IN (q.x, s.x, t.x, u.x) AND q.x NOT IN (s.x, t.x, u.x) AND s.x NOT IN (t.x, u.x) AND t.x <> u.x),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS it, filter_order[1:step - 1] AS before FROM o, range(1, 6) g(step)),
j AS (
  SELECT *, contains(fails, it) AS fail, len(list_intersect(string_split(fails, ''), CASE WHEN before = '' THEN ['-'] ELSE string_split(before, '') END)) > 0 AS gone FROM n, s
), k AS (
  SELECT part, filter_order, step, it, sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = it THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fail AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, it) AS BIGINT) AS shapley
FROM k
"""
