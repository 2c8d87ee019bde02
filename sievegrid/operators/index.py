"""A kept inverted index of the documents of each repository, for BM25.

Four tables under one path, each partitioned by repo_key and batch:

    postings  (term, doc_id, tf, size): sorted by term in files that hold whole documents
    terms     (term, df)                stats (n, size)                docs (doc_id)

A text is tokenised once, when its document is added. Adding is in batches: only
documents that the index lacks go in, and `docs` is written last, so a batch
without its `docs` is a run that was lost, counts for nothing, and is written
again under its name. A search reads the statistics, and those postings whose
term is asked for in their repository; it reads no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import exists, write_by_repo
from .lexical import K1, B, ranked, tokens

_TABLES = {"postings": "term STRING, doc_id {id}, tf INT, size INT", "terms": "term STRING, df BIGINT", "stats": "n BIGINT, size BIGINT", "docs": "doc_id {id}"}


def _read(spark: SparkSession, path: str, table: str, kind: str) -> DataFrame:
    """A table's rows, of batches that were written whole."""
    rows = spark.read.schema(_TABLES[table].format(id=kind) + ", repo_key STRING, batch STRING").parquet(f"{path}/{table}")
    return rows if table == "docs" else rows.join(whole_batches(spark, path, kind), ["repo_key", "batch"], "left_semi")


def whole_batches(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """(repo_key, batch) that `docs` has; from the names of its partitions."""
    return _read(spark, path, "docs", kind).select("repo_key", "batch").distinct()


def add(docs: DataFrame, path: str, batch: str, by: str = "repo_key") -> None:
    """Adds those of docs (doc_id, repo_key, text; ids unique in a repository) that the index lacks, as a batch.

    A batch of a name that stands already replaces it, in the repositories that it has documents of, once all
    it held is among docs; names are best never used again, unless to repeat a lost run. A document without a
    repository or id is left out; a null text has no terms, and counts as a document.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col(by).cast("string").alias("repo_key"), "doc_id", "text").where(F.col("doc_id").isNotNull() & (F.col("repo_key") != ""))
    if exists(spark, f"{path}/docs"):
        held = _read(spark, path, "docs", kind).where(F.col("batch") != batch).select("repo_key", "doc_id")
        rows = rows.join(held, ["repo_key", "doc_id"], "left_anti")
    named = F.lit(batch).alias("batch")
    # A document's terms are counted inside its row, so neither texts nor their tokens are shuffled, and a file holds documents whole.
    # explode(array(...)) keeps Spark from writing an array's expression into the lambdas that read it, once per element.
    words = rows.select("repo_key", "doc_id", F.explode(F.array(F.sort_array(tokens(F.col("text"))))).alias("t")).withColumn("size", F.size("t"))
    new_term = lambda i: F.get("t", i - 1).isNull() | (F.get("t", i) != F.get("t", i - 1))
    words = words.where("size > 0").select("*", F.explode(F.array(F.filter(F.sequence(F.lit(0), F.col("size") - 1), new_term))).alias("at"))
    counted = F.transform("at", lambda x, i: F.struct(F.get("t", x).alias("term"), (F.coalesce(F.get("at", i + 1), F.col("size")) - x).alias("tf")))
    postings = words.select("repo_key", "doc_id", "size", counted.alias("items")).select("repo_key", "doc_id", "size", F.explode("items").alias("p")).select("repo_key", "doc_id", "size", "p.term", "p.tf")
    by_batch = ("repo_key", "batch")
    write_by_repo(postings.select("term", "doc_id", "tf", "size", "repo_key", named), f"{path}/postings", ("term", "doc_id"), by_batch)
    # What follows comes from the postings just written, so texts are read and tokenised once.
    new = spark.read.schema(_TABLES["postings"].format(id=kind) + ", repo_key STRING, batch STRING").parquet(f"{path}/postings").where(F.col("batch") == batch)
    write_by_repo(new.groupBy("repo_key", "batch", "term").agg(F.count("*").alias("df")).select("term", "df", *by_batch), f"{path}/terms", ("term",), by_batch)
    sizes = new.groupBy("repo_key", "batch", "doc_id").agg(F.first("size").cast("long").alias("size")).groupBy("repo_key").agg(F.sum("size").alias("size"))
    counts = rows.groupBy("repo_key").agg(F.count("*").alias("n")).join(sizes, "repo_key", "left")
    write_by_repo(counts.select("n", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "repo_key", named), f"{path}/stats", ("n",), by_batch)
    write_by_repo(rows.select("doc_id", "repo_key", named), f"{path}/docs", ("doc_id",), by_batch)


def search(spark: SparkSession, path: str, queries: DataFrame, top: int | None = 10_000, k1: float = K1, b: float = B, digits: int = 6, doc_kind: str = "string") -> DataFrame:
    """(query_id, doc_id, score, rank) of queries (query_id, repo_key, text) among their repository's documents, from the index alone.

    As `lexical.bm25(..., by="repo_key")`: any term of a query matches, ties go to the smaller doc_id. doc_kind is
    the type of the ids that the index was made with. Scores are summed where postings lie, before anything moves.
    """
    asked = queries.where("repo_key <> ''").select("query_id", F.col("repo_key").cast("string").alias("repo_key"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = asked.select("repo_key", "term").distinct()
    stats = _read(spark, path, "stats", doc_kind).groupBy("repo_key").agg(F.sum("n").alias("n"), F.sum("size").alias("total"))
    df = _read(spark, path, "terms", doc_kind).join(wanted, ["repo_key", "term"], "left_semi").groupBy("repo_key", "term").agg(F.sum("df").alias("df"))
    mean = F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0)
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df.join(stats, "repo_key").select("repo_key", "term", idf.alias("idf"), mean.alias("mean")), ["repo_key", "term"])
    postings = _read(spark, path, "postings", doc_kind).select("repo_key", "term", "doc_id", "tf", "size")
    weight = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    met = postings.join(weighed, ["repo_key", "term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), digits).alias("score"))
    return ranked(met.where("score > 0"), ["query_id"], [F.desc("score"), F.col("doc_id")], top)
