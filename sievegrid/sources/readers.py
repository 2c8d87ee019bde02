"""Declared schemas and readers of every input format."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY = "cve STRING, cve_description STRING, owner STRING, repo STRING, fix_commit_ids STRING"
SCORE = "MAP<STRING, STRUCT<datetime STRING, score DOUBLE, repo STRING, publish_diff INT, reserve_time_diff INT, rank_score DOUBLE, reserve_time_diff_rank_score DOUBLE, publish_time_diff_rank_score DOUBLE, new_score DOUBLE>>"
COMMIT = "commit_id STRING, commit_msg STRING, diff STRING, datetime STRING, author STRING, author_email STRING, _corrupt_record STRING"
EMBEDDING = "id STRING, embedding ARRAY<FLOAT>"
PAIR = ("cve", "desc", "repo", "commit_id", "commit_message", "diff", "label", "rank")
DATES = "cve STRING, reserve_time STRING, publish_time STRING"
REPORTS = "cve_id STRING, markdown STRING, error STRING"
PER_PAIR = "input STRUCT<cve: STRING, commit_id: STRING, label: INT>, output STRUCT<answer: BOOLEAN, confidence: INT>"
PHASE_TWO = (
    "cve_id STRING, owner STRING, repo STRING, best_commit_id STRING, reasoning STRING, fix_commit_ids ARRAY<STRING>, hit BOOLEAN, phase1_rank_of_answer INT, best_rank_in_truth_set INT, stopped_reason STRING, "
    "iterations_used INT, commits_inspected ARRAY<STRING>, tool_calls ARRAY<STRUCT<turn: INT, tool: STRING, args: MAP<STRING, STRING>>>, llm_input_tokens BIGINT, llm_output_tokens BIGINT, estimated_cost_usd DOUBLE, wall_time_sec DOUBLE, error STRING"
)


def csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """Quoted fields may hold line breaks and doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def truth_ids(column, trimmed: bool = True):
    """The ids between pipes that aren't empty, in order, with their repeats; trimmed, unless the variant keeps them as they are."""
    parts = F.split(F.coalesce(column, F.lit("")), r"\|")
    return F.filter(F.transform(parts, lambda x: F.trim(x)) if trimmed else parts, lambda x: x != "")


def queries(spark: SparkSession, path, most: int = 0, columns: dict[str, str] | None = None, limit_first: bool = False, trimmed: bool = True) -> DataFrame:
    """(cve_id, description, owner, repo, fix_commit_ids array, repo_key, query_key); rows need all keys, but not a truth: open cases are ranked too.

    columns renames what a variant of the file calls otherwise; `most` counts kept rows, or with limit_first the rows
    of the file. Fields are trimmed unless the variant keeps them as they are.
    """
    rows = csv(spark, path, QUERY)
    for new, old in (columns or {}).items():
        rows = rows.withColumnRenamed(old, new)
    if most and limit_first:
        rows, most = rows.limit(most), 0
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if trimmed else F.coalesce(F.col(c), F.lit(""))
    out = rows.select(text("cve").alias("cve_id"), text("cve_description").alias("description"), text("owner").alias("owner"), text("repo").alias("repo"), truth_ids(F.col("fix_commit_ids"), trimmed).alias("fix_commit_ids"))
    out = out.where("cve_id <> '' and owner <> '' and repo <> ''")
    out = out.withColumn("repo_key", F.concat_ws("@@", "owner", "repo")).withColumn("query_key", F.concat_ws("::", "repo_key", "cve_id"))
    return out.limit(most) if most else out


def queries_by_row(rows: DataFrame) -> DataFrame:
    """Several rows per query (position, cve, owner, repo, patch): first owner and repo, patches in order, each once."""
    return rows.groupBy("cve").agg(
        F.min_by("owner", "position").alias("owner"), F.min_by("repo", "position").alias("repo"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "patch"))), lambda x: x["patch"])).alias("patches"),
    )


def score_files(spark: SparkSession, path, field: str = "new_score", missing: float = float("-inf")) -> DataFrame:
    """(repo_key, query_id, doc_id, position, score, detail) of files <repo key>/bm25_time/result/<query id>.json; empty ones give no rows."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    part = F.split(F.col("path"), "/")
    rows = text.select(F.url_decode(F.element_at(part, -4)).alias("repo_key"), F.regexp_replace(F.element_at(part, -1), r"\.json$", "").alias("query_id"), F.from_json("value", SCORE).alias("m"))
    rows = rows.where("m is not null").select("repo_key", "query_id", F.posexplode(F.map_entries("m")).alias("position", "e"))
    return rows.select("repo_key", "query_id", F.col("e.key").alias("doc_id"), "position", F.coalesce(F.col(f"e.value.{field}"), F.lit(missing)).alias("score"), F.col("e.value").alias("detail"))


def commits(spark: SparkSession, path, columns: tuple[str, ...] = ("commit_id", "commit_msg", "diff", "datetime", "author")) -> DataFrame:
    """(repo_key, *columns, ts): commits of JSON arrays in files split_<repo key>/*.json.

    Bad files and blank ids are left out, author falls back to the address. Of equal ids of one repository the first
    stays, by file and place; repositories that share ids (forks) keep their own. Files elsewhere have an empty repo_key.
    """
    rows = spark.read.json(path, schema=COMMIT, multiLine=True, mode="PERMISSIVE").withColumn("__at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    repo = F.url_decode(F.replace(F.regexp_extract("__at.file_path", r"/split_([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))
    rows = rows.where("_corrupt_record is null and trim(commit_id) <> ''").withColumn("author", F.coalesce(F.nullif("author", F.lit("")), "author_email", F.lit(""))).withColumn("repo_key", repo).withColumn("commit_id", F.trim("commit_id"))
    out = rows.groupBy("repo_key", "commit_id").agg(F.min_by(F.struct(*(c for c in columns if c != "commit_id"), F.col("datetime").alias("__t")), "__at").alias("c"))
    return out.select("repo_key", *(F.coalesce(F.col(c if c == "commit_id" else f"c.{c}"), F.lit("")).alias(c) for c in columns), F.try_to_timestamp("c.__t").alias("ts"))


def content_of(corpus: DataFrame, ids: DataFrame, key: str | list[str] = "commit_id") -> DataFrame:
    """The corpus's rows whose ids are asked for; with repo_key among the key where ids are a repository's own."""
    key = [key] if isinstance(key, str) else list(key)
    return corpus.join(ids.select(*key).distinct(), key, "left_semi")


def embeddings(spark: SparkSession, path, dim: int | None = None) -> DataFrame:
    """(id, embedding); with dim, reading a vector of another length, or null, fails."""
    rows = spark.read.schema(EMBEDDING).parquet(path)
    if dim is None:
        return rows
    right = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return rows.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"not a vector of {dim} values: "), F.coalesce("id", F.lit("null"))))))


def jsonl_strict(spark: SparkSession, path, schema: str = PHASE_TWO) -> DataFrame:
    """Blank lines are skipped, a bad line raises."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def _shards(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The good rows of JSON lines files, with __at: the place of a row, by file in the order given, then by line."""
    rows = spark.read.json(paths, schema=f"{schema}, _corrupt_record STRING", mode="PERMISSIVE")
    qualified = [_qualified(spark, p) for p in paths]
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^([^:/]+):/+", "$1:/")
    file = F.array_position(F.array(*map(F.lit, qualified)), path)
    at = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("__at", at).where("_corrupt_record is null").drop("_corrupt_record")


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, which one slash follows, however many Spark or Hadoop write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^([^:/]+):/+", r"\1:/", at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())


def jsonl_tolerant(spark: SparkSession, paths: list[str], key: str, schema: str = PHASE_TWO) -> DataFrame:
    """Bad lines and rows without key are skipped; of rows with one key the last of the last file stays.

    All files are one scan, and the last rows an aggregate, so rows that were written again are combined before a shuffle.
    """
    rows = _shards(spark, paths, schema).where(F.col(key).isNotNull())
    fields = [c for c in rows.columns if c not in (key, "__at")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*fields), "__at").alias("__r"))
    return last.select(*(F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns if c != "__at"))


def pairs(spark: SparkSession, path) -> DataFrame:
    rows = spark.read.parquet(path)
    if missing := [c for c in PAIR if c not in rows.columns]:
        raise ValueError(f"pair table lacks columns: {', '.join(missing)}")
    return rows.select(*PAIR)


def last_per_key(rows: DataFrame, key: str) -> DataFrame:
    """The last row of a file for each key; rows keep the reader's order."""
    last = Window.partitionBy(key).orderBy(F.desc("__at"))
    return rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__i", F.row_number().over(last)).where("__i = 1").drop("__i", "__at")


def dates(spark: SparkSession, path) -> DataFrame:
    rows = last_per_key(csv(spark, path, DATES), "cve")
    return rows.select("cve", F.try_to_timestamp("reserve_time").alias("reserve_ts"), F.try_to_timestamp("publish_time").alias("publish_ts"))


def reports(spark: SparkSession, path) -> DataFrame:
    return last_per_key(csv(spark, path, REPORTS), "cve_id")


def descriptions(rows: DataFrame) -> DataFrame:
    return last_per_key(rows.select("cve", F.trim("cve_description").alias("description")), "cve")


def key_list(spark: SparkSession, path) -> DataFrame:
    """Keys of a text file, each once; blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> '' and not startswith(key, '#')").distinct()


def per_pair(spark: SparkSession, path, sample: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, label, answer, confidence, position) of per-pair records of a file or several, in their order; with a sample, of its queries only."""
    rows = _shards(spark, [path] if isinstance(path, str) else list(path), PER_PAIR).where("input.cve is not null")
    out = rows.select(F.col("input.cve").alias("query_id"), F.col("input.commit_id").alias("doc_id"), F.col("input.label").alias("label"), "output.answer", "output.confidence", F.col("__at").alias("position"))
    return out if sample is None else out.join(sample.select("query_id").distinct(), "query_id", "left_semi")


def sample_ids(spark: SparkSession, path) -> DataFrame:
    """(query_id): the distinct queries of a query file."""
    return csv(spark, path, QUERY).select(F.trim("cve").alias("query_id")).where("query_id <> ''").distinct()


def repo_queries(rows: DataFrame, owner: str, repo: str) -> DataFrame:
    """The queries (position, cve, owner, repo, ...) of one repository, the first row of each."""
    own = rows.where((F.trim("owner") == owner) & (F.trim("repo") == repo))
    first = Window.partitionBy("cve").orderBy("position")
    return own.withColumn("__i", F.row_number().over(first)).where("__i = 1").drop("__i")


def result_json(rows: DataFrame) -> DataFrame:
    """One JSON string for each record."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def result_of(rows: DataFrame, schema: str = PHASE_TWO) -> DataFrame:
    """Records back from JSON strings (value)."""
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def method_spec(text: str) -> tuple[str, list[str]]:
    """name:path[,path] -> (name, paths)."""
    name, _, paths = text.partition(":")
    if not paths:
        raise ValueError(f"not a method specification: {text}")
    return name.strip().lower(), [p.strip() for p in paths.split(",") if p.strip()]


def method_files(spark: SparkSession, text: str, known: tuple[str, ...] = ()) -> tuple[str, list[str]]:
    """The name and files of a method specification; its paths may be globs, and each must match something."""
    name, paths = method_spec(text)
    if known and name not in known:
        raise ValueError(f"no such method: {name}; there are {', '.join(sorted(known))}")
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for part in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        met = at.getFileSystem(conf).globStatus(at)
        if not met:
            raise FileNotFoundError(f"no files match: {part}")
        found += sorted(x.getPath().toString() for x in met)
    return name, found


def load_method(spark: SparkSession, text: str, ranking: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(name, rankings (query_id, doc_id, rank)) of a method specification `name:path[,path]`, its paths globs or not.

    Records of all shards are one union: of selection and single records the last of a query counts, by the order of
    files, then lines; per-pair records are ranked together. ranking extends selections by a first stage's order.
    """
    from ..operators.candidates import METHODS, method_rankings

    name, paths = method_files(spark, text, METHODS)
    if name == "pairs":
        return name, method_rankings(name, per_pair(spark, paths))
    rows = jsonl_tolerant(spark, paths, "cve_id", "cve_id STRING, best_commit_id STRING, commits_inspected ARRAY<STRING>")
    return name, method_rankings(name, rows.select(F.col("cve_id").alias("query_id"), F.col("best_commit_id").alias("best"), F.col("commits_inspected").alias("inspected")), ranking)
