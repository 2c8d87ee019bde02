"""Exact inner-product rankings, and stages that make vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.diffs import commit_text
from ..session import small_batches
from ..sources.store import exists, write_by_repo
from ..sources.writers import pending_partitions
from .lexical import _best, ranked

#: Queries whose vectors are sent to all tasks; beyond, they are joined in blocks of this size.
QUERY_BLOCK = 4096


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, exclude_self: bool = True, by: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest inner products; ties to the smaller doc_id.

    With `by`, a column of both (a repository), queries meet the vectors of their own group only.
    Vectors are multiplied in blocks with the query matrix, and only each
    block's k best per query leave a task. A query set of more than
    QUERY_BLOCK vectors is taken in blocks that meet the vectors one by one.
    Vectors that are null, hold nulls or differ in length from the first query's take no part.
    """
    whole = lambda rows, key: rows.select(F.col(key).cast("long"), F.col(by).cast("string").alias("g") if by else F.lit("").alias("g"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null and g is not null and not exists(v, x -> x is null)")
    queries = whole(queries, "query_id")
    small_batches(vectors.sparkSession)
    n = queries.count()
    out, dim = None, None
    for i in range(-(-n // QUERY_BLOCK)):
        part = queries if n <= QUERY_BLOCK else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // QUERY_BLOCK))) == i)
        rows = part.toArrow().to_pylist()
        dim = len(rows[0]["v"]) if dim is None and rows else dim
        rows = [r for r in rows if len(r["v"]) == dim]
        if not rows:
            continue
        groups = pa.array([r["g"] for r in rows]).dictionary_encode()
        sent = vectors.sparkSession.sparkContext.broadcast((pa.array([r["query_id"] for r in rows], pa.int64()), groups, np.array([r["v"] for r in rows])))
        found = whole(vectors, "doc_id").where(F.size("v") == dim).mapInArrow(_block_topk(sent, k, digits, exclude_self), "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    return ranked(out, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _block_topk(sent, k: int, digits: int, exclude_self: bool):
    def run(batches):
        ids, groups, matrix = sent.value
        mine = groups.indices.to_numpy()
        for b in batches:
            if not b.num_rows:
                continue
            score = matrix @ b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T
            theirs = pc.fill_null(pc.index_in(b.column(1), groups.dictionary), -1).to_numpy()
            score[mine[:, None] != theirs[None, :]] = -np.inf
            if exclude_self:
                score[ids.to_numpy()[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            yield _best(score, ids, b.column(0), k, digits, -np.inf)

    return run


def seeded_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector that depends on the text alone: Gaussian draws seeded by its MD5 modulo 2^32."""
    seed = int.from_bytes(hashlib.md5(text.encode()).digest()[-4:], "big")
    v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
    return v / np.linalg.norm(v)


def seeded_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    return lambda texts: np.stack([seeded_vector(t, dim) for t in texts]) if texts else np.empty((0, dim), np.float32)


def encode_texts(rows: DataFrame, build: Callable[[], Callable[[list[str]], np.ndarray]], key: str = "doc_id", text: str = "text", prefix: str = "", batch: int = 128, max_chars: int | None = None) -> DataFrame:
    """(key, embedding): `build` makes the model once per task; it is given batches of prefixed texts.

    An empty prefix is for passages; queries take the model's instruction as prefix.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for part in parts:
            texts = [(prefix + (t or ""))[:max_chars] for t in part[text]]
            out = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch]).astype(np.float32)]
            yield pd.DataFrame({key: part[key], "embedding": out})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def encode_in_budget(rows: DataFrame, build: Callable[[], tuple[Callable, Callable]], key: str = "doc_id", text: str = "text", prefix: str = "", most: int = 8192, batch: int = 128, batch_tokens: int = 65_536) -> DataFrame:
    """(key, embedding) by a model with its own tokenizer, a text's tokens cut at `most` (8,192 for passages, 512 for queries).

    `build` makes, once per task, the pair (tokenize, embed): lists of token ids of texts, and vectors of such lists.
    Inside a task texts are taken by length, so the padding of a batch is small; a batch holds at most `batch` texts,
    and not more than `batch_tokens` tokens when all are padded to its longest. Rows come back in their order.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize, embed = build()
        for part in parts:
            tokens = [x[:most] for x in tokenize([prefix + (t or "") for t in part[text]])]
            out: list = [None] * len(tokens)
            order = sorted(range(len(tokens)), key=lambda i: (len(tokens[i]), i))
            while order:
                # The longest first; as many as fit when padded to it.
                take = max(1, min(batch, batch_tokens // max(1, len(tokens[order[-1]]))))
                mine, order = order[-take:], order[:-take]
                for i, v in zip(mine, embed([tokens[i] for i in mine]), strict=True):
                    out[i] = v.astype(np.float32)
            yield pd.DataFrame({key: part[key], "embedding": out})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def digest_encoder(texts: list[str]) -> np.ndarray:
    """A stand-in whose vectors anyone can work out: the bytes of a text's MD5, by 256."""
    return np.array([list(hashlib.md5(t.encode()).digest()) for t in texts], np.float32).reshape(-1, 16) / 256


def encode_commits(commits: DataFrame, build: Callable[[], Callable[[list[str]], np.ndarray]], budget: int = 6000) -> DataFrame:
    """(id, embedding, repo_key) of commits (repo_key, commit_id, commit_msg, diff): each one's text by line priority, then encoded.

    Ids carry their repository. The result is what `writers.write_embeddings` partitions by repository.
    """
    rows = commits.select(F.concat_ws("@@", "repo_key", "commit_id").alias("id"), commit_text(F.col("commit_msg"), F.col("diff"), budget).alias("text"))
    found = encode_texts(rows, build, "id", "text")
    return found.withColumn("repo_key", F.regexp_replace("id", "@@[^@]*$", ""))


def encode_repositories(commits: DataFrame, path: str, build: Callable[[], Callable[[list[str]], np.ndarray]], budget: int = 6000, rows_a_job: int = 1_000_000) -> int:
    """Encodes the repositories of commits (repo_key, commit_id, commit_msg, diff) that path has no vectors of; returns the number of jobs.

    Vectors stand in a partition per repository. Repositories are taken some at a time, about rows_a_job commits,
    and each job's partitions appear when it is done: a run that is lost redoes no repository that was written.
    Commits of written repositories aren't read where the store is partitioned.
    """
    spark, jobs = commits.sparkSession, 0
    sizes = commits.where("repo_key <> ''").groupBy("repo_key").agg(F.count("*").alias("n"))
    if exists(spark, path):
        sizes = pending_partitions(sizes, spark.read.schema("id STRING, embedding ARRAY<FLOAT>, repo_key STRING").parquet(path))
    todo = sizes.collect()  # a name and a count for each repository
    part: list[str] = []
    room = rows_a_job
    for i, r in enumerate(todo):
        part.append(r["repo_key"])
        room -= r["n"]
        if room <= 0 or i == len(todo) - 1:
            write_by_repo(encode_commits(commits.where(F.col("repo_key").isin(part)), build, budget), path, ("id",))
            part, room, jobs = [], rows_a_job, jobs + 1
    return jobs


def leg_or_empty(make: Callable[[], DataFrame], schema: str, spark) -> DataFrame:
    """A leg's ranking, or an empty one where its inputs are absent, so that the other legs go on."""
    from pyspark.errors import AnalysisException

    try:
        return make()
    except (FileNotFoundError, AnalysisException):
        return spark.createDataFrame([], schema)


def backbone_ranking(spark, root: str, backbone: str, bm25: DataFrame, k: int = 100, top: int | None = 100) -> DataFrame:
    """(query_id, doc_id, score, rank, source, bm25_rank, dense_rank): bm25 (query_id, doc_id, rank) fused with the dense leg of a backbone.

    A backbone's vectors stand under root by its name: corpus (doc_id, embedding, repo_key) and queries (query_id,
    embedding, repo_key), partitioned by repository. Queries whose repository lacks either have no rows, as have all
    where the backbone has no tables; source names the backbone.
    """
    from .fusion import rrf

    kind = "STRUCT<query_id: BIGINT, doc_id: BIGINT, score: DOUBLE, rank: INT, source: STRING, bm25_rank: INT, dense_rank: INT>"
    paths = [f"{root.rstrip('/')}/{backbone}/{t}" for t in ("corpus", "queries")]
    if not all(exists(spark, p) for p in paths):
        return spark.createDataFrame([], kind)
    corpus, queries = (spark.read.schema(f"{c} BIGINT, embedding ARRAY<FLOAT>, repo_key STRING").parquet(p) for c, p in zip(("doc_id", "query_id"), paths, strict=True))
    asked = queries.join(corpus.select("repo_key").distinct(), "repo_key", "left_semi")
    legs = rrf(bm25.join(asked.select("query_id").distinct(), "query_id", "left_semi"), dense_topk(corpus, asked, k, by="repo_key"), top=top)
    return legs.withColumn("source", F.lit(f"rrf-{backbone}"))
