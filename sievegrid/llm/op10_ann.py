"""Nearest neighbours by additive quantisation and exact reranking.

A vector is approximated by a sum of codewords, one of each of several
full-dimensional codebooks; the codes are chosen by beam search. The index
holds, per block of rows, codes, exact norms and what the approximation leaves
over. A query scores a block by table lookups: its products with all codewords
once, then one addition per codebook and row. As the rest of a row beyond its
approximation is nearly orthogonal to a query, a row's cosine lies, as a rule and
not surely, within MARGIN standard deviations of its score; every row of a block
whose upper bound by that reaches the block's k-th best lower bound is reranked
exactly, in double precision on the original vectors, however many they are. So there is no fixed number of
candidates, and large groups of near copies are reranked whole. Only the k best
of a block leave it.

Codebooks are fitted on a bounded sample by residual k-means; all rows are
indexed. Queries meet rows block by block.

Cases: vectors that are null, zero, of another length than most, or that hold
null or non-finite components, and rows without an id take no part, neither as
queries nor as rows found. Equal rows count once. Of equal vectors only the
k + 1 least ids can be among the k nearest, so only those are indexed. Fewer than
k candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import component_kind, dimension, matrix, sample, unit, usable

BOOKS, WORDS, BEAM, SAMPLE, ROUNDS = 16, 256, 6, 8192, 6
#: Rows of an index block and queries of a query block.
ROWS, QUERIES = 4096, 256
#: Standard deviations of a product with the rest that bounds allow for.
MARGIN = 3.0


class Quantizer:
    def __init__(self, fit: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        rest, self.books = fit.astype(np.float32), []
        for _ in range(BOOKS if len(fit) else 0):
            words = rest[rng.choice(len(rest), min(WORDS, len(rest)), replace=False)].copy()
            for _ in range(ROUNDS):
                near = (rest @ words.T - 0.5 * (words**2).sum(1)).argmax(1)
                n = np.bincount(near, minlength=len(words))
                for j in range(words.shape[1]):
                    total = np.bincount(near, weights=rest[:, j], minlength=len(words))
                    words[:, j] = np.where(n > 0, total / np.maximum(n, 1), words[:, j])
            self.books.append(words)
            rest = rest - words[(rest @ words.T - 0.5 * (words**2).sum(1)).argmax(1)]
        self.books = np.stack(self.books) if len(fit) else np.zeros((BOOKS, 1, max(1, fit.shape[1])), np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the rest) of each row, by beam search over the books."""
        x = x.astype(np.float32)
        n, d = x.shape
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for words in self.books:
            cost = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, rest.shape[1], -1) + (words**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            beam, word = best // cost.shape[2], best % cost.shape[2]
            rows = np.arange(n)[:, None]
            rest = rest[rows, beam] - words[word]
            codes = np.concatenate([codes[rows, beam], word[:, :, None].astype(np.uint8)], axis=2)
        left = (rest**2).sum(2)
        pick = left.argmin(1)
        return codes[np.arange(n), pick], np.sqrt(left[np.arange(n), pick])


def _index(rows: DataFrame, quantizer, kind: str) -> DataFrame:
    """(block, ids, codes, rest, v binary): one row per block; codes are of vectors at length 1, v are the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
        v = matrix(g["v"].combine_chunks(), np.dtype(kind))
        x, codes, rest = unit(v.astype(np.float64)), [], []
        for i in range(0, len(x), 1024):
            c, r = quantizer.value.encode(x[i : i + 1024])
            codes.append(c)
            rest.append(r)
        yield pa.RecordBatch.from_arrays(
            [g["block"].combine_chunks()[:1], *(pa.array([v.tobytes()], pa.binary()) for v in (g["id"].to_numpy(), np.concatenate(codes), np.concatenate(rest).astype(np.float32), v))],
            ["block", "ids", "codes", "rest", "v"],
        )

    return rows.groupBy("block").applyInArrow(run, "block int, ids binary, codes binary, rest binary, v binary")


def _query_blocks(queries: DataFrame, kind: str) -> DataFrame:
    """(q_ids, q binary): blocks of queries with their vectors as they are, which is half of what they are in double precision."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                b = whole.slice(at, QUERIES)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (b.column(0).to_numpy(), matrix(b.column(1), np.dtype(kind)))], ["q_ids", "q"])

    return queries.select("id", "v").mapInArrow(run, "q_ids binary, q binary")


def _nearest_of_blocks(pairs: DataFrame, quantizer, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): of each pair of a query block and an index block the k nearest rows of each query."""

    def run(batches):
        books = quantizer.value.books
        d = books.shape[2]
        for whole in batches:
            for i in range(whole.num_rows):
                q_ids, q, ids, codes, rest, v = (c[i].as_py() for c in whole.columns)
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, rest = unit(np.frombuffer(q, np.dtype(kind)).reshape(len(q_ids), -1).astype(np.float64)), np.frombuffer(rest, np.float32)
                codes = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                score = np.zeros((len(ids), len(q_ids)), np.float32)
                for m in range(len(books)):
                    score += (books[m] @ q.T.astype(np.float32))[codes[:, m]]
                score = score.T
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                room = (MARGIN / math.sqrt(d) * rest)[None, :] + np.float32(1e-5)
                low = score - room
                n = min(k, len(ids))
                bound = np.partition(low, len(ids) - n, axis=1)[:, len(ids) - n]
                at, row = np.nonzero((score + room >= bound[:, None]) & (score > -np.inf))
                x = unit(np.frombuffer(v, np.dtype(kind)).reshape(len(ids), -1).astype(np.float64))
                exact = np.concatenate([(q[at[j : j + 50_000]] * x[row[j : j + 50_000]]).sum(axis=1) for j in range(0, max(1, len(at)), 50_000)])
                order = np.lexsort((ids[row], -exact, at))
                at, row, exact = at[order], row[order], exact[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                best = place < k
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[best]]), pa.array(ids[row[best]]), pa.array(exact[best])], ["query_id", "vec_id", "score"])

    return pairs.select("q_ids", "q", "ids", "codes", "rest", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest vectors by cosine, itself (its id) excluded."""
    spark, kind = vectors.sparkSession, component_kind(vectors, vector)

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
        return df.where(F.col("id").isNotNull() & usable(F.col("v")))

    d = dimension(clean(vectors), "v")
    rows = clean(vectors).where(F.size("v") == d)
    asked = clean(queries).where(F.size("v") == d).distinct()
    same = Window.partitionBy("h", "v").orderBy("id")
    rows = rows.withColumn("h", F.xxhash64("v")).distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "v")
    rows = materialize(rows, "ann-rows")
    blocks = max(1, math.ceil(rows.count() / ROWS))
    fit = sample(rows, "id", "v", SAMPLE)
    quantizer = spark.sparkContext.broadcast(Quantizer(fit if fit.size else np.zeros((0, max(1, d)))))
    index = materialize(_index(rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")), quantizer, kind), "ann-index")
    # Every query block meets every index block; the queries are copied, once per block of rows. Spark can't know how
    # many copies that makes, and would send them all through the driver; so both sides are told to shuffle.
    asked_of = _query_blocks(asked, kind).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    exact = _nearest_of_blocks(asked_of.hint("merge").join(index.hint("merge"), "block"), quantizer, k, kind).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_additive_ann(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
