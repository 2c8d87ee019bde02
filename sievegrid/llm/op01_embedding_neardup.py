"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree halves the space again and again at the median of a random direction,
fitted on a bounded sample; vectors close to a split go to both sides, so close
pairs seldom part, and each of several trees gives them another chance. All
vectors are then compared with those in their leaves, exactly, in double
precision, with matrix products. A pair met in several leaves counts in the
first one only, which each task can tell from the leaves its vectors carry; so
tasks return counts and spanning edges, never pairs, and large groups of near
copies cost no more output than rows. Leaves larger than a tile are compared in
tiles, each a task of its own: no leaf is capped.

Equal vectors of one label are one class with a size, and meet nothing twice.
Vectors of doubles are compared as such. Depth follows the largest label, as far
as the sample allows; beyond it leaves grow, and are compared in more tiles.

Cases: vectors that are null, zero, of another length than most, or that hold
null or non-finite components, rows without a label, and rows without an id
link with nothing: n_links 0, component_id their own id. Repeated rows are
vectors of their own. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .vectors import component_kind, dimension, matrix, sample, unit, usable

TREES, SAMPLE = 6, 16_384
#: Vectors of a label wanted in a leaf, in a sample's leaf at least, and in half a tile at most.
LEAF, LEAF_SAMPLE, TILE = 384, 16, 1024
#: Vectors nearer than this to a split go to both sides.
SPILL = 0.02


class Forest:
    def __init__(self, fit: np.ndarray, depth: int, trees: int = TREES, spill: float = SPILL, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = fit.shape[1]
        self.depth, self.spill = depth, spill
        self.directions = rng.standard_normal((trees, max(1, 2**depth - 1), d))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts = np.zeros(self.directions.shape[:2])
        for t in range(trees):
            at = np.zeros(len(fit), np.int64)
            for level in range(depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    mine = np.flatnonzero(at == node)
                    p = fit[mine] @ self.directions[t, node]
                    self.cuts[t, node] = np.median(p) if len(p) else 0.0
                    at[mine] = 2 * node + 1 + (p > self.cuts[t, node])

    def leaves(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of tree t that a row is in."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[row], self.directions[t][node]) - self.cuts[t][node]
            left, right = p <= self.spill, p >= -self.spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - (2**self.depth - 1)


def _routed(classes: DataFrame, forest) -> DataFrame:
    """(id, label, size, tree, leaf, v, leaves): a row for each leaf of each class."""

    def run(batches):
        f = forest.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = unit(matrix(part.column("v")))
                found = [f.leaves(x, t) for t in range(len(f.cuts))]
                row = np.concatenate([r for r, _ in found])
                code = np.concatenate([(t << 24) + leaf for t, (_, leaf) in enumerate(found)])
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                ends = np.searchsorted(row, np.arange(len(x) + 1))
                leaves = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code.astype(np.int32)))
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pick), part.column("label").take(pick), part.column("size").take(pick), pa.array(code.astype(np.int32)), part.column("v").take(pick), leaves.take(pick)],
                    ["id", "label", "size", "leaf", "v", "leaves"],
                )

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("id", "label", "size", "v").mapInArrow(run, f"id long, label {kind}, size long, leaf int, v {classes.schema['v'].dataType.simpleString()}, leaves array<int>")


def _earlier(leaves: list[list[int]], leaf: int) -> np.ndarray:
    """Incidence of rows and the leaves before this one that they are in."""
    size = [sum(c < leaf for c in x) for x in leaves]
    code = np.array([c for x in leaves for c in x if c < leaf], np.int64)
    row = np.repeat(np.arange(len(leaves)), size)
    names, col = np.unique(code, return_inverse=True)
    out = np.zeros((len(leaves), len(names)), np.float32)
    out[row, col] = 1
    return out


def _compare(threshold: float):
    """A tile's links: (id, links, root) for each row that links with another in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(list(batches)).sort_by("id").combine_chunks()
        x = unit(matrix(g["v"].combine_chunks()))
        ids, size, block = (g[c].to_numpy() for c in ("id", "size", "block"))
        before = _earlier(g["leaves"].to_pylist(), g["leaf"][0].as_py())
        near = (x @ x.T >= threshold) & (before @ before.T == 0)
        if g["low"][0].as_py() != g["high"][0].as_py():
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        label = np.arange(len(ids))
        while len(ids):
            new = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = near.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array((near[some] @ size).astype(np.int64)), pa.array(ids[label][some])], ["id", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; a pair links if labels are equal and cosine >= threshold."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{component_kind(vectors, vector)}>").alias("v"), F.col(label).alias("label"))
    d = dimension(rows.where(usable(F.col("v"))), "v")
    fine = usable(F.col("v")) & (F.size("v") == d) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("h", F.when(fine, F.xxhash64("label", "v"))).withColumn("h2", F.when(fine, F.xxhash64(F.lit(1), "v", "label")))
    classes = rows.where("h is not null").groupBy("h", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("v").alias("v"), F.first("label").alias("label"))
    # Vectors that share an id (repeated ids with other vectors) stay apart: the class's id is a number of its own.
    classes = materialize(classes.withColumnRenamed("id", "name").withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    fit = sample(classes, "id", "v", SAMPLE)
    depth = max(0, min(math.ceil(math.log2(max(1, largest / LEAF))), int(math.log2(max(1, len(fit) / LEAF_SAMPLE)))))
    forest = spark.sparkContext.broadcast(Forest(fit if fit.size else np.zeros((0, max(1, d))), depth))
    routed = _routed(classes, forest)
    big = routed.groupBy("label", "leaf").count().where(F.col("count") > TILE).select("label", "leaf", F.ceil(F.col("count") / TILE).cast("int").alias("blocks"))
    tiled = routed.join(big, ["label", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    links = materialize(tiled.drop("other", "blocks").groupBy("label", "leaf", "low", "high").applyInArrow(_compare(threshold), "id long, links long, root long"), "vector-links")
    names = classes.select("id", "name", "size", "h", "h2")
    edges = links.where("id <> root").select(F.col("id").alias("i"), "root").distinct()
    edges = edges.join(names.select(F.col("id").alias("i"), F.col("name").alias("a")), "i").join(names.select(F.col("id").alias("root"), F.col("name").alias("b")), "root").select("a", "b")
    found = components(edges, "vector")
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    told = names.join(counted, "id", "left").join(found.withColumnRenamed("node", "name"), "name", "left")
    told = told.select("h", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "name").alias("component"))
    return rows.join(told, ["h", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least_of ON least_of.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
