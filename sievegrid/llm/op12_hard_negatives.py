"""Hard negatives by branch and bound over ball trees.

Rows are routed to cells, and cells that are large are dealt out evenly, so that
each block of rows gets one ball tree: its upper nodes split by label where the
labels have enough rows, the others halve along the direction of two far points.
From centre, radius and query follow an upper and a lower bound of all inner
products in a node. A node is left out if its products all lie outside the
window asked for, if all are beneath the k-th best found so far, or if its labels
can't be of the kind wanted. The same bounds, of whole cells, decide which
blocks a query meets at all: it first meets one promising cell, and with the
k-th score from there only those other cells that may hold better ones.

An anchor's positives are its k best of the same label; the negatives of a
positive are the k best of other labels with scores between LOW and HIGH
hundredths of the positive's. Components are integers, floor(256 x), and scores
are integer inner products, exact in any order of summation.

Cells are fitted on a bounded sample; every row is indexed and the bounds are
sure, so results are exact.

Cases: rows with a null label, id or vector, null or non-finite components, an
empty vector or one of another length than most, and rows whose scores might not
fit in a long take no part. Labels that are not whole numbers are told apart by
64-bit hashes. Of rows that share an id the one with the least (label, vector)
counts, so repeated rows count once. Ties go to the smaller id; all are returned
if there are fewer than k; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import dimension, matrix

SCALE, LOW, HIGH = 256, 30, 90
#: Rows of a block, of a leaf, of a sample; cells at most; queries packed together.
ROWS, LEAF, SAMPLE, CELLS, QUERIES = 4096, 64, 16_384, 1024, 256
#: No bound on a score.
LEAST, MOST = -(1 << 62), 1 << 62


# Trees and their search, of one block of rows and one of queries.


def ball_tree(label: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, dict]:
    """(order of the rows, nodes): a node covers rows start:end of that order, and stands after its parent."""
    order, nodes, at = np.arange(len(x)), {k: [] for k in ("start", "end", "parent", "leaf", "least", "most", "radius", "centre")}, 0
    todo = [(0, len(x), -1)]
    while at < len(todo):
        start, end, parent = todo[at]
        mine = order[start:end]
        mine = mine[np.argsort(label[mine], kind="stable")]
        y, ls = x[mine].astype(np.float64), label[mine]
        centre = y.mean(axis=0)
        far = np.sqrt(((y - centre) ** 2).sum(axis=1))
        leaf = end - start <= LEAF
        for k, v in (("start", start), ("end", end), ("parent", parent), ("leaf", leaf), ("least", ls[0]), ("most", ls[-1]), ("radius", far.max()), ("centre", centre)):
            nodes[k].append(v)
        if not leaf:
            edges = np.flatnonzero(ls[1:] != ls[:-1]) + 1
            if len(edges) and (len(edges) + 1) * LEAF <= end - start:
                cut = int(edges[np.abs(edges - (end - start) // 2).argmin()])
            else:
                a = y[far.argmax()]
                b = y[((y - a) ** 2).sum(axis=1).argmax()]
                mine, cut = mine[np.argsort(y @ (b - a), kind="stable")], (end - start) // 2
            todo += [(start, start + cut, at), (start + cut, end, at)]
        order[start:end] = mine
        at += 1
    return order, {k: np.array(v) for k, v in nodes.items()}


def bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of all inner products of each query with each ball, with room for rounding."""
    size = np.sqrt((q**2).sum(axis=1))[:, None]
    middle, room = q @ centres.T, size * radius[None, :]
    slack = 1e-9 * size * (np.sqrt((centres**2).sum(axis=1)) + radius)[None, :] + 1e-3
    return middle - room - slack, middle + room + slack


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; through doubles where they hold them."""
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def search(ask: dict, ids: np.ndarray, label: np.ndarray, x: np.ndarray, nodes: dict, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score, products made): the k best rows of each query (v, id, label, low, high, floor) inside its window.

    Rows are in tree order. floor: a score that k rows are known to reach.
    """
    q, floor = ask["v"].astype(np.float64), np.maximum(ask["low"], ask["floor"])
    n, top = len(q), np.full((len(q), k), LEAST)
    upper = np.full((n, len(nodes["start"])), -np.inf)
    level, alive = np.array([0]), np.ones((n, 1), bool)
    while len(level):
        low, high = bounds(q, nodes["centre"][level], nodes["radius"][level])
        least, most = nodes["least"][level][None, :], nodes["most"][level][None, :]
        mine = ask["label"][:, None]
        kind = (least <= mine) & (mine <= most) if same else (least != mine) | (most != mine)
        alive = alive & kind & (high >= floor[:, None]) & (low <= ask["high"][:, None])
        upper[:, level] = np.where(alive & nodes["leaf"][level][None, :], np.minimum(high, ask["high"][:, None]), -np.inf)
        # Only children of nodes that some query wants are looked at.
        wanted = level[alive.any(axis=0)]
        below = np.flatnonzero(np.isin(nodes["parent"], wanted))
        alive = alive[:, np.searchsorted(level, nodes["parent"][below])]
        level = below
    leaves = np.flatnonzero(nodes["leaf"] & (upper > -np.inf).any(axis=0))
    upper = upper[:, leaves]
    order, made = np.argsort(-upper, axis=1, kind="stable"), 0
    best = [np.empty(0, np.int64)] * 3
    for first, last in ((0, 2), (2, 8), (8, 32), (32, len(leaves))):
        at, leaf = np.repeat(np.arange(n), max(0, min(last, len(leaves)) - first)), order[:, first:last].ravel()
        open_ = (upper[at, leaf] > -np.inf) & (upper[at, leaf] >= floor[at])
        at, leaf = at[open_], leaf[open_]
        if not len(at):
            continue
        by = np.argsort(leaf, kind="stable")
        at, leaf, found = at[by], leaf[by], [best]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(leaf)) + 1):
            node, mine = leaves[leaf[part[0]]], at[part]
            s = slice(nodes["start"][node], nodes["end"][node])
            score = products(ask["v"][mine], x[s])
            made += score.size
            fits = (score >= floor[mine][:, None]) & (score <= ask["high"][mine][:, None]) & ((label[s][None, :] == ask["label"][mine][:, None]) == same) & (ids[s][None, :] != ask["id"][mine][:, None])
            a, b = np.nonzero(fits)
            found.append([mine[a], b + s.start, score[a, b]])
        a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((ids[b], -score, a))
        a, b, score = a[by], b[by], score[by]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        best = [c[place < k] for c in (a, b, score)]
        place = place[place < k]
        top[best[0], place] = best[2]
        floor = np.maximum(floor, top[:, k - 1])
    return *best, made


# The same over cells and blocks.


def _cells(rows: DataFrame) -> np.ndarray:
    """Centres of cells, by a few rounds of k-means on a bounded sample; all rows are routed to them."""
    fit = rows.orderBy(F.xxhash64("id", F.lit(12)), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    if not len(fit):
        return np.zeros((0, 1))
    x, n = matrix(fit), max(1, min(CELLS, rows.count() // ROWS, len(fit) // 8))
    centres = x[np.random.default_rng(12).choice(len(x), n, replace=False)]
    for _ in range(4):
        near = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
        size = np.bincount(near, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _routed(rows: DataFrame, centres) -> DataFrame:
    """rows with their cell and their distance from its centre."""

    def run(batches):
        c = centres.value
        for b in batches:
            x = matrix(b.column("v"))
            near = ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
            away = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
            yield b.append_column("cell", pa.array(near.astype(np.int32))).append_column("away", pa.array(away))

    return rows.mapInArrow(run, "id long, label long, v array<long>, cell int, away double")


def _index(rows: DataFrame) -> DataFrame:
    """(cell, part, tree binary...): one row per block."""
    names = ["ids", "labels", "x", "start", "end", "parent", "leaf", "least", "most", "radius", "centre"]

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("id").combine_chunks()
        ids, label, x = g["id"].to_numpy(), g["label"].to_numpy(), matrix(g["v"].combine_chunks(), np.int64)
        order, nodes = ball_tree(label, x)
        kept = [ids[order], label[order], x[order], *(nodes[n] for n in names[3:])]
        return pa.Table.from_arrays([g["cell"][:1], g["part"][:1], *(pa.array([v.tobytes()], pa.binary()) for v in kept)], ["cell", "part", *names])

    return rows.groupBy("cell", "part").applyInArrow(run, "cell int, part int, " + ", ".join(f"{n} binary" for n in names))


_KINDS = {"ids": np.int64, "labels": np.int64, "x": np.int64, "start": np.int64, "end": np.int64, "parent": np.int64, "leaf": np.bool_, "least": np.int64, "most": np.int64, "radius": np.float64, "centre": np.float64}
#: What is asked: an anchor (id) for a tag (0, or a positive), with its label, window and floor.
_ASK = ("id", "tag", "label", "low", "high", "floor")


def _sent(asks: DataFrame, balls, first: bool) -> DataFrame:
    """(cell, part, asked binary...): asks packed for each block that they must meet.

    first: the one cell that most likely has the best rows; else all others that may hold one at or above the floor.
    """

    def run(batches):
        centres, radius, parts = balls.value
        for whole in batches:
            for b in (whole.slice(i, 4 * QUERIES) for i in range(0, whole.num_rows, 4 * QUERIES)):
                ask = {k: b.column(k).to_numpy() for k in _ASK} | {"v": matrix(b.column("v"), np.int64)}
                low, high = bounds(ask["v"].astype(np.float64), centres, radius)
                can = (high >= ask["low"][:, None]) & (low <= ask["high"][:, None]) & (parts > 0)[None, :]
                # The best rows of a window stand where products reach its upper end, or come nearest to it; whatever the floor, an ask has one such cell.
                middle = (low + high) / 2
                target = np.minimum(ask["high"], middle.max(axis=1))[:, None]
                near = np.arange(len(parts))[None, :] == np.where(can, np.abs(middle - target), np.inf).argmin(axis=1)[:, None]
                wants = can & near if first else can & ~near & (high >= ask["floor"][:, None])
                for cell in np.flatnonzero(wants.any(axis=0)):
                    mine = np.flatnonzero(wants[:, cell])
                    for some in (mine[i : i + QUERIES] for i in range(0, len(mine), QUERIES)):
                        packed = [pa.array([ask[k][some].tobytes()] * parts[cell], pa.binary()) for k in (*_ASK, "v")]
                        yield pa.RecordBatch.from_arrays([pa.array([cell] * parts[cell], pa.int32()), pa.array(range(parts[cell]), pa.int32()), *packed], ["cell", "part", *(f"q_{k}" for k in (*_ASK, "v"))])

    return asks.mapInArrow(run, "cell int, part int, " + ", ".join(f"q_{k} binary" for k in (*_ASK, "v")))


def _met(sent: DataFrame, index: DataFrame, d: int, k: int, same: bool) -> DataFrame:
    """(id, tag, found, score): the k best of each ask in each block that it meets."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ask = {n: np.frombuffer(row[f"q_{n}"], np.int64) for n in (*_ASK, "v")}
                ask["v"] = ask["v"].reshape(-1, d)
                t = {n: np.frombuffer(row[n], kind) for n, kind in _KINDS.items()}
                x, centre = t["x"].reshape(-1, d), t["centre"].reshape(-1, d)
                at, found, score, _ = search(ask, t["ids"], t["labels"], x, t | {"centre": centre}, k, same)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ask["id"][at], ask["tag"][at], t["ids"][found], score)], ["id", "tag", "found", "score"])

    return sent.join(index, ["cell", "part"]).drop("cell", "part").mapInArrow(run, "id long, tag long, found long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "tag").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(asks: DataFrame, index: DataFrame, balls, d: int, k: int, same: bool) -> DataFrame:
    """(id, tag, found, score, rank): the k best rows of each ask, from one cell, then from those others that may better it."""
    near = materialize(_best(_met(_sent(asks, balls, True), index, d, k, same), k), "negatives-near")
    floors = near.where(F.col("rank") == k).select("id", "tag", F.col("score").alias("reached"))
    raised = asks.join(floors, ["id", "tag"], "left").withColumn("floor", F.coalesce("reached", "floor"))
    rest = _met(_sent(raised.select(*_ASK, "v"), balls, False), index, d, k, same)
    out = materialize(_best(near.select("id", "tag", "found", "score").unionByName(rest), k), "negatives-best")
    discard(near)
    return out


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = LOW, high: int = HIGH, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for those rows whose ids are among anchors (its column key)."""
    spark = rows.sparkSession
    whole = rows.schema[label].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = rows.select(F.col(key).cast("long").alias("id"), (F.col(label).cast("long") if whole else F.when(F.col(label).isNotNull(), F.xxhash64(label))).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    d = dimension(rows, "v")
    largest = math.isqrt((1 << 55) // max(1, d)) / SCALE  # of scores, and of 100 times a score, none leaves the longs
    rows = rows.where((F.size("v") == d) & F.forall("v", lambda x: F.abs(x) < largest)).withColumn("v", F.transform("v", lambda x: F.floor(SCALE * x)))
    rows = materialize(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "negatives-rows")

    centres = _cells(rows)
    routed = materialize(_routed(rows, spark.sparkContext.broadcast(centres)), "negatives-routed")
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # CELLS rows at most
        size[r["cell"]], radius[r["cell"]] = r["n"], r["away"] * (1 + 1e-9)
    parts = -(-size // ROWS)
    balls = spark.sparkContext.broadcast((centres, radius, parts))
    part = F.pmod(F.xxhash64("id"), F.get(F.lit(parts.tolist() or [1]), F.col("cell"))).cast("int")
    index = materialize(_index(routed.withColumn("part", part).drop("away")), "negatives-index")

    none = [F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high"), F.lit(LEAST).cast("long").alias("floor")]
    asked = rows.join(anchors.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    asked = materialize(asked.select("id", F.lit(0).cast("long").alias("tag"), "label", *none, "v"), "negatives-asked")
    good = _top(asked, index, balls, d, positives, True)
    scores = good.select("id", F.col("found").alias("tag"), F.col("score").alias("p"))
    # low * p <= 100 * n <= high * p, in whole numbers; below 0 there is no such n.
    window = [F.expr(f"({low} * p + 99) div 100").alias("low"), F.expr(f"({high} * p) div 100").alias("high")]
    asks = materialize(asked.select("id", "label", "v").join(scores, "id").where("p >= 0").select("id", "tag", "label", *window, none[2], "v"), "negatives-asks")
    hard = _top(asks, index, balls, d, negatives, False)
    discard(rows, routed, index, asked, asks)
    return hard.join(scores, ["id", "tag"]).select(
        F.col("id").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT a.id, b.id AS found, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT id, found AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, found) <= 5)
SELECT id AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY id, positive_id ORDER BY score DESC, found) AS INT) AS rank, found AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
