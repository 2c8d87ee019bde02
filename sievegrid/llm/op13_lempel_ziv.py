"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into the phrases of an incremental
dictionary: each phrase is the longest one known that fits, with one character
more. Texts that compress well together share phrases, so the Jaccard likeness
of their phrase sets follows a compression distance. The set is hashed, and kept
as a minimum-hash signature: each of SLOTS slots has the least hash that falls
into it, of which 16 bits are written, four hex digits a slot, `ffff` where
there is none. The likeness of two fingerprints is the share of equal slots
among those that either has.

An edited text agrees with its document up to the edit, so its parse goes on
from the document's dictionary there, and only the rest is parsed twice.

`fingerprint_with_neighbours` needs each document's successor by id. Rows are
dealt out by ranges of (id, text hash) whose bounds are keys of a bounded sample
of the rows; the row that opens a range also goes, as its last, to the range
before, so every row meets its successor while a sorted partition streams by,
and texts are shuffled once.

Cases: a null text counts as empty; an empty text has no phrases, and two such
are alike (1), one such and another text are not (0); one character is one
phrase; rows that share an id follow each other by a hash of their text, and
repeated rows are documents of their own; rows without an id stand in no order:
their edited text is their own and near_next is null; the last document is
followed by the first, a single one by itself; empty tables give no rows; other
columns are not read. A text's dictionary is held whole while it is parsed, so memory
follows the longest text.
"""

from __future__ import annotations

import bisect
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op04_bpe import slices

SLOTS, EMPTY = 128, 0xFFFF
#: Keys of the sample that bounds are taken from, and ranges a shuffle partition.
SAMPLE, RANGES = 20_000, 4
BASE = 0x9E3779B97F4A7C15


class Parse:
    """The phrases of a text so far, as a tree of dictionaries; ends are where they end, each beginning where the one before ends."""

    def __init__(self):
        self.node = self.root = {}
        self.ends: list[int] = []

    def read(self, text: str, at: int = 0) -> list[tuple[dict, str]]:
        """Goes on over text, whose first character is the at-th of all; returns what it adds to the tree."""
        node, root, end, added = self.node, self.root, self.ends.append, []
        add = added.append
        for i, c in enumerate(text, at + 1):
            if c in node:
                node = node[c]
            else:
                node[c] = {}
                add((node, c))
                end(i)
                node = root
        self.node = node
        return added

    def branches(self, text: str, other: str, at: int) -> tuple[list[int], list[int]]:
        """The ends of phrases when it goes on over text, and when it goes on over other instead."""
        node, n = self.node, len(self.ends)
        added = self.read(text, at)
        ends = self.ends
        for parent, c in reversed(added):
            del parent[c]
        self.node, self.ends = node, ends[:n]
        self.read(other, at)
        return ends, self.ends


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    out = np.ones((2, size), np.uint64)
    out[0, 1:], out[1, 1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    return tuple(np.multiply.accumulate(out, axis=1))


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """A 64-bit hash of each phrase, of its characters and its length alone."""
    if not ends:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)[: ends[-1]]
        power, inverse = _powers(1 << max(16, len(points).bit_length()))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * power[: len(points)], out=sums[1:])
        stop = np.array(ends)
        start = np.concatenate([[0], stop[:-1]])
        # The sum over a phrase, brought to the text's start.
        h = (sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return h ^ (h >> np.uint64(31))


#: The least hash of each slot.
_FIRST = np.array([i * (2**64 // SLOTS) for i in range(SLOTS)], np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The written 16 bits of the least hash of each slot; a hash's upper bits are its slot."""
    h = np.sort(hashes)
    at = np.searchsorted(h, _FIRST)
    filled = np.diff(at, append=len(h)) > 0
    out = np.full(SLOTS, EMPTY, np.uint16)
    out[filled] = h[at[filled]] % np.uint64(EMPTY)
    return out


def written(sign: np.ndarray) -> str:
    return sign.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of slots that agree among those that either fills; 1 of two without phrases."""
    either = (a != EMPTY) | (b != EMPTY)
    return float((a == b)[either].mean()) if either.any() else 1.0


def fingerprint(text: str) -> np.ndarray:
    parse = Parse()
    parse.read(text)
    return signature(phrase_hashes(text, parse.ends))


def fingerprints(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """(signature, that of the edited text, edited text); the edit puts the beginning of following in place of the last quarter."""
    kept = len(text) - len(text) // 4
    edited = text[:kept] + following[: len(text) // 4]
    parse = Parse()
    parse.read(text[:kept])
    own, changed = parse.branches(text[kept:], edited[kept:], kept)
    return signature(phrase_hashes(text, own)), signature(phrase_hashes(edited, changed)), edited


def _told(text: str, following: str) -> tuple[np.ndarray, list]:
    """A text's signature, and what is returned of it but for near_next."""
    own, changed, edited = fingerprints(text, following)
    return own, [len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed), likeness(own, changed)]


def _ranges(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Keys (id, text hash) that ranges begin with, all of them keys of rows; the first is the least."""
    first = rows.agg(F.min("id")).first()[0]
    if first is None:
        return []
    key = [F.col("id"), F.xxhash64("text")]
    least = rows.where(F.col("id") == first).agg(F.min(key[1])).first()[0]
    n = rows.count()
    some = rows.sample(min(1.0, SAMPLE / n), 13).select(*key).limit(4 * SAMPLE).toArrow()
    keys = sorted(set(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)))
    return sorted({(first, least), *keys[:: max(1, len(keys) // ranges)]})


def _dealt(rows: DataFrame, starts) -> DataFrame:
    """rows with their hash and range; those that open a range also stand, marked as copies, at the end of the one before."""

    def run(batches):
        bounds = starts.value
        at = {k: i for i, k in enumerate(bounds)}
        for whole in batches:
            for b in slices(whole, 2000):
                keys = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
                found = np.array([bisect.bisect_right(bounds, k) - 1 for k in keys], np.int32)
                yield b.append_column("range", pa.array(found)).append_column("copy", pa.array(np.zeros(len(keys), bool)))
                opens = [i for i, k in enumerate(keys) if k in at]
                if opens:
                    before = pa.array([(at[keys[i]] - 1) % len(bounds) for i in opens], pa.int32())
                    yield b.take(pa.array(opens)).append_column("range", before).append_column("copy", pa.array([True] * len(opens)))

    return rows.select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "id long, text string, h long, range int, copy boolean")


def fingerprint_with_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    placed = rows.where(F.col("id").isNotNull())
    # More ranges than partitions, as ranges are hashed to them.
    starts = _ranges(placed, RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _dealt(placed, rows.sparkSession.sparkContext.broadcast(starts)).repartition("range").sortWithinPartitions("range", "copy", "id", "h")

    def streamed(batches):
        before = waiting = None
        for whole in batches:
            for b in slices(whole, 200):
                out = []
                for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    id_, x, within, copy = row
                    if before is not None and not before[3] and before[2] == within:
                        own, told = _told(before[1], x)
                        if waiting is not None:
                            out.append([*waiting[1], likeness(waiting[0], own)])
                        waiting = own, [before[0], *told]
                        if copy:  # its range ends, and its successor is another range's row
                            out.append([*waiting[1], likeness(own, fingerprint(x))])
                            waiting = None
                    before = row
                if out:
                    yield _batch(out)

    def alone(batches):
        for whole in batches:
            for b in slices(whole, 200):
                yield _batch([[None, *_told(x, x[len(x) - len(x) // 4 :])[1], None] for x in b.column(1).to_pylist()])

    found = dealt.select("id", "text", "range", "copy").mapInArrow(streamed, _OUT)
    return found.unionByName(rows.where(F.col("id").isNull()).mapInArrow(alone, _OUT)).withColumnRenamed("id", key)


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIELDS = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def op13_lempel_ziv(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return fingerprint_with_neighbours(table(spark, sf_dir, "documents"))
