"""N-gram Jaccard self-join as a blocked sparse product of documents by n-grams.

Rows of the incidence matrix are distinct shingle sets (documents with equal
sets are one row, so copies never meet each other). Of each row only the columns
that any partner must share are multiplied: the first n - ceil(t n) + 1 of its
n-grams in one order of all n-grams, rarest kind first. Column blocks are
multiplied one per task; the products' partial overlaps are summed per pair, and
pairs whose sum stays below what their sizes demand are dropped. What is left is
verified on the texts themselves.

Before that, pairs are held against bitmaps of the sets, one bit or less per
n-gram in twice as many places or more: n-grams of one set in places where the
other has none aren't common, and pairs that can't reach the similarity with the
others go, without a text having moved.

Frequent n-grams, counted in a sample of texts, come last in the order,
so boilerplate that many documents share rarely is a column at all. Where such a
column, or any longer than WIDE, remains (rows made of boilerplate, large groups
of near copies), its rows are not multiplied pair by pair: each is compared with
the column's least row, and then those rows that are not yet connected to most
of their group (rows that share wide columns) are multiplied with the others, in
tiles over all their columns, one per task, which return spanning links only.
No link between two components is lost, and connected rows need no further
proof. The order and these limits change the work, never the result.

Words are runs of other than ASCII white space, A-Z lowered; a set holds the
distinct n-word shingles as 64-bit hashes, or the whole sequence if it is
shorter. Cases: null, empty and blank texts have the empty set and link with
nothing; rows are documents of their own, also where they repeat a doc_id with
the same or another text; a component is named by its least doc_id, and null
only if none of its rows has one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held as remembered, key_bitmap, lean, materialize, sifted
from .components import components
from .op04_bpe import slices

#: Rows of a column beyond which it is compared by its least row first.
WIDE = 128
#: Sets of the sample that share an n-gram, at least, for it to be frequent; corpus count, as estimated, from which it is ordered last.
SEEN, FREQUENT = 4, 48
#: One text of so many, at most, is in that sample; and n-grams of a table for each step up to it.
SHARE, SMALL = 16, 2_000_000
#: Most n-grams that are ordered last (8 bytes each, sent to all tasks); with more, FREQUENT rises.
FREQUENT_MOST = 1_000_000
#: Rows of half a tile, about.
TILE = 256
#: Postings of a column block, about, and pairs made of it at a time, about.
BLOCK, PAIRS = 1_000_000, 2_000_000


_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Words that are mixed at a time, few enough for a processor's cache.
_AT_ONCE = 16_384


def _mix(x: np.ndarray, room: np.ndarray) -> None:
    """Mixes x in place; room: of the same size."""
    for shift, factor in ((30, _MIX[0]), (27, _MIX[1]), (31, None)):
        np.right_shift(x, np.uint64(shift), out=room)
        np.bitwise_xor(x, room, out=x)
        if factor is not None:
            np.multiply(x, factor, out=x)


def _hashed(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    room = np.empty(_AT_ONCE, np.uint64)
    for at in range(0, len(out), _AT_ONCE):
        x = out[at : at + _AT_ONCE]
        for i in range(k):
            np.add(x, words[at + i : at + i + len(x)], out=x)
            np.add(x, np.uint64(i + 1), out=x)
            _mix(x, room[: len(x)])
    return out


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its n-word shingles; each distinct word of the batch is hashed once."""
    import xxhash

    # Large offsets, as the texts of a batch may be more than 2 GB; Arrow's white space is \x09-\x0D and \x20, as bytes.split has it.
    # Rows are taken first, as ascii_lower reads the wrong bytes of a slice.
    own = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    split = pc.ascii_split_whitespace(pc.ascii_lower(own.fill_null("")))
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    words = split.flatten().dictionary_encode()
    known = words.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    code = words.indices.to_numpy()
    # Before the first and after the last white space stands an empty word, which is none.
    real = np.fromiter((x != b"" for x in known), bool, len(known))[code]
    ends = np.append(0, np.cumsum(real))[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]
    h = hashes[code[real]]
    size = np.diff(ends)
    whole = _hashed(h, n)
    # Runs that begin in one text and end in another go; a text of fewer words is one run.
    last = np.maximum(ends[1:] - n + 1, ends[:-1])
    rows, first = [], ends[:-1].tolist()
    for i, j, m in zip(first, last.tolist(), size.tolist(), strict=True):
        s = whole[i:j] if m >= n else _hashed(h[i : i + m], m) if m else np.empty(0, np.uint64)
        s.sort()
        rows.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return rows


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles."""
    return shingle_sets(pa.array([text], pa.string()), n)[0]


def prefix_size(n, t: int):
    return n - -(-t * n // 100) + 1


def _signatures(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(doc_id, n, k, tid) per row: set size, set hash and text hash."""

    def run(batches):
        import xxhash

        remembered("ngram", None, object)  # what the worker holds for another operator goes
        for whole in batches:
            for b in slices(whole, 1000):
                sets = shingle_sets(b.column(1), n)
                hashes = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.int64()), b.column(2)], ["doc_id", "n", "k", "tid"])

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(lean(run), "doc_id long, n long, k long, tid long")


def _frequent(docs: DataFrame, text: str, n: int, total: int) -> DataFrame:
    """(h, c): frequent n-grams and how many texts of a sample have them. The sample serves the order of n-grams only; total: of all sets' sizes."""
    share = max(1, min(SHARE, total // SMALL))

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1000):
                sets = {s.tobytes(): s for s in shingle_sets(b.column(0), n)}
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets.values(), np.empty(0, np.uint64)]).view(np.int64))], ["h"])

    found = docs.where(F.pmod(F.xxhash64(text), F.lit(share)) == 0).select(text).mapInArrow(lean(run), "h long")
    return found.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= max(SEEN, FREQUENT / share))


def _postings(docs: DataFrame, text: str, n: int, t: int, blocks: int, late) -> DataFrame:
    """(block, h, k, n, r binary): per batch and column block the prefix columns, k and n once per run of r of them.

    h is half of the n-gram's hash, as the block stands for the other; columns
    that fall together are one, which adds pairs and loses none. Columns of
    frequent n-grams, h their place among these, are in blocks below 0, by k.
    """

    def run(batches):
        import xxhash

        last = late.value
        for whole in batches:
            for b in slices(whole, 2000):
                sets = {}
                for s in shingle_sets(b.column(0), n):
                    if len(s):
                        sets[xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)] = s
                if not sets:
                    continue
                hs, ns, blocks_of = [], [], []
                for k, s in sets.items():
                    p = prefix_size(len(s), t)
                    at = np.searchsorted(last, s)
                    heavy = last[np.minimum(at, len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                    chosen = s[~heavy][:p]
                    rest = at[heavy][: p - len(chosen)]
                    hs += [chosen.astype(np.uint32), rest.astype(np.uint32)]
                    ns.append(len(chosen) + len(rest))
                    blocks_of += [(chosen >> np.uint64(32)).astype(np.int64) % blocks, np.full(len(rest), -1 - k % blocks)]
                h, block = np.concatenate(hs), np.concatenate(blocks_of)
                k = np.repeat(np.array(list(sets), np.int64), ns)
                m = np.repeat(np.array([len(s) for s in sets.values()], np.int32), ns)
                order = np.argsort(block, kind="stable")
                block, h, k, m = block[order], h[order], k[order], m[order]
                change = np.flatnonzero((np.diff(block, prepend=blocks) != 0) | np.append(True, k[1:] != k[:-1]))
                # Runs of 255 at most, so that their lengths are bytes.
                run_at = np.flatnonzero((np.arange(len(k)) - np.repeat(change, np.diff(np.append(change, len(k))))) % 255 == 0)
                runs = np.diff(np.append(run_at, len(k))).astype(np.uint8)
                first = np.flatnonzero(np.diff(block[run_at], prepend=blocks))
                ends = np.append(first[1:], len(run_at))
                edge = np.append(run_at, len(k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[run_at[first]].astype(np.int32)),
                        pa.array([h[edge[i] : edge[j]].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()),
                        *(pa.array([v[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for v in (k[run_at], m[run_at], runs)),
                    ],
                    ["block", "h", "k", "n", "r"],
                )

    return docs.select(text).mapInArrow(lean(run), "block int, h binary, k binary, n binary, r binary")


def _unpacked(columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, k, n) of columns h, k, n, r."""
    h, k, n, r = (np.concatenate([np.frombuffer(x, kind) for x in c]) for c, kind in zip(columns, (np.uint32, np.int64, np.int32, np.uint8), strict=True))
    return h, np.repeat(k, r), np.repeat(n, r)


_PAIRS = "a long, b long, n_a int, n_b int, c int, h long"


def _product(t: int):
    """Multiplies a column block: pairs (a, b, c) with partial overlaps, n_a <= n_b; rows (a, n_a, h) of wide columns, and of all frequent ones, with b null."""

    def out(a, b, na, nb, c, h):
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(na), nb, c, h], ["a", "b", "n_a", "n_b", "c", "h"])

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, block = ([], [], [], []), 0
        for g in groups:
            block = g.column(0)[0].as_py() if g.num_rows else block
            for i, into in enumerate(columns):
                into += g.column(i + 1).to_pylist()
        h, k, n = _unpacked(columns)
        order = np.lexsort((k, n, h))
        h, k, n = h[order], k[order], n[order]
        same = np.append(False, (h[1:] == h[:-1]) & (k[1:] == k[:-1]))
        h, k, n = h[~same], k[~same], n[~same]

        def rows(h, k, n):
            w = len(h)
            return out(k, pa.nulls(w, pa.int64()), n, pa.nulls(w, pa.int32()), pa.nulls(w, pa.int32()), pa.array(h))

        if block < 0:
            yield rows(-1 - h.astype(np.int64), k, n)
            return
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, int)
        size = np.diff(np.append(start, len(h)))
        shared = np.repeat(size > 1, size)
        h, k, n, size = h[shared], k[shared], n[shared], size[size > 1]
        wide = np.repeat(size > WIDE, size)
        if wide.any():
            yield rows((block << 32) + h[wide].astype(np.int64), k[wide], n[wide])
        column = np.repeat(np.arange(len(size)), size)
        column[wide] = -1 - np.flatnonzero(wide)
        # Columns are multiplied some at a time, so what a task holds is bounded; overlaps are summed per pair later on.
        many, ends = np.where(size > WIDE, 0, size * (size - 1) // 2), np.cumsum(size)
        part = np.cumsum(many) // PAIRS
        for last in np.flatnonzero(np.diff(part, append=-1)):
            before = np.flatnonzero(part < part[last])
            lo, hi = (int(ends[before[-1]]) if len(before) else 0), int(ends[last])
            col, ks, ns, found = column[lo:hi], k[lo:hi], n[lo:hi], []
            for step in range(1, hi - lo):
                i = np.flatnonzero(col[step:] == col[:-step])
                if not len(i):
                    break
                i = i[100 * ns[i].astype(np.int64) >= t * ns[i + step].astype(np.int64)]
                found.append(np.stack([i, i + step]))
            if not found:
                continue
            x, y = np.concatenate(found, axis=1)
            order = np.lexsort((ks[y], ks[x]))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.append(True, (ks[x][1:] != ks[x][:-1]) | (ks[y][1:] != ks[y][:-1])) if len(x) else np.empty(0, bool))
            count = np.diff(np.append(first, len(x))).astype(np.int32)
            for i in range(0, len(first), 100_000):
                u, v = x[first[i : i + 100_000]], y[first[i : i + 100_000]]
                yield out(ks[u], pa.array(ks[v]), ns[u], pa.array(ns[v]), pa.array(count[i : i + 100_000]), pa.nulls(len(u), pa.int64()))

    return run


def _verify(pairs: DataFrame, texts: DataFrame, n: int, t: int) -> DataFrame:
    """Those pairs (a, b) of set hashes whose texts reach the similarity."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 500):
                ok = []
                for s, u in zip(shingle_sets(b.column(2), n), shingle_sets(b.column(3), n), strict=True):
                    both = len(np.intersect1d(s, u, assume_unique=True))
                    ok.append(100 * both >= t * (len(s) + len(u) - both))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("k").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("k").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _bits(h: np.ndarray, room: int = 2) -> np.ndarray:
    """A bitmap of a set in a power of two of places, `room` times its size or more."""
    m = 1 << max(6, (room * len(h) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[(h & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def _most(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
    """No less than the n-grams that sets of bitmaps x, y and sizes n, m have in common."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size)) for v in (x, y))
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _possible(pairs: DataFrame, held: DataFrame, t: int) -> DataFrame:
    """Those of pairs (a, b) whose bitmaps allow the similarity."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1000):
                ok = []
                for x, n, y, m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                    both = _most(np.frombuffer(x, np.uint8), n, np.frombuffer(y, np.uint8), m)
                    ok.append(100 * both >= t * (n + m - both))
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = held.select(F.col("k").alias("a"), F.col("bits").alias("x"), F.col("n").alias("n_x"))
    right = held.select(F.col("k").alias("b"), F.col("bits").alias("y"), F.col("n").alias("n_y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "n_x", "y", "n_y").mapInArrow(lean(run), "a long, b long")


def _held(texts: DataFrame, n: int) -> DataFrame:
    """(k, n, bits) of the sets of texts (column text), with their bitmaps.

    Sets become bitmaps where their texts are read, so no text moves; equal sets are one row.
    """

    def run(batches):
        import xxhash

        for whole in batches:
            for b in slices(whole, 1000):
                sets = {xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63): s for s in shingle_sets(b.column(0), n) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([len(s) for s in sets.values()], pa.int32()), pa.array([_bits(s).tobytes() for s in sets.values()], pa.binary())], ["k", "n", "bits"])

    found = texts.select("text").mapInArrow(lean(run), "k long, n int, bits binary")
    return found.groupBy("k").agg(*(F.any_value(c).alias(c) for c in ("n", "bits")))


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(k, grams binary) of (k, text)."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1000):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(b.column(1), n)], pa.binary())], ["k", "grams"])

    return texts.select("k", "text").mapInArrow(lean(run), "k long, grams binary")


def _tile(t: int):
    """Links of a tile: (a, b) with the least row that a reaches inside it, for rows of other blocks than their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(list(batches)).sort_by("k").combine_chunks()
        k, block = g["k"].to_numpy(), g["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in g["grams"].to_pylist()]
        size = np.array([len(s) for s in sets])
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(sets)), size), count > 1
        place = np.cumsum(shared) - 1
        row, column = row[shared[column]], place[column[shared[column]]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(shared.sum()), 4096):
            i, j = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[i:j], column[i:j] - at] = 1
            both += part @ part.T
        both = both.astype(np.int64)
        near = 100 * both >= t * (size[:, None] + size[None, :] - both)
        if g["low"][0].as_py() != g["high"][0].as_py():
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        label = np.arange(len(k))
        while True:
            new = np.minimum(label, np.where(near, label[None, :], len(k)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = label != np.arange(len(k))
        yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(k[label][some])], ["a", "b"])

    return run


def _meet(t: int):
    """Those rows of a tile (grp, low, high, block, k, n, bits) that may reach the similarity with one of the other block, by their bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(list(batches)).combine_chunks()
        n, block = g["n"].to_numpy().astype(np.int64), g["block"].to_numpy()
        bits = [np.frombuffer(x, np.uint8) for x in g["bits"].to_pylist()]
        size = min(map(len, bits))
        bits = np.stack([np.bitwise_or.reduce(x.reshape(-1, size)) for x in bits])
        both = np.zeros((len(n), len(n)), np.float32)
        for at in range(0, size, 1024):
            part = np.unpackbits(bits[:, at : at + 1024], axis=1).astype(np.float32)
            both += part @ part.T
        room = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        both = both.astype(np.int64) + np.minimum(room[:, None], room[None, :])
        may = 100 * both >= t * (n[:, None] + n[None, :] - both)
        if g["low"][0].as_py() != g["high"][0].as_py():
            may &= block[:, None] != block[None, :]
        np.fill_diagonal(may, False)
        yield from g.select(["grp", "low", "high", "block", "k"]).filter(pa.array(may.any(axis=1))).to_batches()

    return run


#: Blocks of a size band, at most, for their numbers; a power of two.
_BAND = 1 << 24


def _open_groups(wide: DataFrame, joined: DataFrame, held: DataFrame, texts_of, n: int, t: int) -> DataFrame:
    """Links between components among rows that share wide columns.

    Of each group of rows, the largest component so far is connected already;
    all others are multiplied with it and with each other, tile by tile. Rows
    stand in blocks of a band of sizes, so that sizes of a link's ends are of
    one band or of two that touch. Tiles get bitmaps first, and the sets of
    those rows only that may have a link there.
    """
    pivots = wide.groupBy("h").agg(F.min("k").alias("p"))
    groups = components(wide.join(pivots, "h").select(F.col("k").alias("a"), F.col("p").alias("b")), "ngram-groups")
    rows = groups.select(F.col("node").alias("k"), F.col("component").alias("grp")).join(joined.select(F.col("node").alias("k"), F.col("component").alias("g")), "k", "left").withColumn("g", F.coalesce("g", "k"))
    rows = materialize(rows.join(held.select("k", "n"), "k"), "ngram-open")
    parts = rows.groupBy("grp", "g").count().groupBy("grp").agg(F.max_by("g", F.struct("count", "g")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("grp", "main")
    band = F.floor(F.log("n") / (math.log(100 / t) * (1 + 1e-9) + 1e-6))
    rows = rows.join(parts, "grp").withColumn("kind", 2 * band + (F.col("g") == F.col("main")).cast("long"))
    counts = rows.groupBy("grp", "kind").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    rows = rows.join(counts, ["grp", "kind"]).withColumn("block", F.col("kind") * _BAND + F.pmod(F.xxhash64("k"), F.col("blocks"))).drop("blocks")
    first = F.col("kind") - F.col("kind") % 2 - 2
    touching = F.filter(F.sequence(first, first + 5), lambda x: (x % 2 == 0) | (F.col("kind") % 2 == 0))
    others = counts.select("grp", F.col("kind").alias("kind2"), "blocks")
    rows = rows.withColumn("kind2", F.explode(touching)).join(others, ["grp", "kind2"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.col("kind2") * _BAND, F.col("kind2") * _BAND + F.col("blocks") - 1)))
    tiles = rows.select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "k").join(held, "k")
    met = tiles.select("grp", "low", "high", "block", "k", "n", "bits").groupBy("grp", "low", "high").applyInArrow(_meet(t), "grp long, low long, high long, block long, k long")
    met = materialize(met, "ngram-met")
    return met.join(_sets(texts_of(met.select("k")), n), "k").groupBy("grp", "low", "high").applyInArrow(_tile(t), "a long, b long")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, g, tid) for every row of docs: g is the component itself, also where no row of it has an id, tid the hash of the text; ids must be integers."""
    spark, t = docs.sparkSession, percent
    signed = materialize(_signatures(docs, key, text, n), "ngram-signatures")
    rows = signed
    # The text of a set is that of its row with the least doc_id.
    sets = rows.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min_by("tid", F.struct(F.col("doc_id").isNull(), "doc_id", "tid")).alias("tid"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    late = _frequent(docs, text, n, total).orderBy(F.desc("c"), "h").limit(FREQUENT_MOST).select("h").toArrow().column("h").to_numpy()
    late = spark.sparkContext.broadcast(np.sort(late.astype(np.int64).view(np.uint64)))
    blocks = max(8, math.ceil(total * (100 - t) / 100 / BLOCK))
    product = materialize(_postings(docs, text, n, t, blocks, late).groupBy("block").applyInArrow(_product(t), _PAIRS), "ngram-product")
    wide = product.where("b is null").select("h", F.col("a").alias("k"), F.col("n_a").alias("n"))
    wide = materialize(wide.join(wide.groupBy("h").count().where("count > 1").select("h"), "h"), "ngram-wide")
    # Pairs of narrow columns: the summed overlap must reach what sizes demand of the prefixes.
    narrow = (
        product.where("b is not null").groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("c").cast("int").alias("c"))
        .where(f"c >= ceil({t} * (n_a + n_b) / {100 + t}) - ceil({t} * n_b / 100) + 1")
    )
    pivots = wide.groupBy("h").agg(F.min(F.struct("k", "n")).alias("p"))
    spokes = wide.join(pivots, "h").where(f"k <> p.k and 100 * least(n, p.n) >= {t} * greatest(n, p.n)").select(F.col("p.k").alias("a"), F.col("k").alias("b")).distinct()
    pairs = materialize(narrow.select("a", "b", "c").unionByName(spokes.withColumn("c", F.lit(0))), "ngram-pairs")
    discard(product)
    named = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).union(wide.select("k")).distinct()
    of = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    wanted = materialize(sets.join(named, "k", "left_semi").select("k", F.col("rep"), F.col("tid").alias("t")), "ngram-wanted")
    held = materialize(_held(sifted(of, "tid", key_bitmap(wanted, "t")), n), "ngram-bitmaps")

    def texts_of(keys: DataFrame) -> DataFrame:
        """(k, text) of those sets (column k); only their texts move."""
        some = materialize(wanted.join(keys.distinct(), "k", "left_semi"), "ngram-needed")
        found = sifted(of, "tid", key_bitmap(some, "t")).join(some, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tid") == F.col("t")))
        return found.groupBy("k").agg(F.min("text").alias("text"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("k")).union(pairs.select("b"))

    # First each row with the one it shares most with, and the spokes of wide columns: they connect groups of near copies,
    # whose other pairs then need no bitmaps or texts.
    best = pairs.where("c > 0").groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
    some = best.union(pairs.where("c = 0").select("a", "b")).distinct()
    possible = materialize(_possible(some, held, t), "ngram-possible")
    first = materialize(_verify(possible, texts_of(ends(possible)), n, t), "ngram-links")
    joined = materialize(components(first, "ngram-first"), "ngram-joined")

    def label(df: DataFrame, col: str, to: str) -> DataFrame:
        return df.join(joined.select(F.col("node").alias(col), F.col("component").alias(to)), col, "left").withColumn(to, F.coalesce(to, col))

    left = label(label(pairs.where("c > 0").select("a", "b"), "a", "g_a"), "b", "g_b").where("g_a <> g_b").select("a", "b").join(best, ["a", "b"], "left_anti")
    left = materialize(_possible(left, held, t), "ngram-left")
    more = _verify(left, texts_of(ends(left)), n, t)
    second = materialize(more.union(_open_groups(wide, joined, held, texts_of, n, t)), "ngram-more")
    discard(pairs, wanted, held, wide, possible, left, joined)
    # Components of sets, named by the least doc_id of all their documents.
    links = materialize(components(first.union(second), "ngram-final"), "ngram-components")
    discard(first, second)
    group = sets.select("k", "rep").join(links.withColumnRenamed("node", "k"), "k", "left").select("k", "rep", F.coalesce("component", "k").alias("g"))
    names = group.join(links.select("component").distinct().withColumnRenamed("component", "g"), "g", "left_semi").groupBy("g").agg(F.min("rep").alias("name"))
    named = group.join(names, "g", "left").select("k", "g", F.coalesce("name", "rep").alias("component"))
    return rows.join(named, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "g", "tid")


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: of its least doc_id, and of rows that share that the one of the least text hash.

    Rows without words all stay. Columns pass through, whatever their names.
    """
    found = ngram_components(docs, n, percent, key, text).where("n_shingles > 0").groupBy("doc_id", "tid").agg(F.first("g").alias("g"), F.count("*").alias("m"))
    found = materialize(found, "ngram-found")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tid")
    marked = found.join(found.groupBy("g").agg(F.min(place).alias("p")), "g").select(F.col("doc_id").alias("__near_doc"), F.col("tid").alias("__near_tid"), (place == F.col("p")).alias("__near_first"), "m")
    marked = materialize(marked.where("m > 1 or not __near_first").drop("m"), "ngram-marked")
    discard(found)
    # Rows that no mark can be for pass as they are, without a shuffle.
    bitmap, named = key_bitmap(marked, "__near_tid"), docs.withColumn("__near_key", F.xxhash64(text))
    open_ = sifted(named, "__near_key", bitmap)
    same = F.col(key).cast("long").eqNullSafe(F.col("__near_doc")) & (F.col("__near_key") == F.col("__near_tid"))
    once = open_.join(marked, same, "left_anti")
    # Rows that stand several times: one of each.
    again = open_.join(marked.where("__near_first"), same).dropDuplicates(["__near_doc", "__near_tid"])
    return sifted(named, "__near_key", bitmap, held=False).select(docs.columns).unionByName(once.select(docs.columns)).unionByName(again.select(docs.columns))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return ngram_components(table(spark, sf_dir, "documents")).drop("g", "tid")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id
"""
