"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are encoded and cut only where longer than a sequence. Full pieces are
sequences of their own; the others are dealt to blocks of bounded size. Several
islands evolve each block: a chromosome is the grouping of the block's pieces
into bins, crossover injects whole well-filled bins of one parent into another,
removes what they duplicate, and puts the displaced pieces back by best fit.
Between epochs each island receives the elite of its neighbour. In every epoch
a whole generation of offspring is bred and selected, each child against the
population; an epoch that has reached the lower bound of bins stops after one
generation, others when PATIENCE children in a row brought nothing. The bins that stay poorly filled in
each block are pooled and packed again, until one block holds them all.

Cases: null text counts as empty and is one token, the end id; rows with the
same doc_id are packed each on its own; null ids pass through; ties are broken
by the order of rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memo, words
from .common import held, lean, materialize
from .op04_bpe import slices

CAPACITY = 4096
#: Pieces of a block, islands of a block, epochs with migration between, chromosomes and most offspring of an epoch, and those without gain that end it.
BLOCK, ISLANDS, EPOCHS, POPULATION, OFFSPRING, PATIENCE = 12_000, 2, 2, 6, 80, 20
#: Words, or pre-tokens, of a generation that a worker remembers; bounds memory only.
REMEMBERED = 150_000
#: Bins filled less than this share are pooled for another level.
POOLED = 0.97
LEVELS = 12

#: The pre-tokens of files that split as word_bpe_49k does.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable ASCII, and letters that no normal form changes and that Python and the library lower alike.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters that stand for bytes in byte-level models.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}

#: Bytes of Latin-1 text: those of plain text, what each is in lower case (white space: a space), and its class.
_SPACES = b"\t\n\x0b\x0c\r "
_PLAIN_BYTES = _SPACES + "".join(c for c in map(chr, range(256)) if _PLAIN.fullmatch(c)).encode("latin-1")
_LOWER = bytes(32 if b in _SPACES else ord(chr(b).lower()) if b in _PLAIN_BYTES else b for b in range(256))
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.array([_SPACE if b in _SPACES else _LETTER if chr(b).isalpha() else _DIGIT if chr(b) in "0123456789" else _SIGN for b in range(256)], np.uint8)
#: Bytes of plain texts that are cut and looked up at once, and at most one text more.
_AT_ONCE = 2 << 20


def plain_parts(data: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of lower plain text, and the runs of spaces between them, begin; the text ends with three spaces."""
    kind = _CLASS[data]
    begins = np.append(True, kind[1:] != kind[:-1]) | (kind == _DIGIT)
    sign = np.flatnonzero((data == ord("'")) & begins)
    one, two = data[sign + 1], data[sign + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    begins[sign[short | long] + 1] = False
    begins[sign[short] + 2] = True
    begins[sign[long] + 3] = True
    return np.flatnonzero(begins)


class WordIds:
    """Ids of texts by a tokenizers file that drops white space; memo per distinct word, or pre-token of plain texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo, self.parts = Memo(self._encode, REMEMBERED), Memo(self._by_model, REMEMBERED)
        normal = json.loads(self.library.to_str())["normalizer"] or {}
        steps = {n["type"] for n in normal.get("normalizers", [normal]) if n}
        # Where the library lowers letters itself, ASCII texts may come to it lowered: fewer words are distinct.
        self.lowers = steps <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in steps
        self.strings = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Plain texts may go to the model by pre-token, without the library's normalizer and splitter.
        split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
        steps = (json.loads(self.library.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.direct = self.lowers and steps[:1] == [split] and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in steps[1:]] == [("ByteLevel", False, False)]
        self.model, self.special = self.library.model, re.compile("|".join(re.escape(t.lower()) for t in self.strings) or "(?!)")

    def _words(self, text: str) -> list[str]:
        if self.lowers and text.isascii():
            low = text.lower()
            if not any(t in low for t in self.strings):
                return words(low)
        return words(text)

    def _plain(self, text: str) -> bytes | None:
        """A plain text in lower case, in Latin-1; None for other texts, and where special strings may stand."""
        if not self.direct:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, _PLAIN_BYTES):
            return None
        low = raw.translate(_LOWER)
        return None if self.special.search(low.decode("latin-1")) else low

    def _by_model(self, new: list[bytes]) -> list[bytes]:
        """Ids of each pre-token of plain text; none of a run of spaces."""
        out = []
        for part in new:
            shown = part.decode("latin-1")
            if not shown.isascii():
                shown = shown.encode().decode("latin-1").translate(_BYTES)
            out.append(b"" if shown.isspace() else array("I", [t.id for t in self.model.tokenize(shown)]).tobytes())
        return out

    def _of_plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each plain text: all are cut at once, and each distinct pre-token is looked up once."""
        data = np.frombuffer(b" ".join([*texts, b"  "]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        at = plain_parts(data)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        distinct, code = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        found = list(map(self.parts.get, distinct))
        new = [i for i, x in enumerate(found) if x is None]
        self.parts.fill([[distinct[i] for i in new]])
        for i in new:
            found[i] = self.parts[distinct[i]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = (np.cumsum(size) - size)[code], size[code]
        upto = np.cumsum(n)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first - upto + n, n) + np.arange(n.sum())]
        cut = np.append(0, upto)[np.searchsorted(at, np.append(0, ends))].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]

    def _encode(self, new: list[str]) -> list[bytes]:
        """Ids of each word."""
        low = [self._plain(word) for word in new]
        plain = iter(self._of_plain([x for x in low if x is not None]))
        rest = iter(self._by_library([word for word, x in zip(new, low, strict=True) if x is None]))
        return [next(rest if x is None else plain) for x in low]

    def _by_library(self, new: list[str]) -> list[bytes]:
        """Ids of each word: many are encoded as one text, and the places of its tokens tell whose they are."""
        out = []
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            first = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            cut = (4 * np.searchsorted(first, np.append(np.cumsum(size) - size, 1 << 60))).tolist()
            data = np.array(found.ids, "<u4").tobytes()
            out += [data[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        return out

    def _by_word(self, texts: list[str]) -> list[bytes]:
        rows = [self._words(x) for x in texts]
        get = self.memo.get
        found = [list(map(get, row)) for row in rows]
        self.memo.fill({w for w, x in zip(row, ids, strict=True) if x is None} for row, ids in zip(rows, found, strict=True))
        get = self.memo.__getitem__
        return [b"".join([get(w) if x is None else x for w, x in zip(row, ids, strict=True)]) for row, ids in zip(rows, found, strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        low = [self._plain(x) if x else b"" for x in texts]
        plain = [i for i, x in enumerate(low) if x]
        upto = np.cumsum([len(low[i]) for i in plain]) // _AT_ONCE
        groups = [g.tolist() for g in np.split(np.array(plain, int), np.flatnonzero(np.diff(upto)) + 1)]
        for group in groups:
            for i, ids in zip(group, self._of_plain([low[i] for i in group]), strict=True):
                out[i] = ids
        rest = [i for i, x in enumerate(low) if x is None]
        for i, ids in zip(rest, self._by_word([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


def word_ids(path: str) -> WordIds:
    return held("packing", path, lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece int, start long, length long, ids binary): documents with their end id, cut at capacity."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encoder, end, step = word_ids(path), int(end_id).to_bytes(4, "little"), 4 * capacity
        for whole in batches:
            for b in slices(whole, 1000):
                at, piece, ids = [], [], []
                for i, x in enumerate(encoder.encode_batch(b.column(1).to_pylist())):
                    x += end
                    for p in range(0, len(x), step):
                        at.append(i)
                        piece.append(p // step)
                        ids.append(x[p : p + step])
                number = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    [key, "piece", "start", "length", "ids"],
                )

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, piece int, start long, length long, ids binary")


class Bins:
    """Bins by the room they have left, for best fit in constant time."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.items = capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.held = 0  # bit r: some bin has room r

    def open(self, items: list[int], room: int) -> None:
        self.items.append(items)
        self.room.append(room)
        self._put(len(self.room) - 1)

    def _put(self, b: int) -> None:
        r = self.room[b]
        self.by_room[r].append(b)
        self.held |= 1 << r

    def fit(self, item: int, size: int) -> None:
        above = self.held >> size
        if not above:
            self.open([item], self.capacity - size)
            return
        r = size + (above & -above).bit_length() - 1
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.held &= ~(1 << r)
        self.items[b].append(item)
        self.room[b] = r - size
        self._put(b)


def best_fit(order, sizes: list[int], capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    bins = Bins(capacity)
    for group in start:
        bins.open(list(group), capacity - sum(sizes[i] for i in group))
    for i in order:
        bins.fit(i, sizes[i])
    return bins.items


def fitness(groups: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the unevenness of their filling (full bins and a rest beat bins alike)."""
    return -len(groups), sum((sum(sizes[i] for i in g) / capacity) ** 2 for g in groups) / max(1, len(groups))


def crossover(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Injects well-filled bins of `other` into `one`; bins of `one` that share a piece with them, some others and the emptiest are dissolved."""
    filled = lambda g: sum(sizes[i] for i in g)
    full, share = sorted(other, key=filled, reverse=True), rng.uniform(0.1, 0.9)
    full = [g for g in full[: max(1, len(full) // 2)] if rng.random() < share] or full[:1]
    taken = {i for g in full for i in g}
    whole = sorted((g for g in one if taken.isdisjoint(g)), key=filled, reverse=True)
    kept = [g for g in whole[: max(0, len(whole) - 2)] if rng.random() > 0.02]
    held = taken.union(*kept)
    displaced = [i for g in one for i in g if i not in held]
    noise = rng.choice([0.0, 0.3])
    displaced.sort(key=(lambda i: -sizes[i] * (1 + noise * rng.random())) if noise else (lambda i: -sizes[i]))
    return best_fit(displaced, sizes, capacity, full + kept)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], born: list[int] | None = None) -> list[list[int]]:
    """The best grouping of one island after an epoch; elites: its own of the last epoch and its neighbour's; born gets the number of offspring."""
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    by_size = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rank = lambda g: fitness(g, sizes, capacity)
    population = [(rank(g), g) for g in elites]
    while len(population) < 2 or (len(population) < POPULATION and not any(len(g) <= bound for _, g in population)):
        noise = 0.3 * (len(population) + seed % 2) / POPULATION
        order = sorted(by_size, key=lambda i: -sizes[i] * (1 + noise * rng.random())) if noise else by_size
        g = best_fit(order, sizes, capacity)
        population.append((rank(g), g))
    population.sort(key=lambda x: x[0], reverse=True)
    n = stale = 0
    while n < OFFSPRING and stale < PATIENCE and not (n >= POPULATION and len(population[0][1]) <= bound):
        (_, one), (_, other) = rng.sample(population[: max(2, POPULATION // 2)], 2)
        child, best = crossover(one, other, sizes, capacity, rng), population[0][0]
        population.append((rank(child), child))
        population.sort(key=lambda x: x[0], reverse=True)
        del population[POPULATION:]
        n, stale = n + 1, 0 if population[0][0] > best else stale + 1
    if born is not None:
        born.append(n)
    return population[0][1]


def _groups(genes: bytes) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, g in enumerate(np.frombuffer(genes, np.int32).tolist()):
        out.setdefault(g, []).append(i)
    return list(out.values())


def _genes(groups: list[list[int]], n: int) -> bytes:
    out = np.empty(n, np.int32)
    for b, g in enumerate(groups):
        out[g] = b
    return out.tobytes()


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("length", "descending"), ("uid", "ascending")])


_STATE = "block long, island int, genes binary, bins int, filled double, born int, came int"
_EMPTY = {"block": pa.int64(), "island": pa.int32(), "genes": pa.binary(), "bins": pa.int32(), "filled": pa.float64(), "born": pa.int32(), "came": pa.int32()}


def _epoch(capacity: int, epoch: int):
    """An epoch of an island: its elite, the offspring born, and the elites that came from its neighbour."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in _EMPTY.items()})
        block, island = left["block"][0].as_py(), left["island"][0].as_py()
        sizes = _sorted(left)["length"].to_pylist()
        born: list[int] = []
        best = evolve(sizes, capacity, (block * 31 + island) * 31 + epoch, [_groups(x) for x in right["genes"].to_pylist()], born)
        bins, filled = fitness(best, sizes, capacity)
        values = block, island, _genes(best, len(sizes)), -bins, filled, born[0], sum(right["came"].to_pylist())
        return pa.table({k: pa.array([v], t) for (k, t), v in zip(_EMPTY.items(), values, strict=True)})

    return run


def _expand(left: pa.Table, right: pa.Table) -> pa.Table:
    """(uid, length, block, bin, offset, fill): a block's pieces in the bins of its best chromosome."""
    rows = _sorted(left)
    genes = np.frombuffer(right["genes"][0].as_py(), np.int32) if right.num_rows else np.empty(0, np.int32)
    size = rows["length"].to_numpy()[: len(genes)].astype(np.int64)
    order = np.argsort(genes, kind="stable")
    g, s = genes[order], size[order]
    ends = np.cumsum(s)
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, int)
    base = np.repeat((ends - s)[first], np.diff(np.append(first, len(g))))
    fill = np.bincount(genes, weights=size).astype(np.int64)[g] if len(g) else np.empty(0, np.int64)
    return pa.table({"uid": rows["uid"].combine_chunks().take(pa.array(order)), "length": pa.array(s), "block": pa.array(np.full(len(g), left["block"][0].as_py() if left.num_rows else 0, np.int64)), "bin": pa.array(g.astype(np.int64)), "offset": pa.array(ends - s - base), "fill": pa.array(fill)})


def _pack_level(items: DataFrame, blocks: int, capacity: int, level: int, report: list | None) -> DataFrame:
    """Evolves items (uid, length) in blocks; returns where each stands."""
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"))
    copies = dealt.select("*", F.explode(F.array(*(F.lit(i).cast("int") for i in range(ISLANDS)))).alias("island"))
    state = None
    for epoch in range(EPOCHS):
        if state is None:
            coming = copies.sparkSession.createDataFrame([], "block long, island int, genes binary, came int")
        else:
            own = state.select("block", "island", "genes", F.lit(0).alias("came"))
            coming = own.unionByName(own.withColumns({"island": ((F.col("island") + 1) % ISLANDS).cast("int"), "came": F.lit(1)}))
        state = copies.groupBy("block", "island").cogroup(coming.groupBy("block", "island")).applyInArrow(_epoch(capacity, epoch), _STATE)
        state = materialize(state, f"pack-elites-{level}-{epoch}")
        if report is not None:
            report.append({"level": level, "epoch": epoch} | state.agg(F.count("*").alias("islands"), F.min("born").alias("least_born"), F.sum("born").alias("born"), F.sum("came").alias("came")).first().asDict())
    best = state.groupBy("block").agg(F.min_by("genes", F.struct("bins", -F.col("filled"), "island")).alias("genes"))
    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_expand, "uid long, length long, block long, bin long, offset long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY, uid: str = "uid", length: str = "length", report: list | None = None) -> DataFrame:
    """(uid, sequence_id, offset) for items of distinct uid and a length of at most capacity.

    report gets, for each level and epoch, how many islands there were, and offspring and migrants in them.

    Full items stand alone. sequence_id: level, block and bin in one number, or
    -1 - uid for a full item.
    """
    items = items.select(F.col(uid).alias("uid"), F.col(length).cast("long").alias("length"))
    alone = items.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done = items.where(F.col("length") < capacity), [alone]
    for level in range(LEVELS):
        n = rest.count()
        if not n:
            break
        blocks = -(-n // BLOCK)
        placed = materialize(_pack_level(rest, blocks, capacity, level, report), f"pack-level-{level}")
        last = blocks == 1 or level == LEVELS - 1
        kept = placed if last else placed.where(F.col("fill") >= POOLED * capacity)
        done.append(kept.select("uid", (F.lit(level << 56) + F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        rest = placed.where(F.col("fill") < POOLED * capacity).select("uid", "length")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    cut = pieces(docs, path, capacity, end_id, key, text).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    cut = materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    return cut.join(pack(cut, capacity), "uid").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers as tokenizers_of

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), path or tokenizers_of.path("word_bpe_49k.json"))
