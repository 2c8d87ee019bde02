"""Token counts from pre-token frequencies, without making ids.

A first pass finds the distinct pre-tokens of the corpus, and the tokenizer
counts the pieces of each once. A second pass takes each document's pre-token
frequencies and joins the counts to them. The join is split by frequency: the
commonest pre-tokens, of a fixed number, are sent to all tasks and summed at
once, so no frequent key is shuffled; the frequencies of all others go, packed
per batch of documents and bucket of pre-tokens, to a join by bucket. Sums per
document are then put together. Nothing is left out by the split.

Cases: null text counts as empty (0 bytes, 0 tokens); each input row is counted
on its own, so repeated ids and rows stay separate; null ids pass through;
special strings inside a text count as the library's default has them, one
token each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SPACE, chunks
from .common import materialize
from .op04_bpe import slices

#: Documents of a batch; pre-tokens whose counts are sent to all tasks, at most; pre-tokens of a bucket, about.
BATCH, COMMON, BUCKET = 1000, 100_000, 100_000
#: Chunks that a worker remembers; bounds memory only.
REMEMBERED = 300_000


class PreTokens:
    """Cuts chunks to pre-tokens; special strings are pre-tokens of their own."""

    def __init__(self, pattern: str, special: tuple[str, ...]):
        import regex

        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.strings = special

    def cut(self, text: str) -> list[str]:
        if not any(x in text for x in self.strings):
            return self.pattern.findall(text)
        parts = self.special.split(text)
        return [t for i, p in enumerate(parts) for t in ([p] if i % 2 else self.pattern.findall(p))]

    def frequencies(self, text: str | None) -> dict[str, int]:
        out: dict[str, int] = {}
        for chunk in chunks(text or ""):
            for t in self.cut(chunk):
                out[t] = out.get(t, 0) + 1
        return out


class Summer:
    """Sums the counts of common pre-tokens, and lists the others, chunk by chunk."""

    def __init__(self, cutter: PreTokens, common: dict[str, int]):
        self.cutter, self.common = cutter, common
        self.sums: dict[str, int] = {}
        self.rare: dict[str, list[str]] = {}

    def batch(self, texts: list[str | None]) -> tuple[list[int], list[tuple[int, list[str]]]]:
        """Per text its sum over common pre-tokens; (text, its other pre-tokens, repeated as often as they stand)."""
        totals, others = [], []
        for i, x in enumerate(texts):
            row = chunks(x or "")
            for c in {c for c in row if c not in self.sums}:
                cut = self.cutter.cut(c)
                rare = [t for t in cut if t not in self.common]
                self.sums[c] = sum(self.common[t] for t in cut if t in self.common)
                if rare:
                    self.rare[c] = rare
            totals.append(sum(map(self.sums.__getitem__, row)))
            rare = [t for c in row if c in self.rare for t in self.rare[c]]
            if rare:
                others.append((i, rare))
            if len(self.sums) > REMEMBERED:
                self.sums, self.rare = {}, {}
        return totals, others


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def special_strings(path: str) -> tuple[str, ...]:
    return tuple(sorted((t.content for t in library(path).get_added_tokens_decoder().values()), key=lambda x: (-len(x), x)))


def distinct_pieces(docs: DataFrame, pattern: str, special: tuple[str, ...], text: str = "text") -> DataFrame:
    """(piece binary, seen long): each pre-token of the corpus, with the number of batches it was seen in."""

    def run(batches):
        cutter = PreTokens(pattern, special)
        for whole in batches:
            for b in slices(whole, 4 * BATCH):
                found: set[str] = set()
                for x in b.column(0).to_pylist():
                    found.update(chunks(x or ""))
                rows = list({t for c in found for t in cutter.cut(c)})
                for at in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([t.encode() for t in rows[at : at + 50_000]], pa.binary())], ["piece"])

    return docs.select(text).mapInArrow(run, "piece binary").groupBy("piece").agg(F.count("*").alias("seen"))


def count_pieces(pieces: DataFrame, path: str) -> DataFrame:
    """(piece, seen, n int): tokens of each piece, by the library."""

    def run(batches):
        tok = library(path)
        for whole in batches:
            for b in slices(whole, 5000):
                rows = tok.encode_batch_fast([x.decode() for x in b.column(0).to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x.ids) for x in rows], pa.int32())], ["piece", "seen", "n"])

    return pieces.mapInArrow(run, "piece binary, seen long, n int")


def _second_pass(docs: DataFrame, pattern: str, special: tuple[str, ...], common, buckets: int, key: str, text: str) -> DataFrame:
    """(batch, bucket, pieces, sizes, at, ids, bytes, sums): per batch one row of its documents (bucket null), and
    one per bucket that lists its rarer pre-tokens, with the documents they stand in."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["batch", "bucket", "pieces", "sizes", "at", "ids", "bytes", "sums"]

    def run(batches):
        import xxhash

        summer, n = Summer(PreTokens(pattern, special), common.value), 0
        for whole in batches:
            for b in slices(whole, BATCH):
                batch, n = (TaskContext.get().partitionId() << 24) + n, n + 1
                texts = b.column(1).to_pylist()
                totals, others = summer.batch(texts)
                packed: dict[int, tuple[list[bytes], list[int]]] = {}
                for i, rare in others:
                    for t in rare:
                        raw = t.encode()
                        at = packed.setdefault(xxhash.xxh64_intdigest(raw) % buckets, ([], []))
                        at[0].append(raw)
                        at[1].append(i)
                held = list(packed.items())
                ids, length = pa.nulls(len(held), pa.list_(b.column(0).type)), pa.nulls(len(held), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch] * (len(held) + 1), pa.int64()), pa.array([k for k, _ in held] + [None], pa.int32()),
                        pa.array([b"".join(v[0]) for _, v in held] + [None], pa.binary()),
                        pa.array([np.array(list(map(len, v[0])), np.uint32).tobytes() for _, v in held] + [None], pa.binary()),
                        pa.array([np.array(v[1], np.uint16).tobytes() for _, v in held] + [None], pa.binary()),
                        pa.concat_arrays([ids, pa.array([b.column(0).to_pylist()], ids.type)]),
                        pa.concat_arrays([length, pa.array([[len((x or "").encode()) for x in texts]], length.type)]),
                        pa.concat_arrays([length, pa.array([totals], length.type)]),
                    ],
                    names,
                )

    return docs.select(key, text).mapInArrow(run, f"batch long, bucket int, pieces binary, sizes binary, at binary, ids array<{kind}>, bytes array<long>, sums array<long>")


def _bucket(piece: pa.Array, buckets: int) -> pa.Array:
    import xxhash

    return pa.array([xxhash.xxh64_intdigest(x) % buckets for x in piece.to_pylist()], pa.int32())


def _rare_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """(batch, at array<int>, sums array<long>): a bucket's pre-tokens joined to their counts, summed per document."""
    count = dict(zip(right["piece"].to_pylist(), right["n"].to_pylist(), strict=True))
    out = [], []
    for raw, sizes, at in zip(left["pieces"].to_pylist(), left["sizes"].to_pylist(), left["at"].to_pylist(), strict=True):
        ends = np.cumsum(np.frombuffer(sizes, np.uint32)).tolist()
        n = [count[raw[i:j]] for i, j in zip([0, *ends], ends, strict=False)]
        total = np.bincount(np.frombuffer(at, np.uint16), weights=n).astype(np.int64)
        some = np.flatnonzero(total)
        out[0].append(some.astype(np.int32))
        out[1].append(total[some])
    return pa.table({"batch": left["batch"], "at": pa.array(out[0], pa.list_(pa.int32())), "sums": pa.array(out[1], pa.list_(pa.int64()))})


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row."""
    special = special_strings(path)
    counted = materialize(count_pieces(distinct_pieces(docs, pattern, special, text), path), "token-pieces")
    # Buckets follow the distinct pre-tokens, and how often batches hold them, so that neither side of one grows with the corpus.
    n, seen = counted.agg(F.count("*"), F.coalesce(F.sum("seen"), F.lit(0))).first()
    buckets = max(8, -(-n // BUCKET), -(-seen // (4 * BUCKET)))
    top = counted.orderBy(F.desc("seen"), "piece").limit(COMMON).select("piece", "n").toArrow()
    common = dict(zip((x.decode() for x in top["piece"].to_pylist()), top["n"].to_pylist(), strict=True))
    sent = docs.sparkSession.sparkContext.broadcast(common)
    passed = materialize(_second_pass(docs, pattern, special, sent, buckets, key, text), "token-batches")

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([_bucket(b.column(0), buckets), b.column(0), b.column(1)], ["bucket", "piece", "n"])

    known = counted.select("piece", "n").mapInArrow(place, "bucket int, piece binary, n int")
    rare = passed.where("bucket is not null").select("batch", "bucket", "pieces", "sizes", "at")
    rare = rare.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_rare_sums, "batch long, at array<int>, sums array<long>")
    rare = rare.select("batch", F.explode(F.arrays_zip("at", "sums")).alias("x")).groupBy("batch", F.col("x.at").alias("at")).agg(F.sum("x.sums").alias("more"))
    rows = passed.where("bucket is null").select("batch", F.posexplode(F.arrays_zip("ids", "bytes", "sums")).alias("at", "x"))
    total = F.col("x.sums") + F.coalesce("more", F.lit(0))
    return rows.join(rare, ["batch", "at"], "left").select(F.col("x.ids").alias(key), F.col("x.bytes").alias("n_bytes"), total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers as tokenizers_of

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), path or tokenizers_of.path("byte_bpe_50k.json"), tokenizers_of.PATTERN)
