"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank file becomes a sentencepiece BPE model: each of the 256 bytes is mapped
to one printable character, each token is the piece of its mapped bytes with
minus its rank as score, and normalisation is the identity. Merging the best
scored neighbours is then merging the lowest ranks, as the rank file means it.
Pre-tokens that are tokens themselves take that id at once, as the rank
tokenizer does; all others go through the model. Decoding maps ids back to bytes.

Cases: null text counts as empty and gives no ids; rows are independent, so
repeated rows and ties need no rule; null keys pass through; other columns of
the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SPACE, Memo, chunks
from .common import held

#: One character for each byte value; none is white space or special to the model.
BYTE_CHARS = [chr(0x100 + b) for b in range(256)]
_TO_CHARS = dict(enumerate(BYTE_CHARS))
#: The same, but byte FF, which UTF-8 text never holds, is a character that no piece has.
_BARRED = _TO_CHARS | {0xFF: "\u2400"}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def map_bytes(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model; piece i + 1 is the i-th token by rank."""
    unknown, normal, bpe = 2, 1, 2
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, map_bytes(token).encode()) + _field(2, float(-rank)) + _field(3, normal))
    none = (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(k, none) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids (unsigned 32-bit, little-endian bytes) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.order = np.array(sorted(ranks.values()), np.uint32)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.memo = Memo(self._encode)
        self.pieces = [b""] * (int(max(self.order, default=-1)) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def pre_tokens(self, text: str) -> list[str]:
        return self.split.findall(text)

    def _encode(self, new: list[str]) -> list[bytes]:
        """Ids of each chunk: all their pre-tokens go through the model in one call, with a barrier between."""
        cut = list(map(self.split.findall, new))
        flat = [t.encode() for row in cut for t in row]
        ids = np.array(self.model.encode(b"\xff".join(flat).decode("latin-1").translate(_BARRED)), np.int64)
        barriers = np.flatnonzero(ids == 0)
        first = np.append(0, barriers + 1 - np.arange(1, len(barriers) + 1))
        ranks = np.append(self.order[ids[ids > 0] - 1], np.uint32(0))
        size = np.diff(np.append(first, len(ranks) - 1))
        data = ranks.tobytes()
        at = np.append(first, len(ranks) - 1)[np.append(0, np.cumsum([len(row) for row in cut]))]
        at = (4 * at).tolist()
        out = [data[i:j] for i, j in zip(at, at[1:], strict=False)]
        # A pre-token that is itself a token takes its id, even if merges don't lead there.
        whole = {i for i in np.flatnonzero(size > 1).tolist() if flat[i] in self.ranks}
        if whole:
            n = 0
            for k, row in enumerate(cut):
                own = range(n, n := n + len(row))
                if not whole.isdisjoint(own):
                    out[k] = b"".join(self.ranks[flat[i]].to_bytes(4, "little") if i in whole else data[4 * first[i] : 4 * (first[i] + size[i])] for i in own)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        rows = [chunks(x) if x else [] for x in texts]
        self.memo.fill(rows)
        get = self.memo.__getitem__
        return [b"".join(map(get, row)) for row in rows]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I").tolist())) if ids else b""


def codec(path: str, pattern: str) -> Codec:
    return held("bpe", (path, pattern), lambda: Codec(read_ranks(path), pattern))


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for b in slices(whole):
                ids = c.encode_batch(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    [key, "n_tokens", "ids"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded binary) from what `encode` returns."""

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for b in slices(whole):
                raw = [c.decode(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [key, "n_tokens", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "n_tokens", "ids").mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary, decoded binary")


def op4_bpe_roundtrip(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers as tokenizers_of

    from .common import table

    path = path or tokenizers_of.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path, tokenizers_of.PATTERN), path, tokenizers_of.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
