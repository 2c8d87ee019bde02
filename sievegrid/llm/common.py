"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches

#: What this Python worker remembers, for one operator at a time.
_HELD: dict = {}
#: Parquet folders written by `materialize` in this process, for `release`.
_WRITTEN: list[str] = []


#: Seconds after which a worker that begins no task forgets what it remembers; an executor keeps idle workers.
IDLE = 15.0
_TIMER: list[threading.Timer] = []


def forget() -> None:
    """Drops what this worker remembers, and gives the memory back to the machine."""
    _HELD.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives memory that nothing uses back to the machine; Arrow's pool gives back what the calling thread took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, which trims the worker's memory before and after: an executor keeps idle workers beside those at work."""

    def trimmed(batches):
        trim()
        yield from run(batches)
        trim()

    return trimmed


def held(kind: str, key, make: Callable):
    """What `make` returns, remembered by this worker for the next tasks; what it held for another operator, or key, goes."""
    while _TIMER:
        _TIMER.pop().cancel()
    value = _HELD.get((kind, key))
    if value is None:
        forget()
        value = _HELD[kind, key] = make()
    _TIMER.append(threading.Timer(IDLE, forget))
    _TIMER[0].daemon = True
    _TIMER[0].start()
    return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, on one
    machine (tests), a temporary folder is made and set; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sievegrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and what it
    holds survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/sievegrid-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievegrid_path = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for frames, when nothing reads it any more.

    Shuffle files go when the driver's collector finds their plans unused, which
    on an idle driver may be much later than their last use; so it is asked to look.
    """
    for df in frames:
        path = df._sievegrid_path
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Delete what `materialize` wrote; call once the results are consumed."""
    n = 0
    while _WRITTEN:
        n += _delete(spark, _WRITTEN.pop())
    return n


def settle(kept: DataFrame, mark: int) -> None:
    """Delete what `materialize` wrote since `written()` was mark, but for kept, which has been made from it."""
    for path in _WRITTEN[mark:]:
        if path != kept._sievegrid_path:
            _WRITTEN.remove(path)
            _delete(kept.sparkSession, path)


def written() -> int:
    """How many folders of `materialize` stand."""
    return len(_WRITTEN)


#: Bits of the largest bitmap of keys (16 MB), and of a piece of it; places a key.
_BITS, _PIECE, _PLACES = 1 << 27, 1 << 19, 16


def key_bitmap(keys: DataFrame, column: str):
    """A broadcast bitmap of hashed keys (a long column), or None where there are too many for one of _BITS.

    Its pieces are made in the cluster; the driver gets the bits only, 16 MB at most.
    """
    n = keys.count()
    if n * 4 > _BITS:
        return None
    bits = min(_BITS, max(_PIECE, 1 << (_PLACES * n).bit_length()))

    def piece(rows: pa.Table) -> pa.Table:
        out = np.zeros(_PIECE, bool)
        out[rows["at"].to_numpy() % _PIECE] = True
        return pa.table({"piece": rows["piece"].slice(0, 1), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = keys.select(at.alias("at"), F.floor(at / _PIECE).alias("piece")).groupBy("piece").applyInArrow(piece, "piece long, bits binary").toArrow()
    whole = np.zeros(bits // 8, np.uint8)
    for i, b in zip(rows["piece"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        whole[i * _PIECE // 8 : (i + 1) * _PIECE // 8] = np.frombuffer(b, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def sifted(df: DataFrame, column: str, bitmap, held: bool = True) -> DataFrame:
    """The rows of df whose key stands in the bitmap, and some more by chance; or those whose key surely doesn't.

    It goes before a join, so that rows without a partner aren't shuffled. Null keys stand in no bitmap.
    """
    if bitmap is None:
        return df if held else df.limit(0)

    def run(batches):
        bits = bitmap.value
        for b in (whole.slice(i, 2000) for whole in batches for i in range(0, whole.num_rows, 2000)):
            key = b.column(b.schema.get_field_index(column))
            at = key.fill_null(0).to_numpy().astype(np.int64) & (8 * len(bits) - 1)
            there = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & ~key.is_null().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(there == held))

    return df.mapInArrow(lean(run), df.schema)
