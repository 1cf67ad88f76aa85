"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of an Arrow batch handed to a Python function: alike for all operators, as Spark reads the
#: setting when a plan runs, not when it is made.
BATCH_ROWS, BATCH_BYTES = 4096, "4m"
#: Most bytes that may be broadcast; larger sides are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on this machine
    in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a ``materialize`` that nothing will read again."""
    session = df.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Caches that Python workers keep from task to task: the operator's name and what empties its own.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(work: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task. Workers are used again by later operators: the caches of all but ``keeps`` are
    emptied before, and memory that is free then goes back to the machine behind it."""

    def task(batches: Iterator) -> Iterator:
        for name, empty in KEPT.items():
            if name != keeps:
                empty()
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
            ctypes.CDLL(None).malloc_trim(0)

    return task


def sized_join(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int | Column) -> DataFrame:
    """Join with a written table, broadcasting it only when the sum of its rows' ``row_bytes`` is within BROADCAST_BYTES."""
    row_bytes = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    if (small.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


#: Pairs of a key's rows that one task makes.
PAIRS_AT_ONCE = 1 << 20


def salted_join(big: DataFrame, small: DataFrame, on: str, row_bytes: int | Column) -> DataFrame:
    """Inner join of written tables. Where ``small`` is too large for a broadcast, a key with over PAIRS_AT_ONCE pairs of rows is
    split: the rows of ``big`` are dealt to parts, and those of ``small`` go to each."""
    row_bytes = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    if (small.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on)
    pairs, parts = F.col("_big") * F.col("_small"), F.coalesce(F.col("_parts"), F.lit(1))
    hot = big.groupBy(on).agg(F.count(F.lit(1)).alias("_big")).join(small.groupBy(on).agg(F.count(F.lit(1)).alias("_small")), on)
    hot = materialize(hot.filter(pairs > PAIRS_AT_ONCE).select(on, F.ceil(pairs / PAIRS_AT_ONCE).alias("_parts")))
    left = sized_join(big, hot, on, "left", 64).withColumn("_part", F.pmod(F.xxhash64(*big.columns), parts)).drop("_parts")
    right = sized_join(small, hot, on, "left", 64).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [on, "_part"]).drop("_part")


def as_key(col: Column) -> Column:
    """A value as a text that is never null: pandas would turn whole numbers with a null among them into floats."""
    return F.when(col.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), col.cast("string")))


def from_key(col: Column, kind: str) -> Column:
    return F.when(col != "-", F.substring(col, 2, 1 << 30)).cast(kind)


_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed odd number modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _POWERS[:] = [
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]).astype(np.uint64))
            for base in (_ODD, inverse)
        ]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once, but for a longer single range.
SPAN = 1 << 20


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), which are in order and apart. A range's hash depends on its bytes alone."""
    if len(data) <= SPAN:
        return _range_hashes(data, starts, ends)
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        upto = max(k + 1, int(np.searchsorted(ends, starts[k] + SPAN, "right")))
        a, b = starts[k], ends[upto - 1]
        out[k:upto] = _range_hashes(data[a:b], starts[k:upto] - a, ends[k:upto] - a)
        k = upto
    return out


def _range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return sequence_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end) of unsigned numbers, from one prefix sum of powers."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[1:], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``word_byte`` (256 booleans) marks."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = word_byte[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
