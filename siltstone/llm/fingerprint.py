"""Document fingerprints from content-defined chunks.

A gear hash runs over the bytes of a text; a chunk ends where its low bits are zero, with a strict mask before the
normal size and a loose one after it, so sizes gather round the normal size. Boundaries depend on the bytes near them
only, so an insertion moves but does not change the chunks behind it. The fingerprint of a text is the set of its
chunks' digests with their lengths; containment is the shared length over the document's own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_key, from_key, mix64, range_hashes, small_batches, tidy

SMALLEST, NORMAL, LARGEST = 16, 32, 128
STRICT_BITS, LOOSE_BITS = 6, 3
#: Bytes that a boundary depends on.
REACH = 32
GEAR = mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)


def chunk_ends(data: np.ndarray, smallest: int = SMALLEST, normal: int = NORMAL, largest: int = LARGEST) -> list[int]:
    """The ends of the chunks of a byte array; none falls within a UTF-8 character unless a chunk reaches ``largest``."""
    n = len(data)
    if n <= smallest:
        return [n] if n else []
    h = GEAR.astype(np.uint32)[data]
    span = 1
    while span < REACH:
        h[span:] += h[:-span].copy() << np.uint32(span)
        span *= 2
    h >>= np.uint32(16)
    inner = np.ones(n, bool)
    inner[:-1] = (data[1:] & 0xC0) != 0x80
    loose_at = np.flatnonzero(((h & np.uint32((1 << LOOSE_BITS) - 1)) == 0) & inner)
    strict = (loose_at[(h[loose_at] & np.uint32((1 << STRICT_BITS) - 1)) == 0] + 1).tolist()
    loose = (loose_at + 1).tolist()
    ends, at = [], 0
    while n - at > smallest:
        k = bisect_left(strict, at + smallest)
        end = strict[k] if k < len(strict) and strict[k] <= at + normal else 0
        if not end:
            k = bisect_right(loose, at + normal)
            end = min(n, at + largest, loose[k] if k < len(loose) else n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct chunk digests of a text in rising order (48 bits), and the bytes of each chunk."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ends = np.array(chunk_ends(data), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    digests = range_hashes(data, starts, ends) >> np.uint64(16)
    digests, first = np.unique(digests, return_index=True)
    return digests, (ends - starts)[first]


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of a's bytes in chunks that b has too; 1 if both are empty, 0 if a alone is."""
    if not len(a[0]):
        return float(not len(b[0]))
    return float(a[1][np.isin(a[0], b[0], assume_unique=True)].sum() / a[1].sum())


def printed(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """12 hex digits of digest and 2 of length for each chunk, by digest."""
    digests, lengths = chunks
    cells = np.concatenate([digests.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:], lengths.astype(np.uint8)[:, None]], axis=1)
    return cells.tobytes().hex()


def with_successors(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with ``_g``, a range of ids, and ``_copy``; each range's first id is there again as a copy at the end of
    the range before it, and the very first at the end of the last.

    Ranges are cut at quantiles of the id, in a fixed proportion to the shuffle partitions; one row a range reaches
    the driver. Null ids come first.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.filter(F.col(id_col).isNotNull()).approxQuantile(id_col, [k / n for k in range(1, n)], 0.5 / n)))
    bounds = F.lit(cuts) if cuts else F.array().cast("array<double>")
    number = F.when(F.col(id_col).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c <= F.col(id_col)))).cast("int")
    lows = df.groupBy(number.alias("g")).agg(F.min(F.struct(F.col(id_col).isNotNull(), F.col(id_col).alias("id"))).alias("low")).collect()
    lows.sort(key=lambda r: r["g"])
    heads = [(r["low"]["id"], lows[k - 1]["g"]) for k, r in enumerate(lows)]
    kind = df.schema[id_col].dataType.simpleString()
    heads = F.broadcast(spark.createDataFrame(heads, f"_head {kind}, _before int"))  # a row for each range
    df = df.withColumn("_own", number).join(heads, F.col(id_col).eqNullSafe(F.col("_head")) & F.col("_before").isNotNull(), "left")
    places = F.array(F.struct(F.col("_own").alias("g"), F.lit(False).alias("copy")))
    places = F.when(F.col("_before").isNull(), places).otherwise(
        F.concat(places, F.array(F.struct(F.col("_before").alias("g"), F.lit(True).alias("copy"))))
    )
    df = df.withColumn("_place", F.explode(places))
    return df.withColumn("_g", F.col("_place.g")).withColumn("_copy", F.col("_place.copy")).drop("_own", "_head", "_before", "_place")


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of the code points replaced by the first as many of the next document's, by
    rising id; the first follows the last. near_edited and near_next are the shares of the text's bytes whose chunks
    the edited text, or the next document, has too. A null text is an empty one; empty texts have an empty
    fingerprint, 1 like each other and 0 like others. Rows with equal ids follow each other by text; null ids come
    first; a row alone follows itself. An empty table gives no rows; other columns are not read. Ids are numbers.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_successors(rows, "id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_g")
    rows = rows.sortWithinPartitions("_g", "_copy", F.col("id").asc_nulls_first(), "text")

    rows = rows.withColumn("id", as_key(F.col("id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            out = []
            for g, copy, key, text in zip(b["_g"], b["_copy"], b["id"], b["text"]):
                chunks = None
                if held is not None and held[0] == g:
                    chunks = chunk_set(text)
                    out.append(_row(held, text, chunks))
                    held = None
                if not copy:
                    held = (g, key, text, chunks or chunk_set(text))
            yield pd.DataFrame(out, columns=COLUMNS)

    out = rows.mapInPandas(
        tidy(run), "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumn("id", from_key(F.col("id"), kind)).withColumnRenamed("id", id_col)


COLUMNS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(held: tuple, text: str, chunks: tuple[np.ndarray, np.ndarray]) -> tuple:
    _, key, own, own_chunks = held
    cut = len(own) // 4
    edited = own[: len(own) - cut] + text[:cut]
    edited_chunks = chunk_set(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return (key, len(own), digest, printed(own_chunks), printed(edited_chunks), containment(own_chunks, edited_chunks), containment(own_chunks, chunks))
