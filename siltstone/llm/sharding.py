"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash and ranked within their stratum; a row of rank r among n gets the fractional
rank (r - u) / n, with one u between 0 and 1 for its stratum, so that strata of few rows are spread like others. Sorted by it, every stretch of the order holds the strata in the proportions of the whole,
so cutting the order into equal stretches gives shards that match the mixture.

Ranks are taken over hash buckets and their running counts, so no task holds a stratum, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_key, from_key

#: Buckets of a ranking; a task sorts the rows of some buckets. The tables of counts have at most this many rows a stratum.
BUCKETS = 8192
#: Distinct phases of strata.
PHASES = 1 << 20


def ranked(df: DataFrame, stratum: list[str], bucket: Column, order: list, rank: str) -> DataFrame:
    """Add the rank from 1 of each row within its stratum, by (bucket, order), and ``{rank}_of``, the stratum's rows.

    ``bucket`` must not decrease along the order.
    """
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*stratum) if stratum else Window.partitionBy()
    offsets = counts.select(
        *stratum,
        "_b",
        (F.sum("_n").over(within.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(within).alias(f"{rank}_of"),
    )
    row = F.row_number().over(Window.partitionBy(*stratum, "_b").orderBy(*order))
    return df.join(offsets, [*stratum, "_b"]).withColumn(rank, F.col("_before") + row).drop("_b", "_before")


def interleave_shards(
    df: DataFrame,
    shards: int = 40,
    stratum_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, stratum, shard, slot.

    size is the UTF-8 bytes of the text plus 16 (a null text has none), text_crc32 its unsigned CRC-32. Shards hold
    counts at most one apart; slots run from 0 in each shard. A null stratum is a stratum of its own. Repeated rows
    keep one place each; rows that tie in everything are interchangeable. An empty table gives no rows; other columns
    are not read.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = df.select(
        F.col(id_col).alias("_id"),
        as_key(F.col(stratum_col)).alias("_s"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), "_id", "text_crc32", "size"))
    tie = ["_h", "_id", "text_crc32", "size"]
    rows = ranked(rows, ["_s"], F.shiftright("_h", 64 - BUCKETS.bit_length() + 1), tie, "_rank")
    phase = (F.pmod(F.xxhash64(F.lit(seed), "_s"), F.lit(PHASES)) + 0.5) / PHASES
    rows = rows.withColumn("_frac", (F.col("_rank") - phase) / F.col("_rank_of"))
    rows = ranked(rows, [], F.floor(F.col("_frac") * BUCKETS), ["_frac", "_s", *tie], "_at")
    at, total = F.col("_at") - 1, F.col("_at_of")
    rows = rows.withColumn("_shard", F.floor(at * shards / total).cast("long"))
    # Division is in double; whole-number bounds put right a row beside a cut.
    first = lambda s: F.floor((s * total + (shards - 1)) / shards)
    rows = rows.withColumn(
        "_shard",
        F.col("_shard") + F.when(at >= first(F.col("_shard") + 1), 1).when(at < first(F.col("_shard")), -1).otherwise(0),
    )
    return rows.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        from_key(F.col("_s"), "string").alias("stratum"),
        F.col("_shard").cast("int").alias("shard"),
        (at - first(F.col("_shard"))).cast("long").alias("slot"),
    )
