"""The training-corpus pipeline: language, repeated lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, langid, line_dedup, packing, simhash
from siltstone.llm.common import as_key, materialize, sized_join

#: A text whose best language has a lower pooled probability is in none of the languages.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters, or in none of the languages learned from the labelled rows."""
    net = langid.fit(docs.filter(~langid.held_out("doc_id", 3, 1)))
    seen = langid.identify(docs, net)
    return seen.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines; a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs).filter((F.col("lines_cut") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col("lines_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of texts that SimHash fingerprints link, or that are alike at 0.8 or more: that of the smallest id, null ids
    last. Of rows that repeat outright one stays."""
    return simhash.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a benchmark passage. A row is known by its id and text, so that rows without an id go like
    others and of rows that share an id only those with the passage."""
    key = F.concat(as_key(F.col("doc_id")), F.lit("|"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("key")
    found = decontaminate.contaminated(docs.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    gone = materialize(found.select("key").distinct())
    return sized_join(docs.select(key, *docs.columns), gone, "key", "left_anti", 64).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("pack", pack),
]
#: Language scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return materialize(STAGES[-1][1](spark, docs, sf_dir))
