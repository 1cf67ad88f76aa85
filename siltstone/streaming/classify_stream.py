"""Classification of artifacts as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import as_latin1, classify

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as a stream."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(root)


def findings(files: DataFrame) -> DataFrame:
    return classify(files, as_latin1(F.col("content"))).filter("finding is not null").select("path", F.col("modificationTime").alias("time"), "finding.*")


def vendor_counts(found: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Findings by vendor and time window; files older than the watermark are left out."""
    return found.withWatermark("time", late).groupBy(F.window("time", window), "vendor").agg(F.count(F.lit(1)).alias("files"))


def write_findings(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the findings of new files to a Parquet table, each file once."""
    return findings(arriving(spark, root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
