"""Images that are spread over several files: joined parts and interleaved halves or quarters."""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from ..sources.files import COMBINED, HEADER

#: Bytes of the beginning in which an interleaved image must show its text, and how much it must.
PROBE, RUN = 128 << 10, 8
#: Most bytes of the files of a group together.
MOST_BYTES = 512 << 20


def joined(files: DataFrame, group: str, name: str = "name", content: str = "content", most: int = MOST_BYTES) -> DataFrame:
    """(group, parts, content, event): the files of each group by name, one after the other; ``original.tm1`` comes right
    after ``original.tmp``. A group of more than ``most`` bytes has no content and the event ``too large``: it never meets in one task.
    """
    sizes = files.groupBy(group).agg(F.sum(F.octet_length(content)).alias("_all"), F.count(F.lit(1)).cast("int").alias("parts"))
    sized = sizes.withColumn("event", F.when(F.col("_all") > most, "too large"))
    rank = F.when(F.col(name) == "original.tm1", "original.tmq").otherwise(F.col(name))
    small = files.join(sized.filter("event is null").select(group), group, "left_semi")
    members = F.array_sort(F.collect_list(F.struct(rank.alias("n"), F.col(content).alias("c"))))
    whole = F.aggregate(F.transform("m", lambda x: x["c"]), F.lit(b"").cast("binary"), lambda a, c: F.concat(a, c))
    done = small.groupBy(group).agg(members.alias("m")).select(group, whole.alias("content"))
    return sized.join(done, group, "left").select(group, "parts", "content", "event")


def combined(files: DataFrame) -> DataFrame:
    """(group_id, parts, interleave_parts, header, content, event) of ``grouped`` files: all of a marked folder as one artifact, the mark
    files left out; a folder with a header only has its files each."""
    folders = files.filter((F.col("name") == COMBINED)).select("folder").distinct().withColumn("_one", F.lit(True))
    headers = files.filter(F.col("name") == HEADER).select("folder", F.col("content").alias("header"))
    parts = files.filter(~F.col("name").isin(COMBINED, HEADER)).join(folders, "folder", "left")
    parts = parts.withColumn("group_id", F.when(F.col("_one"), F.col("folder")).otherwise(F.col("path")))
    single = parts.filter("_one is null").select("group_id", F.lit(1).alias("parts"), "content", F.lit(None).cast("string").alias("event"), "folder", "interleave_parts")
    whole = joined(parts.filter("_one"), "group_id").join(parts.filter("_one").groupBy("group_id").agg(F.max("folder").alias("folder"), F.max("interleave_parts").alias("interleave_parts")), "group_id")
    return single.unionByName(whole.select(single.columns)).join(headers, "folder", "left").select("group_id", "parts", "interleave_parts", "header", "content", "event")


def by_stem(files: DataFrame) -> DataFrame:
    """Parts of one image: files of a folder whose names differ in the extension only, by that extension."""
    return joined(files.withColumn("image", F.concat_ws("/", "folder", F.lower(F.regexp_replace("name", r"\.[^.]*$", "")))), "image")


@F.pandas_udf(ArrayType(BinaryType()))
def orders(parts: pd.Series) -> pd.Series:
    """Every way to interleave two or four parts of one size, byte by byte."""

    def one(contents) -> list[bytes]:
        out = []
        for order in permutations(range(len(contents))):
            whole = bytearray(len(contents) * len(contents[0]))
            for k, at in enumerate(order):
                whole[k :: len(contents)] = contents[at]
            out.append(bytes(whole))
        return out

    return parts.map(one)


def interleaved(files: DataFrame, n: int = 2) -> DataFrame:
    """(folder, size, first, order, content): the images that ``n`` files of one size and folder, neighbours by name, may be.

    Every file is tried with the ``n`` - 1 files that follow it, so a stray file between others costs tries and loses no
    set of neighbours. An image counts whose beginning shows runs of text that its parts do not show.
    """
    w = Window.partitionBy("folder", "size").orderBy("name")
    names = files.filter("size > 0").select("folder", "size", "name")
    follow = names.withColumn("set", F.array("name", *[F.lead("name", k).over(w) for k in range(1, n)])).filter(F.element_at("set", n).isNotNull())
    members = follow.select("folder", "size", F.col("name").alias("first"), F.explode("set").alias("name"))
    sets = members.join(files.select("folder", "size", "name", "content"), ["folder", "size", "name"]).groupBy("folder", "size", "first")
    sets = sets.agg(F.array_sort(F.collect_list(F.struct("name", "content"))).alias("m")).filter(F.size("m") == n)
    images = sets.select("folder", "size", "first", F.posexplode(orders(F.transform("m", lambda x: x["content"]))).alias("order", "content"))
    text = F.decode(F.substring("content", 1, PROBE), "ISO-8859-1")
    return images.filter(text.rlike(f"[A-Za-z ]{{{RUN},}}"))
