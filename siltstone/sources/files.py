"""Sources: artifact trees, a signature table and the PCI identifier table, all read by Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the files that mark a folder as one artifact, and that hold its header. Hadoop opens no names with a colon in front.
COMBINED, HEADER = "combined.mark", "header.mark"


def scan_tree(spark: SparkSession, root: str, cap: int | None = None) -> DataFrame:
    """(path, folder, name, size, mtime, content, cut) of every file below ``root``, or of that file; contents are whole, or
    with a ``cap`` their first bytes, and then ``cut`` says of which."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        "path",
        F.regexp_replace("path", r"/[^/]*$", "").alias("folder"),
        F.regexp_extract("path", r"[^/]*$", 0).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        (F.substring("content", 1, cap) if cap else F.col("content")).alias("content"),
        (F.col("length") > cap if cap else F.lit(False)).alias("cut"),
    )


def grouped(files: DataFrame) -> DataFrame:
    """``files`` with ``group_id``: the folder if it holds a mark file, else the file itself; a mark's size of two or
    more is the number of interleaved parts. Folders are marked by names and sizes alone, so no contents are moved."""
    marks = files.filter(F.col("name").isin(COMBINED, HEADER)).groupBy("folder")
    marks = marks.agg(F.max(F.when(F.col("name") == COMBINED, F.col("size"))).alias("_mode"), F.lit(True).alias("_marked"))
    out = files.join(marks, "folder", "left").withColumn("group_id", F.when(F.col("_marked"), F.col("folder")).otherwise(F.col("path")))
    return out.withColumn("interleave_parts", F.when(F.col("_mode") >= 2, F.col("_mode").cast("int"))).drop("_mode", "_marked")


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """(key, place, from_end, pattern) of a signature file: one quoted entry a line, its six pairs of hexadecimal
    address and pattern from the sixth column on; addresses count from 0x100000, the end of the image."""
    lines = spark.read.text(path).filter(F.col("value").startswith("known_bios("))
    cells = F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    rows = lines.select(cells.alias("c")).filter(F.size("c") >= 17)
    pairs = rows.select(F.concat(F.get("c", 0), F.lit("\n"), F.get("c", 1)).alias("key"), F.posexplode(F.sequence(F.lit(0), F.lit(5))).alias("place", "k"), "c")
    address, text = F.get("c", 5 + 2 * F.col("k")), F.get("c", 6 + 2 * F.col("k"))
    pattern = F.when(text.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(text)).otherwise(F.encode(F.replace(text, F.lit("ú"), F.lit("\0")), "ISO-8859-1"))
    return pairs.select("key", "place", (F.conv(address, 16, 10).cast("long") - 0x100000).alias("from_end"), pattern.alias("pattern")).filter("length(pattern) > 0")


def pci_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line, top, mid) of a pci.ids file, comments and empty lines left out: the last lines without and with one tab up to
    each. The file is one small table, read whole as a row so that its lines keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("n", "line"))
    lines = lines.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    order = Window.partitionBy(F.spark_partition_id()).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda p: F.last(F.when(F.col("line").rlike(p), F.col("line")), ignorenulls=True).over(order)
    return lines.withColumn("top", last(r"^\S")).withColumn("mid", last(r"^\t[^\t]"))


def _name(c: str, pattern: str, k: int) -> Column:
    return F.when(F.col(c).rlike(pattern), F.regexp_extract(c, pattern, k))


def _id(c: str, pattern: str, k: int = 1) -> Column:
    return F.conv(_name(c, pattern, k), 16, 10).cast("int")


def pci_ids(spark: SparkSession, path: str) -> DataFrame:
    """(vendor_id, device_id, vendor, device) of a pci.ids file; vendors have a row without device."""
    head, device = r"^([0-9a-f]{4})  (.*)$", r"^\t([0-9a-f]{4})  (.*)$"
    # Classes follow the vendors and start with "C ".
    rows = pci_lines(spark, path).filter(F.col("top").rlike(head) & ~F.col("line").rlike(r"^\t\t"))
    return rows.select(_id("top", head).alias("vendor_id"), _id("line", device).alias("device_id"), _name("top", head, 2).alias("vendor"), _name("line", device, 2).alias("device"))


def pci_subsystems(spark: SparkSession, path: str) -> DataFrame:
    """(vendor_id, device_id, subvendor_id, subdevice_id, name) of a pci.ids file."""
    head, device, sub = r"^([0-9a-f]{4})  (.*)$", r"^\t([0-9a-f]{4})  (.*)$", r"^\t\t([0-9a-f]{4}) ([0-9a-f]{4})  (.*)$"
    rows = pci_lines(spark, path).filter(F.col("top").rlike(head) & F.col("line").rlike(sub))
    return rows.select(_id("top", head).alias("vendor_id"), _id("mid", device).alias("device_id"), _id("line", sub).alias("subvendor_id"), _id("line", sub, 2).alias("subdevice_id"), _name("line", sub, 3).alias("name"))


def pci_classes(spark: SparkSession, path: str) -> DataFrame:
    """(class, subclass, interface, name) of a pci.ids file; the numbers below a class or subclass are null in its own row."""
    head, sub, face = r"^C ([0-9a-f]{2})  (.*)$", r"^\t([0-9a-f]{2})  (.*)$", r"^\t\t([0-9a-f]{2})  (.*)$"
    rows = pci_lines(spark, path).filter(F.col("top").rlike(head))
    below = F.col("line").startswith("\t")
    return rows.select(
        _id("top", head).alias("class"), F.when(below, _id("mid", sub)).alias("subclass"), _id("line", face).alias("interface"),
        F.coalesce(_name("line", face, 2), _name("line", sub, 2), _name("line", head, 2)).alias("name"),
    )


def pci_names(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``df`` (vendor_id, device_id) with names; unknown ones are ``[Unknown]``, or blank for a device of an unknown vendor."""
    vendors = ids.filter("device_id is null").select("vendor_id", "vendor")
    devices = ids.filter("device_id is not null").select("vendor_id", "device_id", "device")
    out = df.join(vendors, "vendor_id", "left").join(devices, ["vendor_id", "device_id"], "left")
    device = F.coalesce("device", F.when(F.col("vendor").isNotNull(), "[Unknown]").otherwise(""))
    return out.withColumn("device", device).withColumn("vendor", F.coalesce("vendor", F.lit("[Unknown]")))
