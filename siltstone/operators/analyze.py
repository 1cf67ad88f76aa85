"""The whole analysis of a file tree: groups, joined members, side findings, the rule chain, names of ROMs, result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_device, clean_vendor, pnp_id
from ..sources.files import COMBINED, HEADER, grouped, pci_names, scan_tree
from .assemble import combined
from .classify import as_latin1, classify
from .features import rom_ids, scanned, side_metadata
from .vendors import entry

#: Bytes of an artifact that rules and scans look at.
CONTENT_CAP = 16 << 20
#: Stands for a vendor and device that are those of the line before.
AGAIN = "\u2196"


def peeled(paths: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, shown): each path without its last levels of unpacking whose folders are among ``marks`` (folder), up to the first that is not."""
    parts = F.split("path", ":/")
    levels = paths.select("path", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("k", "_"), parts.alias("s")).drop("_")
    levels = levels.withColumn("folder", F.concat(F.array_join(F.slice("s", F.lit(1), F.col("k") + 1), ":/"), F.lit(":")))
    kept = levels.join(marks.select("folder", F.lit(True).alias("_marked")), "folder", "left").filter("_marked is null")
    kept = kept.groupBy("path").agg(F.max("k").alias("k"))
    last = F.coalesce(F.col("k") + 2, F.lit(1))
    return paths.join(kept, "path", "left").select("path", F.array_join(F.slice(parts, F.lit(1), last), ":/").alias("shown"))


def artifacts(files: DataFrame) -> DataFrame:
    """(path, shown, interleave_parts, header, content, named) of a file tree's groups: ``shown`` is the path without the folders of
    unpacking that are one artifact each, and ``named`` has the ids in the names of their ROM files."""
    marked = grouped(files)
    ids = marked.select("group_id", rom_ids(F.col("name")).alias("r")).filter("r is not null")
    ids = ids.groupBy("group_id").agg(F.array_distinct(F.collect_list("r")).alias("named"))
    made = combined(marked).join(ids, "group_id", "left").withColumnRenamed("group_id", "path")
    # A group that is such a folder ends with the mark of one.
    whole = made.select("path").distinct().withColumn("path", F.when(F.col("path").endswith(":"), F.concat("path", F.lit("/"))).otherwise(F.col("path")))
    shown = peeled(whole, marked.filter(F.col("name").isin(COMBINED, HEADER)).select("folder").distinct()).withColumn("path", F.regexp_replace("path", ":/$", ":"))
    return made.join(shown, "path", "left")


def named_roms(roms: DataFrame, ids: DataFrame) -> DataFrame:
    """``roms`` (path, k and the fields of a ROM) with ``line``, its line in the list of its artifact's, in the order of ``k``.

    PCI devices get their names, of which a vendor's is blank where it repeats the line before, and a mark stands for
    both where both repeat; an unknown device 0 has no line.
    """
    rows, pci = pci_names(roms, ids), F.col("vendor_id").isNotNull()
    shown = pci & ((F.col("device") != "[Unknown]") | (F.col("device_id") != 0))
    rows = rows.withColumn("_v", F.when(shown, clean_vendor(F.col("vendor")))).withColumn("_d", F.when(shown, clean_device(F.col("device"), F.col("_v"))))
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    rows = rows.withColumn("_same", F.coalesce((F.col("_v") != "[Unknown]") & (last("_v") == F.col("_v")), F.lit(False)))
    rows = rows.withColumn("_both", F.col("_same") & F.coalesce(last("_d") == F.col("_d"), F.lit(False)))
    hexa = lambda c: F.lower(F.lpad(F.hex(F.col(c)), 4, "0"))
    vendor = F.when(F.col("_both"), AGAIN).when(F.col("_same"), F.repeat(F.lit(" "), F.length("_v"))).otherwise(F.col("_v"))
    device = F.concat(F.lit("["), hexa("vendor_id"), F.lit(":"), hexa("device_id"), F.lit("] "), vendor, F.lit(" "), F.when(F.col("_both"), "").otherwise(F.col("_d")))
    tagged = lambda tag: F.concat(F.lit("["), tag, F.lit("] "), F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(tag) + 3))))
    line = F.when(shown, device).when(F.col("number").isNotNull(), tagged(pnp_id(F.col("number")))).when(F.col("label").isNotNull(), tagged(F.col("label")))
    return rows.withColumn("line", line).drop("_v", "_d", "_same", "_both")


def shown_path(path: Column, root: str) -> Column:
    """A group's path below ``root``, without the folder that held the outputs of unpacking."""
    below = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(path)
    return F.regexp_replace(F.regexp_replace(below, "^0/", ""), ":$", "")


def results(items: DataFrame, ids: DataFrame, root: str = "") -> DataFrame:
    """(file, vendor, version, string, signon, metadata, roms), one row per artifact of ``items`` that a rule or a ROM is found in.

    ``items`` has path, interleave_parts, header, content and named, and maybe ``shown``, as ``artifacts`` makes them. Side findings are made
    for every artifact; one that no rule takes is a row only if it has ROMs, and then without metadata. Lines are
    distinct and sorted. Null contents give no rows.
    """
    items = items.filter("content is not null").withColumn("content", F.substring("content", 1, CONTENT_CAP))
    made = classify(items, as_latin1(F.col("content")), header=F.col("header")).withColumn("_scan", scanned("content"))
    own = F.transform(F.coalesce("named", F.array().cast("array<struct<vendor_id:int,device_id:int>>")), lambda n: F.struct(n["vendor_id"].cast("long").alias("rank"), n["vendor_id"].alias("vendor_id"), n["device_id"].alias("device_id"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("text")))
    parts = F.when(F.col("interleave_parts") > 2, F.concat(F.lit("Interleaved"), F.col("interleave_parts").cast("string"))).when(F.col("interleave_parts") == 2, "Interleaved")
    lines = F.concat(side_metadata(as_latin1(F.col("content")), F.col("_scan"), F.col("header")), F.coalesce("finding.metadata", F.array().cast("array<string>")), F.array(entry("ROM", parts)))
    lines = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.rtrim(x)), lambda x: x.isNotNull()))), "\n")
    made = made.select(
        "path", (F.coalesce("shown", "path") if "shown" in items.columns else F.col("path")).alias("shown"), "finding", F.array_sort(F.array_distinct(F.concat(own, "_scan.roms"))).alias("_roms"), F.when(F.col("finding").isNotNull(), lines).otherwise("").alias("metadata")
    ).filter(F.col("finding").isNotNull() | (F.size("_roms") > 0))
    rows = named_roms(made.select("path", "shown", "finding", "metadata", F.posexplode_outer("_roms").alias("k", "r")).select("path", "shown", "finding", "metadata", "k", "r.*"), ids)
    # An artifact's ROMs are those of at most CONTENT_CAP bytes.
    listed = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("k", "line"))))
    out = rows.groupBy("path").agg(F.any_value("shown").alias("shown"), F.any_value("finding").alias("finding"), F.any_value("metadata").alias("metadata"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("roms"))
    text = lambda c: F.trim(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\t"), F.lit(" "))).alias(c.rpartition(".")[2])
    return out.select(shown_path(F.col("shown"), root).alias("file"), *[text(f"finding.{c}") for c in ("vendor", "version", "string", "signon")], text("metadata"), text("roms"))


def analyze(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """The result table of all files below ``root``; ``ids`` are the PCI names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    where = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()  # as paths are read
    return results(artifacts(scan_tree(spark, root)), ids, where)
