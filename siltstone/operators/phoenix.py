"""Images of chained records in a megabyte of address space: chains, segments laid over the image, register tables, build data.

The image ends where the address space does. A segment mark is followed by records that tell their sizes; the next record begins
behind the last, or a little later where sizes don't line up. Records are a relation: each possible one knows the nearest that
follows it, and what a segment's first record reaches is its chain. A chain with a record that can't be one is rejected whole,
and the first that is left counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relations import follow, nearest_after

MEMORY = 1 << 20
#: The marks of a segment and of a record, the bytes of a record's head, and how far behind its place a first
#: and a later record may begin.
SEGMENT, RECORD, HEAD_BYTES, FIRST_WITHIN, NEXT_WITHIN = "BCPSEGMENT", "BCP", 10, 1024, 256
#: A footer's mark, and the most bytes of one without.
FOOTER, FOOTER_MOST = "BC", 16
#: Names of the register tables' categories, by number.
CATEGORIES = ("System", "Cache", "CPU", "I/O", "PM", "Bridge", "MCD", "Other")
#: What an identification begins with.
VALID_ID = r"^[\x20-\x7E][\x00\x20-\x7E]{7,}"
#: Bytes of an image that are looked at together for a mark.
BLOCK = 64
#: Most bytes of a register table's pointers.
POINTERS_MOST = 128


def byte(data: Column, at: Column | int) -> Column:
    """The number of the byte at an offset of a binary column; null beyond its ends."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when((at >= 0) & (at < F.octet_length(data)), F.conv(F.hex(F.substring(data, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int"))


def word(data: Column, at: Column | int) -> Column:
    """The little-endian number of two bytes at an offset."""
    return byte(data, at) + 256 * byte(data, at + 1)


def part(data: Column, begin: Column | int, end: Column | int) -> Column:
    """The bytes [begin, end) as a text of one character each."""
    begin, end = (F.lit(x) if isinstance(x, int) else x for x in (begin, end))
    return F.decode(F.substring(data, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), "ISO-8859-1")


def has_footer(content: Column) -> Column:
    """Whether what an image has behind its whole blocks of 64 KB is a footer."""
    extra = F.octet_length(content) % 65536
    last = F.octet_length(content) - extra
    return (extra > 0) & ((extra <= FOOTER_MOST) | (part(content, last, last + 2) == FOOTER))


def tail(content: Column) -> Column:
    """The last megabyte of an image, without a footer behind its whole blocks of 64 KB."""
    bare = F.when(has_footer(content), F.substring(content, F.lit(1), F.octet_length(content) - F.octet_length(content) % 65536)).otherwise(content)
    return F.when(F.octet_length(bare) > MEMORY, F.substring(bare, F.octet_length(bare) - MEMORY + 1, F.lit(MEMORY))).otherwise(bare)


def laid_over(data: Column, segments: Column) -> Column:
    """The address space, zeros before the image, with ``segments`` (an array of address and data) laid over it in order; each is cut at the end."""
    space = F.lpad(data, MEMORY, b"\0")

    def lay(memory: Column, s: Column) -> Column:
        room = F.greatest(F.lit(0), F.lit(MEMORY) - s["address"]).cast("int")
        piece = F.substring(s["data"], F.lit(1), room)
        return F.when(F.octet_length(piece) > 0, F.overlay(memory, piece, (s["address"] + 1).cast("int"), F.octet_length(piece))).otherwise(memory)

    return F.aggregate(segments, space, lay)


def offsets_of(data: Column, mark: str) -> Column:
    """The offsets of a mark in a binary column: blocks of bytes that hold it are looked for first, then its places in these."""
    size, literal = len(mark), F.lit(mark.encode())
    blocks = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - size, F.lit(0)), F.lit(BLOCK))
    some = F.filter(blocks, lambda i: F.contains(F.substring(data, i + 1, F.lit(BLOCK + size - 1)), literal))
    there = F.flatten(F.transform(some, lambda i: F.filter(F.sequence(i, i + BLOCK - 1), lambda j: F.substring(data, j + 1, F.lit(size)) == literal)))
    return F.when(F.contains(data, literal), there).otherwise(F.array().cast("array<int>"))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns behind a generator, so that what uses them doesn't compute them again."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spaces(images: DataFrame) -> DataFrame:
    """(path, base, data) of ``images`` (path, content, and maybe segments): the bytes from address ``base`` to the end of the space.

    Segments are an array of address and data, the later over the earlier. Without any, only the image's own bytes are held.
    """
    own = tail(F.col("content"))
    if "segments" not in images.columns:
        return images.filter("content is not null").select("path", (F.lit(MEMORY) - F.octet_length(own)).alias("base"), own.alias("data"))
    some = F.coalesce(F.size("segments"), F.lit(0)) > 0
    data = F.when(some, laid_over(own, F.col("segments"))).otherwise(own)
    return images.filter("content is not null").select("path", data.alias("data")).select("path", (F.lit(MEMORY) - F.octet_length("data")).alias("base"), "data")


def chains(spaces: DataFrame, folder: str) -> DataFrame:
    """(path, segment, n, signature, major, minor, place, size, data): the records of each image's first valid chain, in order.

    ``segment`` and ``place`` are addresses. A record's place may be up to 256 bytes behind the one before, the first up to 1,024 behind
    the segment's mark. A head that is cut off, has a further mark where its version and size belong, or a size below its own makes the
    chain invalid; then the next segment mark is tried. A segment mark without a record within reach ends the search.
    """
    rows = spaces.filter(F.contains(F.col("data"), F.lit(SEGMENT.encode())))
    places = rows.select("path", "base", F.explode(offsets_of(F.col("data"), RECORD)).alias("at"), "data")
    head = F.substring("data", F.col("at") + 1, F.lit(HEAD_BYTES))
    size = word(head, 8)
    wrong = (F.octet_length(head) < HEAD_BYTES) | (part(head, 6, 9) == RECORD) | (size < HEAD_BYTES)
    known = places.select("path", "base", "at", head.alias("head"), F.when(~wrong, size).alias("size")).withColumn("wrong", F.col("size").isNull())
    known.write.parquet(f"{folder}/records")
    known = rows.sparkSession.read.schema(known.schema).parquet(f"{folder}/records")
    # A segment's mark is itself a record's; what follows it begins at most so far behind it.
    mark = part(F.col("head"), 0, HEAD_BYTES) == SEGMENT
    asks = known.select(
        "path", "at", F.when(mark, F.col("at") + HEAD_BYTES).otherwise(F.col("at") + F.col("size")).alias("from"), F.when(mark, FIRST_WITHIN).otherwise(NEXT_WITHIN).alias("within"), mark.alias("mark")
    ).filter(F.col("from").isNotNull())
    links = nearest_after(asks, known.select("path", "at"), "path", "from", "at").filter(F.col("next") + len(RECORD) <= F.col("from") + F.col("within"))
    # A mark is no record of a chain by its own size.
    starts = links.filter("mark").select("path", F.col("at").alias("start"), F.col("next").alias("node"))
    hops = links.filter("not mark").select("path", F.col("at").alias("node"), "next")
    # The search ends at the first mark that has no record behind it.
    lost = asks.filter("mark").join(starts.select("path", F.col("start").alias("at")), ["path", "at"], "left_anti").groupBy("path").agg(F.min("at").alias("stop"))
    found = follow(starts, hops, "path", f"{folder}/follow").join(known.withColumnRenamed("at", "node"), ["path", "node"]).join(lost, "path", "left")
    bad = F.bool_or("wrong").over(Window.partitionBy("path", "start"))
    good = found.filter("stop is null or start < stop").withColumn("bad", bad).filter("not bad")
    first = F.min("start").over(Window.partitionBy("path"))
    good = good.withColumn("first", first).filter("start = first").select("path", "base", "start", "step", "node", "head", "size")
    data = F.substring("data", F.col("node") + 1, F.col("size"))
    return good.join(rows.select("path", "data"), "path").select(
        "path", (F.col("base") + F.col("start")).alias("segment"), F.col("step").alias("n"), part(F.col("head"), 0, 6).alias("signature"), byte(F.col("head"), 6).alias("major"), byte(F.col("head"), 7).alias("minor"),
        (F.col("base") + F.col("node")).alias("place"), "size", data.alias("data"),
    )


def firsts(records: DataFrame, signature: str) -> DataFrame:
    """(path, segment, r): the first record of a signature of each image."""
    fields = F.struct("n", "place", "size", "major", "minor", "data")
    return records.filter(F.col("signature") == signature).groupBy("path", "segment").agg(F.min_by(fields, "n").alias("r"))


def text_of(data: Column, begin: int | Column, end: int | Column) -> Column:
    """Bytes as a text, zeros as blanks, without outer ones."""
    return F.trim(F.replace(part(data, begin, end), F.lit("\0"), F.lit(" ")))


def builds(records: DataFrame) -> DataFrame:
    """(path, version, build): the core version and the build code and dates that the system record tells, by its revision."""
    d, size, major = F.col("r.data"), F.octet_length("r.data"), F.col("r.major")
    maj, minor, patch = (byte(d, k).cast("string") for k in (10, 11, 12))
    padded = F.lpad(minor, F.greatest(F.length(minor), F.lit(2)), "0")
    # Beyond 4 the number is the release of 4.0.
    version = F.when(byte(d, 10) > 4, F.concat(F.lit("4."), F.lpad(maj, F.greatest(F.length(maj), F.lit(2)), "0")))
    version = version.when((byte(d, 10) == 4) & (byte(d, 11) >= 6), F.concat(maj, F.lit(".0 Release "), minor, F.lit(".0"))).otherwise(F.concat_ws(".", maj, padded))
    code = F.when((major == 0) & (size > 0x33), text_of(d, 0x33, 0x3B)).when((major != 0) & (size > 0x37), text_of(d, 0x37, 0x3F)).otherwise("")
    old = [F.concat_ws(" ", text_of(d, a, a + 8), text_of(d, a + 8, a + 16)) for a in (0x0F, 0x1F)]
    new = [text_of(d, 0x0F, 0x20), text_of(d, 0x21, 0x32)]
    dates = F.when(size > 0x0F, F.when(major == 0, F.array(*old)).otherwise(F.array(*new))).otherwise(F.array().cast("array<string>"))
    real = F.filter(F.transform(dates, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("00/00/00"))
    lines = F.filter(F.array(code, F.array_join(real, "\n")), lambda x: x != "")
    return firsts(records, "BCPSYS").filter(size >= 13).select("path", version.alias("version"), F.array_join(lines, "\n").alias("build"))


def register_tables(spaces: DataFrame, records: DataFrame) -> DataFrame:
    """(path, category, model), distinct: the register tables that an image points to, and the devices that its records name.

    The system record has the bounds of an array of pointers, and by its revision their segment, which is mended where the
    identification that the power-on record points to isn't there. A table begins with its model and category. An array
    of more than 128 bytes is none.
    """
    sys, post = firsts(records, "BCPSYS"), firsts(records, "BCPOST").select("path", F.col("r").alias("post"))
    d, size, major, minor = F.col("r.data"), F.col("r.size"), F.col("r.major"), F.col("r.minor")
    own = F.shiftright(F.col("segment").bitwiseAND(0xF0000), 4)
    named = word(d, 0x69)
    post_at = word(F.col("post.data"), 0x1B) + named * 16 - F.col("base")
    valid = part(F.col("data"), post_at, post_at + 4096).rlike(VALID_ID) & (post_at >= 0)
    mended = F.when((named > 0) & (named < 0x8000), named.bitwiseOR(0x8000)).otherwise(0xF000)
    by_post = F.when(F.coalesce(valid, F.lit(False)), named).otherwise(mended)
    by_size = F.when(named <= 0xE31F, 0xF000).otherwise(named)
    late = F.when(F.col("post.size") >= 0x1D, by_post).otherwise(by_size)
    newer, middle = (major >= 3) & (size >= 0x6B), (major == 1) & (minor >= 5) & (size >= 0x6B)
    where = F.when(newer, F.struct(word(d, 0x65).alias("a"), word(d, 0x67).alias("b"), F.when((major == 3) & (minor <= 1), own).otherwise(late).alias("s")))
    where = where.when(middle, F.struct(word(d, 0x67).alias("a"), word(d, 0x69).alias("b"), F.shiftright("r.place", 4).bitwiseAND(0xF000).alias("s")))
    found = once(spaces.join(sys.join(post, "path", "left"), "path"), w=where).select("path", "data", F.col("w.a").alias("a"), F.col("w.b").alias("b"), (F.col("w.s") * 16 - F.col("base")).alias("shift"), "w.s")
    rows = found.filter((F.col("s") != 0) & (F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= POINTERS_MOST))
    # Pairs of bytes up to the end of the space; what lies before the image is zero.
    value = lambda i: F.when(i < 0, 0).otherwise(byte(F.col("data"), i))
    places = once(rows, at=F.transform(F.sequence(F.col("a"), F.col("b") - 1, F.lit(2)), lambda p: p + F.col("shift")))
    places = once(places, table=F.transform("at", lambda i: value(i) + 256 * value(i + 1) + F.col("shift")))
    tables = once(places, tables=F.transform("table", lambda i: F.struct(F.shiftright(value(i + 2), 4).alias("category"), value(i + 1).alias("model"))))
    # A pointer that reads beyond the end ends the list.
    ends = F.array_position(F.transform("tables", lambda t: F.coalesce(t["category"], F.lit(-1))), -1).cast("int")
    whole = F.when(ends > 0, F.slice("tables", F.lit(1), F.greatest(ends - 1, F.lit(0)))).otherwise(F.col("tables"))
    out = tables.select("path", F.explode(whole).alias("t")).select("path", "t.category", "t.model")
    devices = F.when((F.col("signature") == "BCPCHP") & (F.col("major") == 0), 0).when(F.col("signature") == "BCPIO ", 3).when(F.col("signature") == "BCPMCD", 6)
    named = records.filter(F.col("size") >= 11).select("path", devices.alias("category"), byte(F.col("data"), 10).alias("model")).filter("category is not null")
    return out.unionByName(named).distinct()


def table_names(tables: DataFrame, models: DataFrame) -> DataFrame:
    """(path, category, name) of register tables whose model is in ``models`` (category, model, name), a table that Spark reads."""
    label = F.coalesce(F.get(F.lit(list(CATEGORIES)), F.col("category")), F.col("category").cast("string"))
    return tables.join(models, ["category", "model"]).select("path", label.alias("category"), "name")


def dmi_lines(spaces: DataFrame, records: DataFrame) -> DataFrame:
    """(path, line): the system and board that the description records point to, with ``[Board/System]`` where both are alike."""
    sys = firsts(records, "BCPSYS").select("path", "segment", F.col("r").alias("sys"))
    named = word(F.col("sys.data"), 0x69)
    late = (F.col("sys.major") >= 3) & (F.col("sys.size") >= 0x6B) & ~((F.col("sys.major") == 3) & (F.col("sys.minor") <= 1))
    where = F.when(late, named).otherwise(F.shiftright(F.col("segment").bitwiseAND(0xF0000), 4)) * 16 - F.col("base")
    d = F.col("data2")

    def told(at: int) -> Column:
        offset = word(d, at)
        text = F.trim(F.substring_index(part(F.col("data"), where + offset, where + offset + 256), "\0", 1))
        return F.when(offset.isin(0, 0xFFFF) | (where + offset < 0), "").otherwise(text)

    join = lambda a: F.concat_ws(" ", *[told(a + 2 * k) for k in range(3)])
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    found = records.filter("signature = 'BCPDMI'").select("path", "n", F.col("data").alias("data2")).join(spaces, "path").join(sys, "path", "left")
    rows = found.select("path", "n", F.when(F.octet_length(d) >= 0x1C, join(0x16)).alias("s"), F.when(F.octet_length(d) >= 0x10, join(0x0A)).alias("b"))
    rows = rows.withColumn("s", F.when(F.trim("s") != "", F.col("s"))).withColumn("b", F.when(F.trim("b") != "", F.col("b")))
    same = F.coalesce(key(F.col("s")) == key(F.col("b")), F.lit(False))
    lines = F.when(same, F.array(F.concat(F.lit("[Board/System] "), "b"))).otherwise(F.array(F.concat(F.lit("[System] "), "s"), F.concat(F.lit("[Board] "), "b")))
    return rows.select("path", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))
