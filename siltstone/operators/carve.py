"""Carving by fixed layouts and by search: headers to strip, partitions, volumes, option ROMs and compressed streams."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at_offset, bind, found, le_uint, place, power_of_two

#: Sizes of the headers that are stripped.
CAPSULE_BYTES, APRICOT_MOST, APRICOT_MARK = 2048, 4096, "@(#)Apricot "
#: Fixed value: what a boot sector with partitions says where there is none to start.
BOOT_MESSAGE = r"(?:Error loading|Missing) operating system"


def largest_power(size: Column) -> Column:
    """The largest power of two that is at most ``size``."""
    return F.when(size > 0, F.pow(F.lit(2), F.length(F.bin(size)) - 1).cast("long"))


def strip_capsule(content: Column) -> Column:
    """What follows a capsule header, if it is a power of two of bytes; else the content."""
    rest = F.octet_length(content) - CAPSULE_BYTES
    return F.when(power_of_two(rest), F.substring(content, CAPSULE_BYTES + 1, 1 << 30)).otherwise(content)


def strip_to_power(content: Column, most: int = APRICOT_MOST) -> tuple[Column, Column]:
    """(header, image) of a content that is up to ``most`` bytes longer than a power of two; a null header if it isn't."""
    size = F.octet_length(content)
    extra = size - largest_power(size)
    fits = (extra > 0) & (extra <= most)
    header = F.when(fits, F.substring(content, F.lit(1), extra.cast("int")))
    return header, F.when(fits, F.substring(content, extra.cast("int") + 1, F.lit(1 << 30))).otherwise(content)


#: The marks of packed updates and reports.
INTEL_MARK = r"(?s)\$IBI[\x00-\x4E\x50-\xFF][\x00-\x52\x54-\xFF][\x00-\x23\x25-\xFF].(.{8})"
INTEL_VOID, INTEL_HEADER_MOST, INTEL_MOST = "\xAA\x55\xAA\x55\x55\xAA\x55\xAA", 65_536, 16_777_216
OMF_HEAD, OMF_BYTES = r"(?s)^.(.{4})([\x1A\x20-\x7E]{32}).{14}([\x00\x20-\x7E]{8})", 112
RUN_MARK = r"(?s)SNIPAC([0-9A-F]{2})(.{4})"
AST_MARK, AST_AT, AST_PAYLOAD, AST_HEAD, AST_TEXT = "This is a flash update from AST Research, Inc.", 0x4200, 0x9000, 0x83, "AST FLASH UPDATE"
#: Fixed value: the beginning of an archive with a date; most entries of a directory that are listed.
ETI_HEAD, ENTRIES_MOST = r"^[0-9\.\x00]{10}[0-9]{2}/[0-9]{2}/[0-9]{2}\x00{2}[0-9]{2}:[0-9]{2}:[0-9]{2}\x00{3}", 4096
#: Most characters that the run marks of a text may stand for.
RUNS_MOST = 64 << 20
#: The texts of three flash tools, the marks around the image of the first, and the second's least size and boot mark.
FLASH_TOOLS = ("Software\\AMI\\AFUWIN", "AOpen FLASH ROM Utility R", "Micro Firmware, Incorporated * ")
FLASH_BEGIN, FLASH_END, FLASH_LEAST, FLASH_BOOT = "_EMBEDDED_ROM_START_\0", "_EMBEDDED_ROM_END_\0", 32_768, "*BBOO*"
DUMP_VERSION, DUMP_ROW = r"CPU-Z version\t+([^\r\n]+)", r"[0-9A-F]+\t((?:[0-9A-F]{2} ){16})\t"


def _number(text: Column) -> Column:
    """A little-endian number of up to four Latin-1 characters."""
    codes = F.transform(F.split(F.reverse(text), ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a * 256 + c)


def _rest(text: Column, begin: Column) -> Column:
    return F.substring(text, begin.cast("int"), F.length(text))


def strip_intel(text: Column) -> Column:
    """The payload behind an update header that gives both sizes; null for other texts of one character a byte."""
    sizes, at = F.regexp_extract(text, INTEL_MARK, 1), place(text, INTEL_MARK)
    header, payload = _number(F.substring(sizes, 1, 4)), _number(F.substring(sizes, 5, 4))
    fits = (at > 0) & (sizes != INTEL_VOID) & (header <= INTEL_HEADER_MOST) & (payload <= INTEL_MOST)
    return F.when(text.contains("$IBI"), F.when(fits, F.substring(text, (at + header).cast("int"), payload.cast("int"))))


def strip_omf(text: Column) -> Column:
    """The payload behind a header at the beginning or right after one, of an even number of bytes; null for other texts."""
    second = F.substring(text, OMF_BYTES + 1, OMF_BYTES)
    at = F.when(text.rlike(OMF_HEAD), 0).when(second.rlike(OMF_HEAD), OMF_BYTES)
    head = F.when(at == 0, F.substring(text, 1, OMF_BYTES)).otherwise(second)
    body = _rest(text, at + OMF_BYTES + 1)
    even = F.substring(body, F.lit(1), F.length(body) - F.length(body) % 2)
    return F.when((F.length(text) > OMF_BYTES) & at.isNotNull() & (_number(F.substring(head, 2, 4)) <= F.length(text)), even)


def runs_size(text: Column) -> Column:
    """The characters that a text's run marks stand for together, whatever they say."""
    hits = F.regexp_extract_all(text, F.lit(RUN_MARK), F.lit(0))
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + _number(F.substring(h, 9, 4)))


def expand_runs(text: Column, most: int = RUNS_MOST) -> Column:
    """The text with each run mark replaced by the run it stands for; null without any, or with runs of more than ``most`` characters together."""
    hits, between = F.regexp_extract_all(text, F.lit(RUN_MARK), F.lit(0)), F.split(text, RUN_MARK, -1)
    length = lambda h: F.least(_number(F.substring(h, 9, 4)), F.lit(most)).cast("int")
    run = lambda h: F.repeat(F.char(F.conv(F.substring(h, 7, 2), 16, 10).cast("int")), length(h))
    whole = F.array_join(F.zip_with(between, hits, lambda b, h: F.concat(b, F.coalesce(run(h), F.lit("")))), "")
    return F.when(text.contains("SNIPAC"), F.when((F.size(hits) > 0) & (runs_size(text) <= most), whole))


def strip_strides(text: Column) -> Column:
    """The payload of a flash floppy: 15 sectors of every 18, of the length that its header tells or all there is; null for other texts."""
    at = F.lit(1)
    head = at_offset(text, at, AST_PAYLOAD, AST_HEAD)
    size = _number(F.substring(head, AST_HEAD - 4, 4))
    tracks = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - AST_PAYLOAD) / (18 * 512)).cast("int") - 1, F.lit(0)))
    data = F.array_join(F.transform(tracks, lambda k: F.substring(text, k * (18 * 512) + AST_PAYLOAD + 1, F.lit(15 * 512))), "")
    fits = text.contains(AST_MARK) & (F.length(text) > AST_PAYLOAD + AST_HEAD) & (at_offset(text, at, AST_AT, len(AST_MARK)) == AST_MARK) & head.startswith(AST_TEXT)
    return F.when(fits, bind(data, lambda d: F.substring(d, F.lit(AST_HEAD + 1), F.least(size, F.length(d)).cast("int"))))


def strip_flash_tool(text: Column) -> Column:
    """The image inside an executable of a flash tool; null for other texts.

    One kind of tool has marks around it. For the others it is the largest power of two of bytes at the end, for one of them
    without a word of sum behind it, and only its first half where the second begins with the mark of a boot block.
    """
    begin = F.instr(text, FLASH_BEGIN)
    rest = F.substring(text, F.when(begin > 0, begin + len(FLASH_BEGIN)).otherwise(1), F.length(text))
    marked = F.when((begin > 0) & rest.contains(FLASH_END), F.substring_index(rest, FLASH_END, 1))
    size = F.length(text)
    whole = largest_power(size)
    summed = F.when(text.contains(FLASH_TOOLS[1]) & (size % 16 == 2), 2).otherwise(0)
    at = size - whole - summed
    half = F.substring(text, (at + whole / 2 + 1).cast("int"), F.lit(len(FLASH_BOOT))) == FLASH_BOOT
    kept = F.when(text.contains(FLASH_TOOLS[1]) & half, (whole / 2).cast("int")).otherwise(whole.cast("int"))
    tail = F.when((at > 0) & (~text.contains(FLASH_TOOLS[1]) | (size >= FLASH_LEAST)), F.substring(text, (at + 1).cast("int"), kept))
    other = F.when(text.contains(FLASH_TOOLS[1]) | text.contains(FLASH_TOOLS[2]), tail)
    return F.when(text.startswith("MZ"), F.when(text.contains(FLASH_TOOLS[0]), marked).otherwise(other))


def strip_apricot(text: Column) -> Column:
    """The last power of two of bytes of a recovery file with the maker's mark and a header of up to 4,096 bytes; null for other texts."""
    size = F.length(text)
    extra = size - largest_power(size)
    return F.when(text.contains(APRICOT_MARK) & (size >= APRICOT_MOST) & (extra > 0) & (extra <= APRICOT_MOST), _rest(text, extra + 1))


def hex_dump(text: Column) -> Column:
    """(version, content) of a report with a dump of 16 bytes a row; null for other texts."""
    rows = F.regexp_extract_all(text, F.lit(DUMP_ROW), F.lit(1))
    content = F.unhex(F.replace(F.array_join(rows, ""), F.lit(" "), F.lit("")))
    return F.when(text.contains("CPU-Z version") & text.rlike(DUMP_VERSION), F.struct(found(text, DUMP_VERSION).alias("version"), content.alias("content")))


def ranges(text: Column, mark: str) -> Column:
    """(begin, until) from each mark to the next, until null for the last."""
    return bind(places(text, mark), lambda p: F.transform(p, lambda x, k: F.struct(x.alias("begin"), F.get(p, k + 1).alias("until"))))


def entries(data: Column, first: int, head: int, read: Callable[[Column], tuple[Column, Column, Column]], most: int = ENTRIES_MOST) -> Column:
    """(members, wrong): the members (name, begin, size) of a directory whose entries, of ``head`` bytes each and their data behind, follow each other from
    ``first`` on; ``wrong`` where an entry or its data would go beyond the end, or there are more than ``most``.

    ``read`` gives of an entry's bytes its name, its size (null: up to the end), and whether it ends the directory.
    """
    whole = F.octet_length(data).cast("long")
    start = F.struct(F.lit(first).cast("long").alias("at"), F.lit(False).alias("over"), F.lit(False).alias("wrong"), F.array().cast("array<struct<name:string,begin:bigint,size:bigint>>").alias("members"))

    def state(at: Column, over: Column, wrong: Column, members: Column) -> Column:
        return F.struct(at.alias("at"), over.alias("over"), wrong.alias("wrong"), members.alias("members"))

    def step(s: Column, _: Column) -> Column:
        h = F.substring(data, s["at"].cast("int") + 1, F.lit(head))
        name, size, end = read(h)
        begin = s["at"] + head
        size = F.coalesce(size, F.greatest(whole - begin, F.lit(0)))
        lacks = F.octet_length(h) < head
        ends = state(s["at"], F.lit(True), lacks & (F.octet_length(h) > 0), s["members"])
        beyond = state(s["at"], F.lit(True), F.lit(True), s["members"])
        member = F.struct(name.alias("name"), begin.alias("begin"), size.cast("long").alias("size"))
        on = state(begin + size, F.lit(False), F.lit(False), F.concat(s["members"], F.array(member)))
        return F.when(s["over"], s).when(lacks | end, ends).when(begin + size > whole, beyond).otherwise(on)

    # No more entries than heads fit in; one step more tells whether there are too many.
    steps = F.sequence(F.lit(0), F.least(F.floor(whole / head) + 1, F.lit(most)).cast("int"))
    return bind(F.aggregate(steps, start, step), lambda s: F.struct(s["members"].alias("members"), (s["wrong"] | ~s["over"]).alias("wrong")))


def _name_of(data: Column, at: int, size: int) -> Column:
    """A file name of fixed width, up to its first zero; separators of folders can't be in one."""
    return F.translate(F.substring_index(F.decode(F.substring(data, at + 1, size), "ISO-8859-1"), "\0", 1), "/", "\\")


def ros_members(data: Column) -> Column:
    """The directory of a network boot file system: entries of 32 bytes behind a header of 32; what one of an unsure size holds goes up to the end."""

    def read(h: Column) -> tuple[Column, Column, Column]:
        unsure = le_uint(h, 28, 1).bitwiseAND(0x10) > 0
        stem, kind = _name_of(h, 17, 8), _name_of(h, 25, 3)
        return F.concat(stem, F.lit("."), kind), F.when(~unsure, le_uint(h, 10, 2)), F.lit(False)

    return F.when(F.substring(data, 1, 3) == F.lit(b"ROS"), entries(data, 32, 32, read))


def partition_members(data: Column, sector: int = 512) -> Column:
    """The partitions of a disk image whose boot sector has the message of one, as members ``partition0`` to ``partition3``; wrong where one goes beyond the end."""
    whole = F.octet_length(data).cast("long")
    entry = lambda k: F.struct(F.lit(f"partition{k}").alias("name"), (le_uint(data, 446 + 16 * k + 8, 4) * sector).alias("begin"), (le_uint(data, 446 + 16 * k + 12, 4) * sector).alias("size"), le_uint(data, 446 + 16 * k + 4, 1).alias("type"))
    used = F.filter(F.array(*[entry(k) for k in range(4)]), lambda e: (e["type"] > 0) & (e["size"] > 0))
    here = F.filter(used, lambda e: e["begin"] + e["size"] <= whole)
    listed = F.transform(here, lambda e: F.struct(e["name"].alias("name"), e["begin"].alias("begin"), e["size"].alias("size")))
    boots = (F.hex(F.substring(data, 511, 2)) == "55AA") & F.decode(F.substring(data, 1, 510), "ISO-8859-1").rlike(BOOT_MESSAGE)
    return F.when(boots & (whole > sector), F.struct(listed.alias("members"), (F.size(here) < F.size(used)).alias("wrong")))


def eti_members(data: Column) -> Column:
    """The directory of an archive of packed files: entries of a name, five bytes and a size behind a header with a date; an empty name ends it."""
    read = lambda h: (_name_of(h, 0, 12), le_uint(h, 17, 4), _name_of(h, 0, 12) == "")
    return F.when(F.decode(F.substring(data, 1, 31), "ISO-8859-1").rlike(ETI_HEAD), entries(data, 31, 21, read))


def partitions(files: DataFrame, content: str = "content", sector: int = 512) -> DataFrame:
    """(path, partition, type, content) of the four entries of a boot sector that hold something; an entry that goes beyond the end is cut there."""
    data = F.col(content)
    signed = F.hex(F.substring(data, 511, 2)) == "55AA"
    entry = lambda k: F.struct(F.lit(k).alias("n"), le_uint(data, 446 + 16 * k + 4, 1).alias("type"), le_uint(data, 446 + 16 * k + 8, 4).alias("start"), le_uint(data, 446 + 16 * k + 12, 4).alias("count"))
    rows = files.filter(signed).select("path", content, F.explode(F.array(*[entry(k) for k in range(4)])).alias("e"))
    rows = rows.filter((F.col("e.type") > 0) & (F.col("e.count") > 0) & (F.col("e.start") * sector < F.octet_length(content)))
    part = F.substring(F.col(content), (F.col("e.start") * sector + 1).cast("int"), F.least(F.col("e.count") * sector, F.octet_length(content)).cast("int"))
    return rows.select("path", F.col("e.n").alias("partition"), F.col("e.type").alias("type"), part.alias("content"))


def places(text: Column, mark: str) -> Column:
    """The offsets of all marks in a text of one character a byte."""
    parts = F.split(text, f"\\Q{mark}\\E", -1)
    ends = F.aggregate(parts, F.array(F.lit(-len(mark))), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p) + len(mark))))
    return F.slice(ends, 2, F.size(ends) - 2)


def last_place(text: Column, mark: str, before: Column | None = None) -> Column:
    """The offset of the last mark that ends at ``before`` or ahead of it (the end, without one), in a text of one character a byte; null with none."""
    front = text if before is None else F.substring(text, F.lit(1), before.cast("int"))
    return bind(front, lambda f: F.when(f.contains(mark), F.length(f) - F.length(F.substring_index(f, mark, -1)) - len(mark)))


def volumes(text: Column) -> Column:
    """The offsets at which firmware volumes begin: their mark stands 40 bytes inside."""
    return F.filter(F.transform(places(text, "_FVH"), lambda x: x - 0x28), lambda x: x >= 0)


def option_roms(text: Column) -> Column:
    """The distinct (vendor_id, device_id) of PCI data structures, in order; ids of all zeros or ones are no ids."""
    code = lambda x, k: F.ascii(F.substring(x, k, 1))
    ids = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)PCIR(.{4})"), F.lit(1)), lambda x: F.struct((code(x, 1) + 256 * code(x, 2)).alias("vendor_id"), (code(x, 3) + 256 * code(x, 4)).alias("device_id")))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: ~i["vendor_id"].isin(0, 0xFFFF) & ~i["device_id"].isin(0, 0xFFFF))))


def pnp_headers(text: Column) -> Column:
    """The distinct device numbers of Plug and Play expansion headers, big-endian, in order."""
    code = lambda x, k: F.ascii(F.substring(x, k, 1)).cast("long")
    found = F.regexp_extract_all(text, F.lit(r"(?s)\$PnP.{6}(.{4})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: ((code(x, 1) * 256 + code(x, 2)) * 256 + code(x, 3)) * 256 + code(x, 4))))


#: Bytes that a decoder takes and gives at a time.
PIECE = 1 << 16
DECODERS: dict[str, Callable] = {f"zlib{bits}": (lambda b: lambda: zlib.decompressobj(b))(bits) for bits in (15, -15, 31, -8, 47)} | {
    "lzma": lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE),
    "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ),
}
#: The bytes with which a stream of a format begins, where it has any.
MAGIC = {"zlib31": b"\x1f\x8b", "zlib47": b"\x1f\x8b", "xz": b"\xfd7zXZ\0"}


def decoded(data: memoryview, name: str, needle: bytes) -> tuple[int, bool]:
    """How many bytes the stream at the beginning of ``data`` makes before it ends or breaks, and whether ``needle`` is among
    them. It is decoded in pieces, of which only the last bytes are held, however long it is."""
    coder, size, there, tail, at = DECODERS[name](), 0, False, b"", 0
    try:
        while not coder.eof:
            if name.startswith("zlib"):
                given = coder.unconsumed_tail or data[at : at + PIECE]
                at += 0 if coder.unconsumed_tail else len(given)
                made = coder.decompress(given, PIECE)
            else:
                given = data[at : at + PIECE] if coder.needs_input else b""
                at += len(given)
                made = coder.decompress(given, PIECE)
            if not made and not len(given):
                break
            size += len(made)
            there = there or needle in tail + made
            tail = (tail + made)[-len(needle) :]
    except (zlib.error, lzma.LZMAError, EOFError, ValueError, MemoryError):
        pass
    return size, there


def search_streams(files: DataFrame, needle: bytes, content: str = "content", least: int = 1, stretch: int = 4096) -> DataFrame:
    """(path, offset, algorithm, size): the places from which an algorithm makes at least ``least`` bytes that hold ``needle``.

    Every offset is tried with every algorithm whose streams begin with the bytes there, and each stream is read to its
    end. An artifact is cut into at most 32 stretches of offsets, so that several tasks search a large one; each has the
    bytes from its first offset to the artifact's end.
    """
    size = F.octet_length(content)
    step = F.greatest(F.lit(stretch), F.ceil(size / 32).cast("int"))
    rows = files.filter(size > 0).select("path", F.col(content).alias("c"), step.alias("n"), F.explode(F.sequence(F.lit(0), size - 1, step)).alias("start"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "path", "start").select("path", "start", "n", F.expr("substring(c, start + 1)").alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, start, n, data in zip(b["path"], b["start"], b["n"], b["c"]):
                data = memoryview(bytes(data))
                for at in range(min(n, len(data))):
                    for name in DECODERS:
                        if data[at : at + len(MAGIC.get(name, b""))] == MAGIC.get(name, b""):
                            made, there = decoded(data[at:], name, needle)
                            if there and made >= least:
                                out.append((path, start + at, name, made))
            yield pd.DataFrame(out, columns=["path", "offset", "algorithm", "size"])

    return rows.mapInPandas(run, "path string, offset long, algorithm string, size long")
