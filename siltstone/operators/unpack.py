"""Unpacking of containers until nothing is left to unpack.

A generation is a table of artifacts; each pass opens the containers among them and its children are the next
generation. Passes are Spark jobs over written tables, so only one generation is worked on at a time and a lost
executor costs its own tasks only. Opening one artifact is a small function over its bytes. Before that, sets of a folder's
artifacts that make one image are claimed and put together (``groups``).

No artifact ends the job: what can't be opened, stripped or held within the limits stays, with an event that says why.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import carve as V
from ..functions.scalar import bind
from .classify import DISCARD, DISCARD_LONGER, HEAD_BYTES, as_latin1, begins
from .groups import FRAME_BYTES, beside_flashers, group_step, images, remove, write

#: Limits against hostile input. What passes them is reported: a member as a row with an event and no content, beside the
#: container itself, which then stays.
DEPTH, MEMBER_BYTES, MEMBERS = 16, 64 << 20, 100_000
#: Most bytes of a container's members together; they are read one by one and handed over in frames, never held at once.
CONTAINER_BYTES = 1 << 30
TOO_LARGE, TOO_MANY, TOO_MUCH, WRONG_LENGTH = "too large", "too many members", "too large together", "wrong lengths"
SCHEMA = "path string, parent string, depth int, content binary, event string"
Member = tuple[str, bytes | None]


def _zip(data: bytes) -> Iterator[Member]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, z.read(info, pwd=b"password" if info.flag_bits & 1 else None) if info.file_size <= MEMBER_BYTES else None


def _tar(data: bytes) -> Iterator[Member]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for info in t:
            if info.isfile():
                yield info.name, t.extractfile(info).read() if info.size <= MEMBER_BYTES else None


def _one(opened) -> Iterator[Member]:
    with opened as f:
        data = f.read(MEMBER_BYTES + 1)
        yield "content", data if len(data) <= MEMBER_BYTES else None


def _records(data: bytes) -> Iterator[Member]:
    """Intel hex data records at their 16-bit addresses; a later record wins."""
    out = bytearray()
    for m in re.finditer(rb":([0-9A-Fa-f]{2})([0-9A-Fa-f]{4})00([0-9A-Fa-f]*?)[0-9A-Fa-f]{2}\s", data):
        body, at = bytes.fromhex(m[3].decode()), int(m[2], 16)
        if len(body) == int(m[1], 16):
            out.extend(bytes(max(0, at + len(body) - len(out))))
            out[at : at + len(body)] = body
    yield "content", bytes(out)


OPENERS = (
    (lambda d: d[257:262] == b"ustar", "tar", _tar),
    (lambda d: d[:4] == b"PK\3\4", "zip", _zip),
    (lambda d: d[:2] == b"\x1f\x8b", "gzip", lambda d: _one(gzip.GzipFile(fileobj=io.BytesIO(d)))),
    (lambda d: d[:3] == b"BZh", "bzip2", lambda d: _one(bz2.BZ2File(io.BytesIO(d)))),
    (lambda d: d[:6] == b"\xfd7zXZ\0", "xz", lambda d: _one(lzma.LZMAFile(io.BytesIO(d)))),
    (lambda d: re.match(rb":[0-9A-Fa-f]{10,}\r?\n", d), "hex", _records),
)
#: Beginnings of containers that are known but have no opener here.
UNSUPPORTED = {"rar": b"Rar!", "7z": b"7z\xbc\xaf\x27\x1c", "cab": b"MSCF", "installshield": b"ISc("}
#: What only a container begins with; other artifacts never reach Python.
CONTAINER = r"(?s)^(?:PK\x03\x04|\x1F\x8B|BZh|\xFD7zXZ\x00|Rar!|7z\xBC\xAF\x27\x1C|MSCF|ISc\(|.{257}ustar|:[0-9A-Fa-f]{10,}\r?\n)"
#: What the head of an artifact with a payload to strip begins with or has, but for those whose header is all form. Plain texts, as they
#: are far quicker to look for than a pattern.
STRIP_START, RUNS = "MZ", "SNIPAC"
STRIP_MARKS = (V.APRICOT_MARK, "$IBI", RUNS, "This is a flash update from AST", "CPU-Z version\t")
STRIPS = (("intel update", V.strip_intel), ("omf", V.strip_omf), ("runs", V.expand_runs), ("ast floppy", V.strip_strides), ("flash tool", V.strip_flash_tool), ("recovery file", V.strip_apricot), ("hex dump", lambda t: F.decode(V.hex_dump(t)["content"], "ISO-8859-1")))


#: What an opener may raise on hostile bytes: all but what ends the worker itself.
FAILURES = (Exception,)


def open_one(data: bytes) -> tuple[str | None, Iterator[Member]]:
    """(event, members) of one artifact: the name of its kind, or why it isn't opened; null if it is no container. Members are read
    as they are asked for, and may fail on the way."""
    for name, start in UNSUPPORTED.items():
        if data.startswith(start):
            return f"unsupported {name}", iter(())
    for test, name, opener in OPENERS:
        if test(data):
            return name, opener(data)
    return None, iter(())


def opened(path: str, parent: str | None, level: int, data: bytes) -> Iterator[tuple]:
    """The rows that a container gives, one by one: members without event, members over the limit with one, and itself, with an
    event, where it must stay: if it has no members, breaks off on the way, or is over a limit. A container that breaks off keeps the members before."""
    event, members = open_one(data)
    count, total, lost = 0, 0, None
    try:
        for name, content in members:
            count, total = count + 1, total + len(content or b"")
            if count > MEMBERS or total > CONTAINER_BYTES:
                lost = TOO_MANY if count > MEMBERS else TOO_MUCH
                break
            lost = TOO_LARGE if content is None else lost
            yield f"{path}:/{name}", path, level + 1, content, None if content is not None else TOO_LARGE
    except FAILURES as e:
        lost = f"failed {event}: {type(e).__name__}"
    if lost or not count:
        yield path, parent, level, data, lost or (event if event and event.startswith("unsupported") else f"empty {event}" if event else "leaf")


def head_has(content: Column, mark: str) -> Column:
    """Whether an artifact's head has an ASCII mark; in its bytes, of which no text is made."""
    return F.contains(F.substring(content, 1, HEAD_BYTES), F.lit(mark.encode("ascii")))


def stripped(content: Column) -> Column:
    """The payload of an artifact that is packed by layout alone, as binary; null for others."""
    whole = bind(as_latin1(content), lambda t: F.coalesce(*[strip(t) for _, strip in STRIPS]))
    marked = reduce(lambda a, m: a | head_has(content, m), STRIP_MARKS, F.startswith(content, F.lit(STRIP_START.encode("ascii"))))
    marked = marked | begins(content, V.OMF_HEAD, ()) | begins(content, V.OMF_HEAD.replace("^", "^.{112}"), ())
    return F.when(marked, F.encode(whole, "ISO-8859-1"))


def listing(content: Column) -> Column:
    """(members, wrong) of an artifact that is a directory of plain entries, or a disk with partitions; null for others."""
    return F.coalesce(V.ros_members(content), V.eti_members(content), V.partition_members(content))


def without_boxes(rows: DataFrame) -> DataFrame:
    """What artifacts that are no containers give, in one pass: themselves or their payload, and of directories with plain entries the
    members beside them; a directory whose lengths are wrong, or that is empty, with that event."""
    content, member = F.col("content"), F.col("_member")
    rows = rows.withColumn("_list", listing(content))
    # Entries first, contents cut out behind them: those of a directory together may be far larger than it. The artifact itself is the null among them.
    itself = F.array(F.lit(None))
    rows = rows.withColumn("_member", F.explode(F.when(F.col("_list").isNull(), itself).otherwise(F.concat("_list.members", itself))))
    rows = rows.withColumn("_inner", F.when(F.col("_list").isNull(), stripped(content)))
    is_member, inner = member.isNotNull(), F.col("_inner").isNotNull()
    directory = F.when(F.col("_list.wrong"), WRONG_LENGTH).when(F.size("_list.members") == 0, "empty directory").otherwise("listed")
    plain = F.coalesce(over_limits(content), F.lit("leaf"))
    return rows.select(
        F.when(is_member, F.concat("path", F.lit(":/"), member["name"])).when(inner, F.concat("path", F.lit(":/payload"))).otherwise(F.col("path")).alias("path"),
        F.when(is_member | inner, F.col("path")).otherwise(F.col("parent")).alias("parent"), (F.col("depth") + (is_member | inner).cast("int")).alias("depth"),
        F.when(is_member, F.substring("content", (member["begin"] + 1).cast("int"), member["size"].cast("int"))).otherwise(F.coalesce("_inner", "content")).alias("content"),
        F.when(is_member | inner, F.lit(None)).when(F.col("_list").isNotNull(), directory).otherwise(plain).alias("event"),
    )


def over_limits(content: Column) -> Column:
    """The event of an artifact whose layout says to make more than a limit; null for others."""
    head = as_latin1(F.substring(content, 1, HEAD_BYTES))
    runs = bind(as_latin1(content), lambda t: V.runs_size(t))
    return F.when(head_has(content, RUNS) & head.rlike(V.RUN_MARK), F.when(runs > V.RUNS_MOST, TOO_LARGE))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it the session has other settings."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """Shuffled rows leave the disk with the job that they were for, not when the driver happens to collect its garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


@contextmanager
def no_broadcasts(spark: SparkSession) -> Iterator[None]:
    """No side of a join is held whole by the driver. Files say too little of tables' sizes: paths of a folder are packed to a few bytes
    each, so that a table of millions looks small enough; and each of the many joins of a generation would leave its table behind."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        yield


def unpack(files: DataFrame, work: str, depth: int = DEPTH, sets: bool = True) -> DataFrame:
    """All artifacts that remain: (path, parent, depth, content, event), of ``files`` (path, content).

    A container that opens is replaced by its members, at ``path:/member``; one that does not stays, with the event
    that says why, as does one that breaks off or is over a limit; single members over the limit are rows without content.
    Directories of plain entries stay, with their members beside them.
    Artifacts with a header or runs to strip are replaced by their payload, at ``path:/payload``. Sets of a folder's
    artifacts that make an image (unless ``sets`` is false) are replaced by it, below the first of them. Files of no use are
    dropped by their beginnings; null contents give no rows. ``work`` is a folder that all executors share.
    """
    spark = files.sparkSession
    folder = f"{work.rstrip('/')}/unpack-{uuid.uuid4().hex}"

    names = ["path", "parent", "depth", "content", "event"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for path, parent, level, data in zip(b["path"], b["parent"], b["depth"], b["content"]):
                for row in opened(path, parent, level, bytes(data)):
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size > FRAME_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    # Written once, and only then filtered: what makes the contents may be costly, and would be called again for each look at them.
    now = files.select("path", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "content")
    with shuffles_dropped(spark):
        now.write.parquet(f"{folder}/files", compression="zstd")
    now = spark.read.schema(now.schema).parquet(f"{folder}/files").filter("content is not null")
    with no_broadcasts(spark), shuffles_dropped(spark):
        return reduce(DataFrame.unionByName, generations(now, folder, step, depth, sets))


def plain(content: Column) -> Column:
    """Whether an artifact stays as it is: it is no container, has no members and nothing to strip."""
    return ~begins(content, CONTAINER, (b":",)) & listing(content).isNull() & stripped(content).isNull()


def generations(now: DataFrame, folder: str, step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], depth: int, sets: bool) -> list[DataFrame]:
    """What is left by each generation from ``now`` on; ``step`` opens containers.

    Images of interleaved sets are made as they are read, now and by whoever reads the result: written are those among them of which
    something is to be made. ``folder``/files, which ``now`` reads, is removed when the first generation is written.
    """
    spark, content, files = now.sparkSession, F.col("content"), f"{folder}/files"
    useful = ~begins(content, DISCARD, DISCARD_LONGER)
    done, woven = [], None
    for level in range(depth + 1):
        others = None
        if woven is not None and beside_flashers(now, woven):
            now = now.unionByName(images(woven))
        elif woven is not None:
            done.append(images(woven).filter(useful & plain(content)).withColumn("event", F.coalesce(over_limits(content), F.lit("leaf"))))
            others = write(images(woven).filter(useful & ~plain(content)), f"{folder}/sets")
        now, whole, woven, table = group_step(now, f"{folder}/sets", None if level else files) if sets else (now, None, None, None)
        now = now if others is None else now.unionByName(others)
        kept = now.filter(useful).withColumn("_box", begins(content, CONTAINER, (b":",)))
        boxes = kept.filter("_box").select("path", "parent", "depth", "content").mapInPandas(step, SCHEMA)
        rows = [boxes, without_boxes(kept.filter("not _box"))] + ([] if whole is None else [whole])
        reduce(DataFrame.unionByName, rows).write.parquet(f"{folder}/{level}", compression="zstd")
        for path in ([] if level else [files]) + ([table] if table else []):
            remove(spark, path)
        made = spark.read.schema(SCHEMA).parquet(f"{folder}/{level}")
        done.append(made.filter("event is not null"))
        now = made.filter("event is null").select("path", "parent", "depth", "content")
        if woven is None and now.isEmpty():
            break
    else:
        now = now if woven is None else now.unionByName(images(woven))
        done.append(now.withColumn("event", F.lit("too deep")))
    return done
