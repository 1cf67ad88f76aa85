"""Steps of unpacking that take several artifacts of a folder at once: update parts, missing tails, interleaved images.

Each kind of step finds sets of artifacts from narrow facts (names, sizes, marks in their beginnings) and *claims* them.
Claims that share an artifact are settled by kind, then by the first path: in rounds, a claim is granted where all its
artifacts prefer it, and claims on what is taken are dropped. That gives what going through all claims in order
would, whatever the order of rows. Granted artifacts leave their generation, and what they make enters the next.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from ..sources.files import COMBINED, HEADER
from .relations import closest_prefix

#: The kinds of claims, in the order in which they are granted.
PARTS, TAIL, WOVEN = 0, 1, 2
#: Most bytes of the artifacts of a claim together, and of an image: 512 and 64 MB.
CLAIM_BYTES, IMAGE_BYTES = 512 << 20, 64 << 20
#: Bytes of contents that Python hands over at once.
FRAME_BYTES = 16 << 20
#: Event of a set that is over a limit; it is not taken.
SET_TOO_LARGE = "set too large"
ROWS = "path string, parent string, depth int, content binary, event string"

#: The extensions of update parts in their order, main body first, then boot block, then recovery block.
EXTENSIONS = [b + c for b in ("bi", "bb") for c in "o123456789abcdefghijklm"] + ["rcv"]
LITTER = ("lng", "rec")
#: The mark of a part's header, where it may stand, and the offsets of its fields behind the header's beginning.
PART_MARK, PART_MARK_AT, BOOT_BLOCK = "FLASH", 90, "BOOT BLOCK"
#: Files that a folder has beside an image whose tail is a file of its own, and the sizes of the tails.
FLASHER, LEAST_HEAD, TAILS = ("aflash.exe", "cnv.exe", "b.bat"), 131_072, (8192, 16_384, 32_768)
#: Texts of which an interleaved image has one at least.
WOVEN_TEXTS = (
    "ALL RIGHTS RESERVED",
    "All Rights Reserved",
    "Illegal Interrupt No.",
    "Phoenix Technologies Ltd.",
    " COPR. IBM 198",
    "memory (parity error)",
    "Copyright COMPAQ Computer Corporation",
    "Press any key when ready",
    "* AMPRO Little Board",
    "Philips ROM BIOS ",
    "The following POST errors have been ",
)
#: Bytes of the beginning in which a part of one shows its share of such a text.
PROBE = 128 << 10
#: The shares by their numbers: (step, first). 0 and 1 are of pairs, 2 to 5 of quads.
SHARES = ((2, 1), (2, 0), (4, 0), (4, 1), (4, 2), (4, 3))
#: What of the texts each share has.
SHOWN = [[t[first::step].encode("ascii") for t in WOVEN_TEXTS] for step, first in SHARES]
#: Entry points that an image may end with.
ENTRY_POINT = re.compile(rb"(?s)\xEA.{2}\x00\xF0|\x0F\x09\xE9|\xE9.{2}\x00{5}")


def write(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a table below ``folder``, which all executors share."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this package's own that nothing will read again."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(table, True)


def facts(now: DataFrame) -> DataFrame:
    """(path, folder, name, stem, ext, size, part) of artifacts: names, sizes and the fields of a part's header. Narrow: contents are not among them."""
    content = F.col("content")
    head = F.decode(F.substring(content, 1, 608), "ISO-8859-1")
    marked = lambda at: F.substring(content, PART_MARK_AT + at, 5) == F.lit(PART_MARK.encode("ascii"))
    at = F.when(marked(1), 0).when(marked(513), 512)
    version = F.substring_index(F.decode(F.substring(content, at + 113, F.lit(4096)), "ISO-8859-1"), "\0", 1)
    header = F.ceil((113 + F.length(version)) / 32).cast("int") * 32
    part = F.when(
        at.isNotNull(), F.struct(at.alias("start"), (at + header).alias("data"), F.length(version).alias("version"), (F.upper(F.substring(head, 41, 10)) == BOOT_BLOCK).alias("boot"))
    )
    rows = now.filter("content is not null").select(
        "path", F.regexp_extract("path", r"^(.*/)?", 0).alias("folder"), F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.octet_length(content).cast("long").alias("size"), part.alias("part")
    )
    lower = F.lower("name")
    known = F.regexp_extract(lower, r"\.(...)$", 1)
    return rows.select("path", "folder", "name", F.when(known != "", F.expr("left(lower(name), length(name) - 3)")).alias("stem"), known.alias("ext"), "size", "part")


@F.pandas_udf(ArrayType(IntegerType()))
def shares_in(beginnings: pd.Series) -> pd.Series:
    """The numbers of the shares that each beginning has. Bytes are searched as they are, which is far quicker than a text made of them."""
    return beginnings.map(lambda b: [k for k, texts in enumerate(SHOWN) if any(t in b for t in texts)])


def shown_shares(now: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """``known`` with ``shares``: which shares of interleaved texts the beginnings have. Only artifacts that could be parts of one are
    looked into: those with another of their size in their folder, which no such step has made."""
    done = known.filter(F.col("name") == COMBINED).select("folder").distinct()
    sizes = known.groupBy("folder", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").join(done, "folder", "left_anti")
    maybe = write(known.select("path", "folder", "size").join(sizes, ["folder", "size"], "left_semi").select("path"), folder)
    some = maybe.count()
    if not some:
        return known.withColumn("shares", F.array().cast("array<int>"))
    rows = now.filter("content is not null")
    # Where few are left the contents of the others need not be read through; where most are, a join would only move them.
    rows = rows if 2 * some > known.count() else rows.join(maybe, "path", "left_semi")
    rows = rows.select("path", shares_in(F.substring("content", 1, PROBE)).alias("shares"))
    # A path may stand in several rows, which show what they show each.
    found = write(rows.filter(F.size("shares") > 0).groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shares")))).alias("shares")), folder)
    return write(known.join(found.join(maybe, "path", "left_semi"), "path", "left").withColumn("shares", F.coalesce("shares", F.array().cast("array<int>"))), folder)


def part_claims(known: DataFrame) -> DataFrame:
    """Parts of one update: files of a folder that differ in a known extension only, one of them with a header and one of the main body.

    Of names that differ in case only the first is taken.
    """
    order = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("ext")).cast("int")
    rows = known.filter(F.col("ext").isin(*EXTENSIONS)).withColumn("k", order)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("folder", "stem", "ext").orderBy("name"))).filter("n = 1")
    asks = F.col("part").isNotNull() & ~F.col("part.boot") & (F.col("size") > 608)
    sets = rows.groupBy("folder", "stem").agg(F.bool_or(asks).alias("asks"), F.bool_or(F.col("ext").startswith("bi")).alias("main"), F.min(F.struct("k", "path")).alias("first"))
    sets = sets.filter("asks and main").select("folder", "stem", F.col("first.path").alias("claim"))
    return rows.join(sets, ["folder", "stem"]).select("claim", F.lit(PARTS).alias("kind"), "k", "path")


def assigned(bases: DataFrame, candidates: DataFrame, folder: str) -> DataFrame:
    """(g, base, name): to each of ``bases`` (g, base) the closest of its group's ``candidates`` (g, name), none to two of them.

    In rounds: where several bases are closest to one candidate the first has it, and the others choose among what is left.
    """
    found = []
    while not found or not found[-1].isEmpty():
        close = closest_prefix(bases, candidates, "g", "base", "name").groupBy("g", "name").agg(F.min("base").alias("base"))
        found.append(write(close.select("g", "base", "name"), folder))
        bases = bases.join(found[-1], ["g", "base"], "left_anti")
        candidates = candidates.join(found[-1], ["g", "name"], "left_anti")
    return reduce(DataFrame.unionByName, found)


def tail_claims(known: DataFrame, folder: str) -> DataFrame:
    """An image and its tail: files of a folder with a flasher whose sizes add up to a power of two, by the closest names."""
    flashers = known.filter(F.lower("name").isin(*FLASHER)).groupBy("folder").agg(F.count_distinct(F.lower("name")).alias("n")).filter(F.col("n") == len(FLASHER)).select("folder")
    there = known.join(flashers, "folder", "left_semi")
    # The name without its extension decides; the whole name keeps those apart that have it alike.
    key = F.concat(F.lower(F.regexp_replace("name", r"\.[^.]*$", "")), F.lit("\0"), F.col("name"))
    whole = F.pow(F.lit(2), F.length(F.bin(F.col("size") - 1))).cast("long")
    group = lambda gap: F.concat(F.col("folder"), F.lit("\0"), gap.cast("string")).alias("g")
    gap = whole - F.col("size")
    bases = there.filter((F.col("size") >= LEAST_HEAD) & gap.isin(*TAILS)).select(group(gap), key.alias("base"), "path")
    tails = there.filter(F.col("size").isin(*TAILS)).select(group(F.col("size")), key.alias("name"), F.col("path").alias("tail"))
    if bases.isEmpty():
        return known.select(F.col("path").alias("claim"), F.lit(TAIL).alias("kind"), F.lit(0).alias("k"), "path").filter(F.lit(False))
    pairs = assigned(bases.select("g", "base"), tails.select("g", "name"), folder).join(bases, ["g", "base"]).join(tails, ["g", "name"])
    return pairs.select(F.col("path").alias("claim"), F.lit(TAIL).alias("kind"), F.posexplode(F.array("path", "tail")).alias("k", "path"))


#: Most names that a base may leave out, itself among them.
LEFT_OUT = 4


def closest_other(bases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(g, base, name): the candidate of a base's group, none of its up to four names in ``without``, that is found by shortening the
    base until just one other begins with what is left; where the letters never leave one, the next by name, or else the one before.

    ``bases`` has g, base and without, ``candidates`` g and name. Candidates are counted by prefix and a prefix keeps its first few,
    which are all that count, so a group's rows are never paired.
    """
    prefixes = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda k: F.substring(c, F.lit(1), k))
    names = candidates.select("g", "name").distinct()
    others = lambda c: F.filter(c, lambda x: ~F.array_contains(F.col("without"), x))
    # Of a prefix with more than LEFT_OUT + 1 names two or more are always left.
    few = names.withColumn("p", F.explode(prefixes(F.col("name")))).withColumn("r", F.row_number().over(Window.partitionBy("g", "p").orderBy("name")))
    few = few.filter(F.col("r") <= LEFT_OUT + 2).groupBy("g", "p").agg(F.array_sort(F.collect_list("name")).alias("few"))
    hits = bases.withColumn("p", F.explode(prefixes(F.col("base")))).join(few, ["g", "p"]).filter(F.size(others(F.col("few"))) == 1)
    single = hits.groupBy("g", "base").agg(F.max_by(F.get(others(F.col("few")), 0), F.length("p")).alias("name"))
    # The others look among the names around theirs, which the candidate before them knows, or the first of all.
    order = Window.partitionBy("g").orderBy("name")
    near = F.collect_list("name").over(order.rowsBetween(-LEFT_OUT - 1, LEFT_OUT + 1))
    rest = bases.join(single, ["g", "base"], "left_anti")
    both = names.withColumn("near", near).select("g", "name", "near", F.lit(None).cast("array<string>").alias("without"))
    both = both.unionByName(rest.select("g", F.col("base").alias("name"), F.lit(None).cast("array<string>").alias("near"), "without"))
    order = Window.partitionBy("g").orderBy("name", F.col("without").isNotNull())
    before = F.last("near", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # From the end on, as a window that looks ahead begins anew for each row.
    back = Window.partitionBy("g").orderBy(F.col("name").desc(), F.col("without").isNull())
    after = F.last("near", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("near", F.coalesce(before, after)).filter("without is not null").withColumn("near", others(F.col("near")))
    name = F.coalesce(F.get(F.filter("near", lambda x: x > F.col("name")), 0), F.element_at(F.col("near"), F.when(F.size("near") > 0, -1)))
    return single.unionByName(found.select("g", F.col("name").alias("base"), name.alias("name")).filter("name is not null"))


def woven_claims(known: DataFrame, folder: str) -> DataFrame:
    """Halves or quarters of one image: files of a folder and size whose beginnings show different shares of a text, by the closest names.

    Every file asks for the shares that it lacks, after the first that it shows, one after the other and each of another file.
    Outputs of such a step, which their folder's mark tells, are not taken again.
    """
    done = known.filter(F.col("name") == COMBINED).select("folder").distinct()
    rows = write(known.filter(F.size("shares") > 0).join(done, "folder", "left_anti").select("folder", "size", "name", "path", "shares"), folder)
    group = lambda share: F.concat_ws("\0", "folder", F.col("size").cast("string"), share.cast("string")).alias("g")
    there = rows.withColumn("share", F.explode("shares")).select(group(F.col("share")), "name", F.col("path").alias("taken"))
    own = F.get("shares", 0)
    wanted = F.when(own < 2, F.array(1 - own)).otherwise(F.filter(F.array(*[F.lit(k) for k in range(2, 6)]), lambda x: x != own))
    asks = rows.select("folder", "size", "name", "path", wanted.alias("wanted"), F.array("name").alias("without"), F.array("path").alias("members"))
    for k in range(3):
        if asks.isEmpty():
            break
        now = asks.filter(F.size("wanted") > k).withColumn("g", group(F.get("wanted", k)))
        close = closest_other(now.select("g", F.col("name").alias("base"), "without"), there.select("g", "name"))
        close = close.join(there, ["g", "name"]).select("g", F.col("base").alias("name"), F.col("name").alias("other"), "taken")
        now = now.join(close, ["g", "name"]).withColumn("without", F.array_append("without", F.col("other"))).withColumn("members", F.array_append("members", F.col("taken")))
        asks = write(asks.filter(F.size("wanted") <= k).unionByName(now.select(*asks.columns)), folder)
    return asks.select(F.col("path").alias("claim"), F.lit(WOVEN).alias("kind"), F.posexplode("members").alias("k", "path"))


def granted(claims: DataFrame, folder: str) -> DataFrame:
    """The rows of ``claims`` (claim, kind, k, path) that are granted: none shares a path with another, and none that is
    dropped comes before, by kind and then claim, all those that it shares one with."""
    left, found = write(claims, folder), []
    while not left.isEmpty():
        best = left.groupBy("path").agg(F.min(F.struct("kind", "claim")).alias("best"))
        ours = F.struct("kind", "claim") == F.col("best")
        wins = left.join(best, "path").groupBy("kind", "claim").agg(F.bool_and(ours).alias("wins")).filter("wins").drop("wins")
        found.append(write(left.join(wins, ["kind", "claim"], "left_semi"), folder))
        lost = left.join(found[-1].select("path"), "path", "left_semi").select("kind", "claim").distinct()
        left = write(left.join(lost, ["kind", "claim"], "left_anti"), folder)
    return reduce(DataFrame.unionByName, found) if found else left


def _image(first: dict, parts: list[dict]) -> bytes | None:
    """The image of update parts, in their order; null if it would be over the limit.

    A part tells where it goes; one of the boot block goes to the image's end as it is known by then. Whether both 64 KB halves of
    each 128 are swapped follows from the blocks that are there, or else from the length of the version.
    """
    kinds = {EXTENSIONS[p["k"] - 1][:2] for p in parts}
    recovery = "rc" in kinds
    swapped = recovery if recovery != ("bb" in kinds) else recovery or first["version"] <= 16
    start, data_at = first["start"], first["data"]
    largest = max(len(p["content"]) for p in parts) - data_at
    image, end, boot = bytearray(), 0, None
    for p in parts:
        raw = p["content"]
        area, at, last = 0, 0, 0
        if EXTENSIONS[p["k"] - 1] == "rcv":
            body, length = raw, len(raw)
        else:
            head = raw[start : start + 90]
            if len(head) < 90:
                continue
            number = lambda a: int.from_bytes(head[a : a + 4], "little")  # noqa: E731, B023
            area, at, length, last, body = head[32], number(80), number(84), head[89], raw[start + data_at :]
            end = max(end, number(33))
            at ^= 0x10000 if swapped else 0
        if area == 0:
            boot = max(0, end - length) if boot is None else boot
            at += boot
        room = max(length, largest)
        body = body[: max(room, 0)]
        fill = max(room, 0) - len(body)
        if area == 1 and last == 0xFF:
            if length <= 8192 and not kinds - {"bi"}:
                fill = 0  # it stands at the end as it is
            elif length == largest and (at >> 16 & 1) == swapped and not (fill == 0 and ENTRY_POINT.match(body[-16:])):
                fill += largest  # the boot block comes behind a gap
        elif area == 0 and at == boot:
            fill = 0
        until = at + len(body) + fill
        if max(until, end) > IMAGE_BYTES:
            return None
        image.extend(bytes(max(0, at - len(image))))
        image[at:until] = body + b"\xff" * fill
        end = max(end, until)
    return b"\xff" * ((1 << (end - 1).bit_length()) - end) + bytes(image) if end else bytes(image)


@F.pandas_udf(BinaryType())
def part_image(sets: pd.Series) -> pd.Series:
    """The image of each list of (k, start, data, version, boot, size, content), of which the first with a header of the main body leads."""

    def one(parts) -> bytes | None:
        parts = [dict(p, content=bytes(p["content"])) for p in parts]
        first = next(p for p in parts if p["start"] is not None and not p["boot"] and len(p["content"]) > 608)
        return _image(first, parts)

    return sets.map(one)


def orders_of(parts: list[bytes]) -> Iterator[tuple[str, bytes]]:
    """(name, content) of what an interleaved set makes: the parts of one size put together byte by byte, in all orders, and the parts."""
    for order in permutations(range(2 if len(parts) == 2 else 4)):
        whole = bytearray(len(parts) * len(parts[0]))
        for k, which in enumerate(order):
            whole[k :: len(parts)] = parts[which]
        yield f"deinterleaved_{''.join(map(str, order))}.bin", bytes(whole)
    for k, part in enumerate(parts):
        yield f"interleaved_{k}.bin", part


def images(sets: DataFrame) -> DataFrame:
    """What interleaved ``sets`` make, as rows of the next generation. They are made as they are read: written, the orders of a set
    would take up to 24 times its bytes, while its parts tell them all."""

    def weave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for claim, depth, members in zip(b["claim"], b["depth"], b["c"]):
                for name, content in orders_of([bytes(c) for c in members]):
                    rows.append((f"{claim}:/{name}", claim, depth, content))
                    size += len(content)
                    if size > FRAME_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    names = ["path", "parent", "depth", "content"]
    return sets.select("claim", "depth", F.transform("m", lambda p: p["content"]).alias("c")).mapInPandas(weave, ROWS.replace(", event string", ""))


def beside_flashers(now: DataFrame, sets: DataFrame) -> bool:
    """Whether a folder of the images of ``sets`` has a flasher's files too. But for those no set takes such images: their folders are
    marked, and their names' extension is none of an update's part."""
    folders = now.select(F.regexp_extract("path", r"^(.*/)?", 0).alias("folder"), F.lower(F.regexp_extract("path", r"[^/]*$", 0)).alias("name")).filter(F.col("name").isin(*FLASHER))
    return not folders.join(sets.select(F.concat("claim", F.lit(":/")).alias("folder")), "folder", "left_semi").isEmpty()


def gathered(taken: DataFrame) -> DataFrame:
    """The artifacts of granted claims, a row a claim."""
    member = F.struct("k", "part.start", "part.data", "part.version", "part.boot", "name", "path", "parent", "depth", "content")
    sets = taken.groupBy("kind", "claim").agg(F.array_sort(F.collect_list(member), lambda a, b: a["k"] - b["k"]).alias("m"))
    return sets.withColumn("depth", F.get("m", 0)["depth"] + 1)


def made(sets: DataFrame) -> DataFrame:
    """What granted claims make, as rows of the next generation, but for ``images``: an image, and marks."""
    row = lambda name, content: [F.concat("claim", F.lit(":/"), name).alias("path"), F.col("claim").alias("parent"), "depth", content.alias("content")]
    empty = F.lit(b"")

    parts = sets.filter(F.col("kind") == PARTS).withColumn("image", part_image("m"))
    lead = F.get(F.filter("m", lambda p: p["start"].isNotNull() & ~p["boot"] & (F.octet_length(p["content"]) > 608)), 0)
    head = F.substring(lead["content"], lead["start"] + 1, lead["data"] - lead["start"])
    whole = parts.filter("image is not null")
    large = parts.filter("image is null").select(F.explode("m").alias("p")).select("p.path", "p.parent", "p.depth", "p.content", F.lit(SET_TOO_LARGE).alias("event"))
    tails = sets.filter(F.col("kind") == TAIL)
    joined = F.concat(F.get("m", 0)["content"], F.get("m", 1)["content"])
    out = [
        whole.select(*row(F.lit("intel.bin"), F.col("image"))),
        whole.select(*row(F.lit(HEADER), head)),
        tails.select(*row(F.get("m", 1)["name"], joined)),
        tails.select(*row(F.lit(HEADER), empty)),
        sets.filter(F.col("kind") == WOVEN).select(*row(F.lit(COMBINED), F.unhex(F.repeat(F.lit("00"), F.size("m"))))),
    ]
    return reduce(DataFrame.unionByName, out).withColumn("event", F.lit(None).cast("string")).unionByName(large)


def group_step(now: DataFrame, folder: str, spent: str | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None, str | None]:
    """A generation (path, parent, depth, content) without the artifacts that sets of it take; what the sets make: rows of the next,
    and, with an event, those of sets over a limit; the interleaved sets, of whose ``images`` the next has to take care; and the
    table that the first is read from. All but the first are null where there is no set, the third where none is interleaved.
    ``spent`` is a table that nothing but ``now`` reads; it is removed as soon as there is another of its contents."""
    known = shown_shares(now, write(facts(now), folder), folder)
    claims = part_claims(known).unionByName(tail_claims(known, folder)).unionByName(woven_claims(known, folder))
    taken = granted(claims, folder)
    if taken.isEmpty():
        return now, None, None, None
    sizes = taken.join(known.select("path", "size"), "path").groupBy("kind", "claim").agg(F.sum("size").alias("all"))
    fits = sizes.filter(F.col("all") <= CLAIM_BYTES).select("kind", "claim")
    large = write(taken.join(fits, ["kind", "claim"], "left_anti").select("path").distinct(), folder)
    taken = write(taken.join(fits, ["kind", "claim"], "left_semi"), folder)
    # Files without a header that lie beside an update's parts are of no use.
    beside = known.filter(F.col("ext").isin(*LITTER)).join(known.join(taken.filter(F.col("kind") == PARTS), "path", "left_semi").select("folder").distinct(), "folder", "left_semi")
    beside = beside.select("path").distinct().join(large, "path", "left_anti").join(taken, "path", "left_anti")
    # What becomes of the artifacts that don't stay, in one narrow table: contents are joined with it once.
    fates = taken.join(known.select("path", "part", "name"), "path").withColumn("fate", F.lit("taken"))
    for rows, fate in ((large, "large"), (beside, "gone")):
        fates = fates.unionByName(rows.withColumn("fate", F.lit(fate)), allowMissingColumns=True)
    told = write(now.select("path", "parent", "depth", "content").join(write(fates, folder), "path", "left"), folder)
    if spent:
        remove(now.sparkSession, spent)
    over = told.filter("fate = 'large'").select("path", "parent", "depth", "content", F.lit(SET_TOO_LARGE).alias("event"))
    sets = write(gathered(told.filter("fate = 'taken'")), folder)
    woven = sets.filter(F.col("kind") == WOVEN)
    rest = told.filter("fate is null").select("path", "parent", "depth", "content")
    return rest, made(sets).unionByName(over), None if woven.isEmpty() else woven, told._written
