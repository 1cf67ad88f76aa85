"""Side findings of artifacts: tables, certificates, identifiers and signatures, as columns and joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .vendors import UEFI_HEADER, entry

#: Signatures and forms of the findings below.
ACPI = r"(?s)((?:DSDT|FACP|PSDT|RSDT|SBST|SSDT).{4})(?:.{20}|.{24})[\x00\x20-\x7E]{4}"
SLI = r"[0-9]{12}Genuine NVIDIA Certified SLI Ready Motherboard for ([\x20-\x7E]*)[\x20-\x7E]{4}-Copyright [0-9]{4} NVIDIA"
OROM_NAME = r"^amipci_([0-9A-Fa-f]{4})_([0-9A-Fa-f]{4})\.rom$"


#: Most distinct places of a signature table: one row that every task gets.
MOST_PLACES = 4096
#: Structures of the system tables by type: name, lengths, where the numbers of its three texts stand.
TABLES = {
    0: ("BIOS", range(0x12, 0x100), (0x04, 0x05, 0x08)),
    1: ("System", (0x08, 0x19, 0x1B), (0x04, 0x05, 0x06)),
    2: ("Board", range(0x08, 0x100), (0x04, 0x05, 0x06)),
    4: ("CPU", range(0x1A, 0x31), (0x04, 0x07, 0x10)),
}
TABLE_TEXTS = re.compile(rb"(?:[\x20-\x7E]{1,255}\0){1,255}\0")
TABLE_DATE = re.compile(r"[0-9]{2}/[0-9]{2}/[0-9]{2}(?:[0-9]{2})?$")
#: Texts and forms of expansion ROMs.
ADAPTEC, NCR = re.compile(rb"Adaptec (?:BIOS:([\x20-\x7E]+)|([\x20-\x7E]+?)(?: SCSI)? BIOS )"), re.compile(rb" SDMS \(TM\) V([0-9.]+)")
PXE, RPL = (b"PXE-M0F: Exiting ", b"PXE-EC6: UNDI driver image is invalid."), b"NetWare Ready ROM"
ROM_TEXT = re.compile(rb"[\r\n\x20-\x7E]{9,}")
VGA_TEXT = re.compile(rb"[\r\n\x20-\x7E]{16,}(?:\0[\r\n\x20-\x7E]{16,})?")
VGA_TRIM = re.compile(
    r"(?:IBM (?:(?:VGA )?Compat[ia]ble(?: BIOS)?|IS A TRADEMARK OF INTERNATIONAL BUSINESS MACHINES CORP(?:([\x20-\x7E]+?) Phone-\([\x21-\x7E]+)?)|"
    r"\*\* +RESERVED FOR IBM COMPATIBILITY +\*\*|This is not a product of IBM|NOT AN IBM BIOS\!)[\x20-\x2F\x3A-\x40\x5B-\x60\x7A-\x7E]*",
    re.I,
)
#: A ROM: what it is sorted by (texts first, then numbers), and its ids, number or text.
ROM = StructType([StructField("rank", LongType()), StructField("vendor_id", IntegerType()), StructField("device_id", IntegerType()), StructField("number", LongType()), StructField("label", StringType()), StructField("text", StringType())])
SCAN = StructType([StructField("roms", ArrayType(ROM)), StructField("devices", ArrayType(StringType())), StructField("tables", ArrayType(StringType()))])


def _text(data: bytes) -> str:
    return data.split(b"\0", 1)[0].decode("cp437")


def table_texts(data: bytes, kind: int) -> Iterator[tuple[int, list[str]]]:
    """(place, three texts) of the structures of a type whose numbers lead to texts behind them, in order."""
    _, lengths, fields = TABLES[kind]
    a = np.frombuffer(data, np.uint8)
    if len(a) < 8:
        return
    at = np.flatnonzero(a[:-1] == kind)
    size = a[at + 1].astype(np.int64)
    at = at[np.isin(size, list(lengths)) & (at + size < len(a))]
    size = a[at + 1].astype(np.int64)
    numbers = np.stack([a[np.minimum(at + f, len(a) - 1)] for f in fields])
    begins = a[np.minimum(at + size, len(a) - 1)]
    for k in np.flatnonzero((numbers > 0).any(0) & (begins >= 0x20) & (begins <= 0x7E)).tolist():
        p, end = int(at[k]), int(at[k] + size[k])
        if m := TABLE_TEXTS.match(data[end : end + 4096]):
            texts = m[0].split(b"\0")[:-2]
            if int(numbers[:, k].max()) <= len(texts):
                out = [texts[n - 1].decode("cp437").strip() if n else "" for n in numbers[:, k].tolist()]
                if any(out):
                    yield p, out


def system_tables(data: bytes) -> list[str]:
    """Lines of the first fitting structure of each type, sorted; one line for a board and a system of one name."""
    alike, lines, system = (lambda x: re.sub("[^a-z0-9]", "", x.lower())), [], None
    for kind, (name, *_) in TABLES.items():
        for p, texts in table_texts(data, kind):
            length, of = data[p + 1], lambda k: data[p + k]  # noqa: B023
            fits = {
                0: lambda: TABLE_DATE.match(texts[2]),  # noqa: B023
                1: lambda: length <= 0x18 or of(0x18) <= 8,  # noqa: B023
                2: lambda: length <= 0x0D or 1 <= of(0x0D) <= 0x0D,  # noqa: B023
                4: lambda: of(0x05) <= 6,  # noqa: B023
            }[kind]
            if fits():
                whole = " ".join(texts)
                if kind == 2 and system and alike(system) == alike(whole):
                    lines[-1] = f"[Board/System] {whole}"
                else:
                    lines.append(f"[{name}] {whole}")
                system = whole if kind == 1 else None
                break
    return sorted(set(lines))


def _named(rom: bytes, pointer: int) -> str:
    return _text(rom[pointer:]) if pointer >= 26 else ""


def _rom_text(rom: bytes, entry_byte: int) -> tuple[str, str] | None:
    """(label, text) of a ROM that names no device: around and behind a display adapter's mark, or near the header."""
    if rom[0x1E:0x21] == b"IBM":
        begin, end = 0x1E, 0x21
        while rom[begin - 1 : begin] == b" " or begin < 0x1E and 0x20 <= rom[begin - 1] <= 0x7E:
            begin -= 1
        while rom[end : end + 1] == b" " or end > 0x21 and end < len(rom) and 0x20 <= rom[end] <= 0x7E:
            end += 1
        text = _text(rom[begin:end]).strip()
        if more := VGA_TEXT.search(rom, end):
            text = "\n".join(filter(None, (VGA_TRIM.sub("", text).strip(), _text(more[0].replace(b"\0", b" ")).strip())))
        return "VGA", text
    if len(rom) >= 4096 and not len(rom) & 0x7FF and entry_byte in b"\xe9\xeb":
        m = ROM_TEXT.search(rom, 5, 4096)
        if m and RPL in m[0]:
            m = ROM_TEXT.search(rom, m.end(), 4096)
        text = _text(m[0]).strip() if m else ""
        if len(text) <= 256 and text != "Invalid Partition Table":
            return "OROM", text
    return None


def expansion_roms(data: bytes) -> tuple[list[tuple], list[str]]:
    """(ROM rows, metadata lines) of the expansion ROMs in an image; a ROM gives its devices, or else its text."""
    roms, lines, at = set(), set(), 0
    while (p := data.find(b"\x55\xaa", at)) >= 0 and p + 28 <= len(data):
        at = p + 2
        if not data[p + 2]:
            continue
        at = p + 28
        rom = data[p : p + 512 * data[p + 2]]
        if m := ADAPTEC.search(rom):
            lines.add("[SCSI] " + " ".join(filter(None, ("Adaptec", _text(m[1] or m[2] or b"")))))
        if m := NCR.search(rom):
            lines.add("[SCSI] NCR " + _text(m[1]))
        if lan := [name for name, marks in (("PXE", PXE), ("RPL", (RPL,))) if all(x in rom for x in marks)]:
            lines.add("[LAN] " + " ".join(lan))
        pci, pnp = int.from_bytes(rom[0x18:0x1A], "little"), int.from_bytes(rom[0x1A:0x1C], "little")
        word = lambda k: int.from_bytes(rom[k : k + 2], "little")  # noqa: B023, E731
        if pci >= 26 and rom[pci : pci + 4] == b"PCIR" and pci + 16 <= len(rom) and word(pci + 4) not in (0, 0xFFFF):
            vendor, devices, listed = word(pci + 4), [word(pci + 6)], word(pci + 8)
            if rom[pci + 12] >= 3 and listed >= 10:
                k = pci + listed
                while k + 2 <= len(rom) and word(k):
                    devices.append(word(k))
                    k += 2
            roms |= {(vendor, vendor, d, None, None, None) for d in devices}
            continue
        if pnp >= 26 and rom[pnp : pnp + 4] == b"$PnP" and pnp + 18 <= len(rom):
            number, names = rom[pnp + 10 : pnp + 14], "\n".join(filter(None, (_named(rom, word(pnp + 14)), _named(rom, word(pnp + 16)))))
            if number[:2] != b"\0\0" and names:
                roms.add((int.from_bytes(number, "big"), None, None, int.from_bytes(number, "big"), None, names))
                continue
        if found := _rom_text(rom, data[p + 3]):
            text = [x.strip() for x in found[1].replace("\r", "\n").split("\n")]
            text = "\n".join(x for x in text if len(x) > 3 and x[:10] != x[0] * min(len(x), 10))
            roms.add((-1, None, None, None, found[0], text))
    return sorted(roms, key=repr), sorted(lines)


@F.pandas_udf(SCAN)
def scanned(contents: pd.Series) -> pd.DataFrame:
    """The expansion ROMs, their metadata lines and the system table lines of each image: structures with pointers to follow."""
    out = []
    for c in contents:
        data = bytes(c) if c is not None else b""
        roms, lines = expansion_roms(data)
        out.append(([dict(zip(ROM.names, r)) for r in roms], lines, system_tables(data)))
    return pd.DataFrame(out, columns=["roms", "devices", "tables"])


def side_metadata(text: Column, scan: Column, header: Column | None = None) -> Column:
    """The metadata lines of an artifact that are found whatever its vendor: ACPI, DMI, SLI, UEFI, SCSI and LAN."""
    lists = lambda key, c, by: F.when(F.size(c) > 0, entry(key, F.array_join(c, by)))
    uefi = F.lit(None).cast("string") if header is None else F.when(header == F.encode(F.lit(UEFI_HEADER), "ISO-8859-1"), "[UEFI] Filesystem")
    lines = F.array(lists("ACPI", acpi_tables(text), " "), lists("DMI", scan["tables"], "\n"), entry("SLI", sli_board(text)), uefi)
    return F.array_distinct(F.concat(F.filter(lines, lambda x: x.isNotNull()), F.coalesce(scan["devices"], F.array().cast("array<string>"))))


def acpi_tables(text: Column) -> Column:
    """The distinct ACPI table names of a Latin-1 text whose length field is beyond its header, sorted."""
    heads = F.regexp_extract_all(text, F.lit(ACPI), F.lit(1))
    code = lambda h, k: F.ascii(F.substring(h, k, 1))
    size = lambda h: code(h, 5) + 256 * code(h, 6) + 65536 * code(h, 7) + 16777216 * code(h, 8).cast("long")
    return F.array_sort(F.array_distinct(F.transform(F.filter(heads, lambda h: size(h) > 36), lambda h: F.substring(h, 1, 4))))


def sli_board(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, SLI, 1), F.lit(""))


def rom_ids(name: Column) -> Column:
    """(vendor_id, device_id) of an option ROM's file name; null for other names."""
    number = lambda k: F.conv(F.regexp_extract(name, OROM_NAME, k), 16, 10).cast("int")
    return F.when(name.rlike(OROM_NAME), F.struct(number(1).alias("vendor_id"), number(2).alias("device_id")))


def signature_hits(blobs: DataFrame, signatures: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, signature): the first signature, by key, all of whose patterns stand at their places.

    The places are those of the signature table, so every blob gives as many byte strings as there are places, and
    these meet the patterns in an equi-join.
    """
    places = signatures.groupBy("from_end", F.octet_length("pattern").alias("size")).agg(F.lit(1)).select("from_end", "size")
    if places.count() > MOST_PLACES:
        raise ValueError(f"a signature table has at most {MOST_PLACES} distinct places")
    spots = places.agg(F.collect_list(F.struct("from_end", "size")).alias("spots"))  # the distinct places of the table, in one row
    cut = blobs.select(F.col(key).alias("blob"), F.col(content).alias("c")).join(F.broadcast(spots), F.lit(True)).withColumn("s", F.explode("spots"))
    found = cut.filter(F.octet_length("c") + F.col("s.from_end") >= 0).select("blob", F.col("s.from_end").alias("from_end"), F.expr("substring(c, int(octet_length(c) + s.from_end + 1), s.size)").alias("pattern"))
    total = signatures.groupBy(F.col("key").alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    hits = found.join(signatures.select(F.col("key").alias("signature"), "from_end", "pattern", "place"), ["from_end", "pattern"])
    whole = hits.groupBy("blob", "signature").agg(F.countDistinct("place").alias("k")).join(total, "signature").filter("k = n")
    return whole.groupBy("blob").agg(F.min("signature").alias("signature")).withColumnRenamed("blob", key)


def combined_metadata(df: DataFrame, *pairs: tuple[str, Column]) -> Column:
    """``[key] value`` lines of several findings, distinct and sorted; lists are joined by spaces, empty ones left out."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    lines = F.array(*[F.when(text(c).isNotNull(), F.concat(F.lit(f"[{k}] "), text(c))) for k, c in pairs])
    return F.array_join(F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull()))), "\n")
