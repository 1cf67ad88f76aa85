"""Scalar functions over byte-like text and firmware fields, as columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if it is empty or nothing matches."""
    return filled(F.regexp_extract(text, pattern, group))


def filled(text: Column) -> Column:
    """The text, null if it is empty; computed once."""
    return bind(text, lambda x: F.when(x != "", x))


def place(text: Column, pattern: str) -> Column:
    """The place from 1 of the first match, 0 without one."""
    return F.regexp_instr(text, F.lit(pattern))


def places_of(text: Column, pattern: str) -> Column:
    """The places from 1 of all matches, in order."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(between) - 1), hits, lambda b, h: F.struct(F.length(b).alias("b"), F.length(h).alias("h")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    step = lambda a, x: F.struct((a["next"] + x["b"] + x["h"]).alias("next"), F.concat(a["at"], F.array(a["next"] + x["b"])).alias("at"))
    return F.when(F.size(hits) > 0, F.aggregate(steps, start, step)["at"]).otherwise(F.array().cast("array<int>"))


def at_offset(text: Column, at: Column, offset: int, size: int) -> Column:
    """``size`` characters from so far behind a place, or before it; empty where that is before the beginning."""
    begin = at + offset
    return F.when(begin >= 1, F.substring(text, begin.cast("int"), F.lit(size))).otherwise("")


def read_string(text: Column) -> Column:
    """A Latin-1 text up to its first zero byte, in code page 437; a backspace takes the character before it."""
    cut = F.substring_index(text, "\0", 1)

    def struck(s: Column) -> Column:
        return F.aggregate(F.split(s, ""), F.lit(""), lambda a, c: F.when((c == "\b") & (a != ""), F.substring(a, F.lit(1), F.length(a) - 1)).otherwise(F.concat(a, c)))

    return F.translate(F.when(cut.contains("\b"), struck(cut)).otherwise(cut), "".join(map(chr, range(128, 256))), CP437)


def tidy_lines(text: Column) -> Column:
    """Lines, also those parted by carriage returns or vertical tabs, without outer blanks and empty ones."""
    lines = F.split(F.regexp_replace(text, r"[\r\x0B]", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n")


def fold_lines(lines: Column, start: Column, checks: Sequence[tuple[Callable, Callable]], stop: Callable | None = None) -> Column:
    """A state after all lines: for each line the first of the ``checks`` whose condition(state, line) holds gives the next
    state by its update(state, line). From where ``stop(state)`` holds on, further lines change nothing."""

    def step(state: Column, line: Column) -> Column:
        after = reduce(lambda rest, c: F.when(c[0](state, line), c[1](state, line)).otherwise(rest), reversed(checks), state)
        return F.when(stop(state), state).otherwise(after) if stop else after

    return F.aggregate(lines, start, step)


def all_match(col: Column, patterns: Sequence[str]) -> Column:
    """Whether every pattern is found."""
    return reduce(lambda a, p: a & col.rlike(p), patterns, F.lit(True))


def compare_key(col: Column) -> Column:
    """The lower-case letters and digits alone; two names are alike if their keys are equal."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def alnum_key(col: Column, difference: Column | int = 0) -> Column:
    """(number, rest): sorts names by the number that they begin with, as far as it is from ``difference``; names without one come last."""
    number = F.regexp_extract(col, "^[0-9]+", 0)
    difference = F.lit(difference) if isinstance(difference, int) else difference
    far = F.when(number != "", F.abs(number.cast("decimal(38,0)") - difference).cast("double")).otherwise(F.lit(float("inf")))
    return F.struct(far.alias("number"), F.substring(col, F.length(number) + 1, F.length(col)).alias("rest"))


def cut_at(col: Column, mark: str) -> Column:
    """The text before the first mark."""
    return F.substring_index(col, mark, 1)


def remove_extension(col: Column) -> Column:
    return F.regexp_replace(col, r"\.[^.]*$", "")


def derive_url(path: Column) -> Column:
    """A link for a container path: what stands before the first ``:/`` , if its host part has a dot."""
    outer = F.substring_index(path, ":/", 1)
    return F.when(F.split_part(outer, F.lit("/"), F.lit(1)).contains("."), F.concat(F.lit("http://"), F.replace(outer, F.lit("#"), F.lit("%23")))).otherwise("")


def printable_runs(col: Column, least: int = 8) -> Column:
    """Runs of at least so many printable ASCII characters or tabs."""
    return F.regexp_extract_all(col, F.lit(f"([\\x20-\\x7E\\t]{{{least},}})"), F.lit(1))


def le_uint(data: Column, offset: int, size: int) -> Column:
    """An unsigned little-endian number in a binary column; null beyond its end."""
    parts = [F.conv(F.hex(F.substring(data, offset + k + 1, 1)), 16, 10).cast("long") * (1 << (8 * k)) for k in range(size)]
    return F.when(F.octet_length(data) >= offset + size, reduce(lambda a, b: a + b, parts))


def crc16(data: Column) -> Column:
    """CRC-16 of a binary column, reflected polynomial 0xA001, start 0."""
    length = F.octet_length(data)
    codes = F.transform(F.sequence(F.lit(1), length), lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("int"))
    step = lambda c: F.when(c.bitwiseAND(1) == 1, F.shiftright(c, 1).bitwiseXOR(F.lit(0xA001))).otherwise(F.shiftright(c, 1))
    eight = lambda c: F.aggregate(F.array(*[F.lit(0)] * 8), c, lambda x, _: step(x))
    return F.when(length > 0, F.aggregate(codes, F.lit(0), lambda c, b: eight(c.bitwiseXOR(b)))).otherwise(F.lit(0))


def every_nth(col: Column, n: int, first: int) -> Column:
    """Characters first, first + n, ... of a text, counted from 0: one part of an n-way interleave."""
    size = F.length(col)
    at = F.sequence(F.lit(first + 1), F.greatest(size, F.lit(first + 1)), F.lit(n))
    return F.when(size > first, F.array_join(F.transform(at, lambda i: F.substring(col, i, 1)), "")).otherwise("")


def interleave(parts: Sequence[Column]) -> Column:
    """The text whose every n-th characters are the parts, for parts of equal length."""
    size = F.length(parts[0])
    at = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    return F.when(size > 0, F.array_join(F.transform(at, lambda i: F.concat(*[F.substring(p, i, 1) for p in parts])), "")).otherwise("")


def rotated_text(col: Column, invert: bool) -> Column:
    """The codes of a text stored as complement rotated right by three, or as negative rotated left by one; seven bits each."""
    codes = F.transform(F.split(col, ""), lambda c: F.ascii(c))

    def decode(c: Column) -> Column:
        if invert:
            x = F.lit(255) - c
            return F.shiftright(x, 3).bitwiseOR(F.shiftleft(x, 5)).bitwiseAND(127)
        x = F.pmod(-c, F.lit(256))
        return F.shiftleft(x, 1).bitwiseOR(F.shiftright(x, 7)).bitwiseAND(127)

    return F.transform(F.filter(codes, lambda c: c > 0), decode)


#: The upper half of code page 437.
CP437 = (
    "ÇüéâäàåçêëèïîìÄÅÉæÆôöòûùÿÖÜ¢£¥₧ƒáíóúñÑªº¿⌐¬½¼¡«»"
    "░▒▓│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌█▄▌▐▀"
    "αßΓπΣσµτΦΘΩδ∞φε∩≡±≥≤⌠⌡÷≈°∙·√ⁿ²■ "
)


def decode_cp437(data: Column) -> Column:
    """Text of a binary column in code page 437."""
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(128, 256))), CP437)


def pnp_id(number: Column) -> Column:
    """Three letters of five bits each, then four hexadecimal digits."""
    letter = lambda n: F.char(F.lit(64) + F.shiftright(number, n).bitwiseAND(31))
    return F.concat(letter(26), letter(21), letter(16), F.lpad(F.hex(number.bitwiseAND(0xFFFF)), 4, "0"))


def pivot_date(col: Column) -> Column:
    """(valid, year, month, day) of MM/DD/YY or MM/DD/YYYY at the start; two digits below 80 are of 2000. Compares as a date."""
    part = lambda k: F.regexp_extract(col, r"^(\d{2})/(\d{2})/(\d{4}|\d{2})", k)
    number = lambda k: F.when(part(k) != "", part(k).cast("int"))
    year = number(3)
    year = F.when(F.length(part(3)) == 4, year).when(year < 80, year + 2000).otherwise(year + 1900)
    return F.struct(year.isNotNull().alias("valid"), year.alias("year"), number(1).alias("month"), number(2).alias("day"))


def widen_palette(col: Column) -> Column:
    """Six-bit colours, in the low 18 bits from red down, as an eight-bit #RRGGBB."""
    part = lambda n: F.lpad(F.hex(F.shiftleft(F.shiftright(col, n).bitwiseAND(63), 2)), 2, "0")
    return F.concat(F.lit("#"), part(12), part(6), part(0))


def power_of_two(col: Column) -> Column:
    return (col > 0) & (col.bitwiseAND(col - 1) == 0)


#: Company suffixes that a short vendor name drops, and names with a short form.
VENDOR_SUFFIXES = (
    r"(?i)([ ,.]+(Semiconductors?|(Micro)?electronics?|Interactive|Technolog(y|ies)|(Micro)?systems|Computer( works)?|Products|Group|and subsidiaries|"
    r"of( America)?|Co(rp(oration)?|mpany)?|Inc|LLC|Ltd|GmbH( & .+)?|AB|AG|SA|[(\[{].*)[ ,.]*)+$"
)
VENDOR_FORCED = {"National Semiconductor Corporation": "NSC"}
VENDOR_NAMES = {
    "Chips and": "C&T",
    "Digital Equipment": "DEC",
    "Integrated Technology Express": "ITE",
    "Microchip Technology/SMSC": "Microchip/SMSC",
    "NVidia/SGS Thomson": "NVIDIA/ST",
    "S3 Graphics": "S3",
    "Silicon Integrated": "SiS",
    "Silicon Motion": "SMI",
    "STMicroelectronics": "ST",
    "Texas Instruments": "TI",
    "VMWare": "VMware",
}
#: How words of device names are shortened, in this order; $2 on are the groups of the pattern itself.
DEVICE_WORDS = (
    (r"([A-Z])[^- ]+[- ]([A-Z])[^ ]+ (?:\(|\[|\{|/)\2\3(?:$|\)|\]|\})", "$2$3"),
    (r"([A-Z])[^- ]+[- ]([A-Z])[^- ]+[- ]([A-Z])[^ ]+ (?:\(|\[|\{|/)\2\3\4(?:$|\)|\]|\})", "$2$3$4"),
    (r"([A-Z])[^- ]+[- ]([A-Z])[^- ]+[- ]([A-Z])[^- ]+[- ]([A-Z])[^ ]+ (?:\(|\[|\{|/)\2\3\4\5(?:$|\)|\]|\})", "$2$3$4$5"),
    (r"100Base-TX?", "FE"),
    (r"1000Base-T", "GbE"),
    (r"Accelerat(?:ion|or)", "Accel."),
    (r"Alert on LAN", "AoL"),
    (r"\((.+) applications?\)", "($2)"),
    (r"Chipset Family", "Chipset"),
    (r"Chipset Graphics", "iGPU"),
    (r"Connection", "Conn."),
    (r"DECchip", ""),
    (r"Dual (Lane|Port)", "2-$2"),
    (r"Fast Ethernet", "FE"),
    (r"Fibre Channel", "FC"),
    (r"Function", "Func."),
    (r"([0-9]{1,3})G Ethernet", "$2GbE"),
    (r"(?:([0-9]{1,3}) ?)?(?:G(?:bit|ig) Ethernet|GbE)", "$2GbE"),
    (r"Graphics Processor", "GPU"),
    (r"High Definition Audio", "HDA"),
    (r"Host Adapter", "HBA"),
    (r"Host Bus Adapter", "HBA"),
    (r"Host[- ]Controller", "HC"),
    (r"Input/Output", "I/O"),
    (r"Integrated ([^\s]+) (?:Graphics|GPU)", "$2 iGPU"),
    (r"Integrated (?:Graphics|GPU)", "iGPU"),
    (r"([0-9]) (lane|port)", "$2-$3"),
    (r"Local Area Network", "LAN"),
    (r"Low Pin Count", "LPC"),
    (r"Memory Controller Hub", "MCH"),
    (r"Network (?:Interface )?(?:Adapter|Card|Controller)", "NIC"),
    (r"NVM Express", "NVMe"),
    (r"Parallel ATA", "PATA"),
    (r"PCI(?:-E|[- ]Express)", "PCIe"),
    (r"([^- ]+)[- ]to[- ]([^- ]+)", "$2-$3"),
    (r"Platform Controller Hub", "PCH"),
    (r"Processor Graphics", "iGPU"),
    (r"Quad (Lane|Port)", "4-$2"),
    (r"Serial ATA", "SATA"),
    (r"Serial Attached SCSI", "SAS"),
    (r"Single (Lane|Port)", "1-$2"),
    (r"USB ?([0-9])\.0", "USB$2"),
    (r"USB ?([0-9])\.[0-9] ?Gen([0-9x]+)", "USB$2.$3"),
    (r"USB ?([0-9]\.[0-9])", "USB$2"),
    (r"Virtual Machine", "VM"),
    (r"Wake on LAN", "WoL"),
    (r"Wireless LAN", "WLAN"),
    (r"([^ \(\[\{/]+) (?: |\(|\[|\{|/)\2(?: |\)|\]|\})", "$2"),
)
DEVICE_BITS = r"(?i)( |^|\(|\[|\{|/)(?:([0-9]{1,4}) )?(?:(K)(?:ilo)?|(M)(?:ega)?|(G)(?:iga)?)bit( |$|\)|\]|\})"
DEVICE_SUFFIX = r"(?i) (?:Adapter|Card|Device|(?:Host )?Controller)( (?: [0-9#]+)?|$|\)|\]|\})"


def clean_vendor(col: Column) -> Column:
    """A short vendor name: a known one, or the abbreviation in brackets, or the name without company suffixes."""
    table = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    name = F.replace(col, F.lit(" / "), F.lit("/"))
    bare = F.regexp_replace(F.regexp_replace(name, VENDOR_SUFFIXES, ""), r"[ ,.]+$", "")
    known = F.coalesce(F.try_element_at(table(VENDOR_FORCED), col), found(name, r" \[([^\]]+)\]", 1), F.try_element_at(table(VENDOR_NAMES), bare))
    return F.coalesce(known, F.regexp_replace(F.trim(bare), " +", " "))


def clean_name(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Rewrite rules one after the other, then single spaces."""
    return F.trim(F.regexp_replace(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, col), " +", " "))


def _groups(pattern: str) -> int:
    """The groups of a pattern, of which none is opened in brackets or behind a backslash but those that are none."""
    return len(re.findall(r"(?<!\\)\((?!\?)", re.sub(r"\[[^\]]*\]", "", pattern)))


def clean_device(col: Column, vendor: Column | None = None) -> Column:
    """A short device name: words and whole phrases shortened wherever they stand apart, without its vendor's name in front."""
    apart = [(rf"(?i)( |^|\(|\[|\{{|/){p}( |$|\)|\]|\}})", f"$1{to}${_groups(p) + 2}") for p, to in DEVICE_WORDS]
    name = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), [(DEVICE_BITS, "$1$2$3$4$5bit$6"), *apart, (DEVICE_SUFFIX, "$1")], col)
    if vendor is not None:
        name = F.when((vendor != "") & F.startswith(name, vendor), F.substring(name, F.length(vendor) + 1, F.length(name))).otherwise(name)
    return F.trim(F.regexp_replace(name, " +", " "))
