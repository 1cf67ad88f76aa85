"""Ordered, first-match-wins classification of artifacts.

Rules are rows of a table: a priority, a vendor, patterns that must all be found, and patterns whose groups give the
version, string and sign-on. All rules are columns over the artifact's bytes as ISO-8859-1 text; the rule of the least
priority that is satisfied and has a version wins. No Python runs on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vendors as V
from .phoenix_rule import phoenix
from ..functions.scalar import all_match, bind, every_nth, found, pivot_date

Take = tuple[str, int] | str | Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """version, string, signon and the values of metadata are each a pattern and a group, a fixed text, or a column made
    of the artifact's text; ``find`` makes the whole finding of text and header instead."""

    priority: int
    vendor: str | Callable[[Column], Column]
    version: Take = "?"
    needs: tuple[str, ...] = ()
    string: Take | None = None
    signon: Take | None = None
    prefix: str = ""
    least_size: int = 0
    also: Callable[[Column], Column] | None = None  # a further condition
    header: str | None = None  # what the artifact's header must be
    metadata: tuple[tuple[str, Take], ...] = ()
    find: Callable[[Column, Column | None], Column] | None = None
    marks: tuple[str, ...] = ()  # plain texts, one of which is there if the rule holds: it is looked at only then


def newest_date(text: Column, pattern: str) -> Column:
    """The newest of the dates that are the pattern's group."""
    dates = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_max(F.transform(dates, lambda d: F.struct(pivot_date(d).alias("k"), d.alias("d"))))["d"]


def newest_entry_date(text: Column) -> Column:
    """The newest date behind an entry-point jump."""
    return newest_date(text, ENTRY_DATE)


def quadtel(offset: int, size: int) -> Callable[[Column], Column]:
    """The text so far behind the copyright, up to a zero byte."""
    return lambda t: F.substring_index(F.substring(t, F.regexp_instr(t, F.lit(QUADTEL)) + offset, F.lit(size)), "\0", 1)


def quadtel_version(text: Column) -> Column:
    found = F.nullif(F.regexp_extract(quadtel(0xC8, 0xC8)(text), r"(?d).+ BIOS Version ([^\r\n]+)", 1), F.lit(""))
    bare = F.regexp_replace(F.trim(F.regexp_replace(found, r"\.+$", "")), r"\.+$", "")
    return F.when(bare.startswith("Q"), F.concat(F.substring(bare, 2, 256), F.lit(" (Phoenix)"))).otherwise(bare)


def surepath(text: Column) -> Column:
    """The version where there is one, else the name alone if a variant or product data shows it."""
    own = F.trim(F.regexp_extract(text, SUREPATH, 1))
    return F.when(own != "", F.concat(F.lit("SurePath "), own)).when(text.rlike(APRICOT) | text.rlike(SUREPATH_ID), "SurePath")


def surepath_signon(text: Column) -> Column:
    variant = F.trim(F.substring(F.regexp_extract(text, APRICOT, 0), 5, 256))
    version = F.trim(F.substring(F.regexp_extract(text, r"@\(#\)Version [\x20-\x7E]+", 0), 5, 256))
    other = F.nullif(F.concat_ws("\n", F.nullif(variant, F.lit("")), F.nullif(version, F.lit(""))), F.lit(""))
    return F.when(text.rlike(SUREPATH), F.nullif(F.regexp_extract(text, SUREPATH, 2), F.lit(""))).when(variant != "", other)


def part_numbers(text: Column) -> Column:
    """The distinct part numbers before a copyright, sorted; those of two interleaved images are taken apart."""
    plain = F.regexp_extract_all(text, F.lit(IBM_PART), F.lit(1))
    twice = F.regexp_extract_all(text, F.lit(IBM_PART_TWICE), F.lit(1))
    parts = F.flatten(F.transform(twice, lambda x: F.array(every_nth(x, 2, 0), every_nth(x, 2, 1))))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.concat(plain, parts))), "\n"), F.lit(""))


def text_at(from_end: Callable[[Column], Column], size: int) -> Callable[[Column], Column]:
    """The text up to a zero byte, of at most ``size``, that begins so far before the end."""
    return lambda t: F.substring_index(F.substring(t, F.length(t) - from_end(F.length(t)) + 1, F.lit(size)), "\0", 1)


def coreboot(part: int) -> Callable[[Column], Column]:
    """Vendor (0) or version (1) by the newer form of the version, or else by the older."""

    def take(t: Column) -> Column:
        new = F.regexp_extract(t, COREBOOT_NEW, 1)
        old = F.nullif(F.regexp_extract(t, COREBOOT_OLD, 1 + part), F.lit(""))
        return F.when(new != "", F.substring_index(new, "-", 1) if part else F.lit("coreboot")).otherwise(old)

    return take


def coreboot_id(t: Column) -> Column:
    """The whole version, as it is written."""
    new = found(t, COREBOOT_NEW)
    return F.coalesce(F.concat(F.lit("coreboot "), new), F.regexp_replace(found(t, COREBOOT_OLD, 0), r"starting\.\.\.$", ""))


#: Patterns that more than one rule needs, or that its functions use.
ENTRY_DATE = r"(?s)(?:\xEA..\x00\xF0|\xE9..)((?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/[0-9]{2})"
IBM_PART = r"([0-9]{2}[A-Z0-9][0-9]{4})  ?(?:COPR\. IBM|\(C\) COPYRIGHT IBM CORPORATION) 19[89][0-9]"
IBM_PART_TWICE = r"(([0-9])\2([0-9])\3([A-Z0-9])\4[0-9]{8})  (?:CCOOPPRR\.\.  IIBBMM|\(\(CC\)\)  CCOOPPYYRRIIGGHHTT  IIBBMM  CCOORRPPOORRAATTIIOONN)  1199([89])\5([0-9])\6"
IBM_LONG = r"\(C\) COPYRIGHT IBM CORPORATION 19[89]|\(\(CC\)\)  CCOOPPYYRRIIGGHHTT  IIBBMM  CCOORRPPOORRAATTIIOONN  1199"
COREBOOT_NEW = r"(?:#(?: This image was built using coreboot |define COREBOOT_VERSION \")|COREBOOT_VERSION: )([\x20-\x21\x23-\x7E]+)"
COREBOOT_BUILD = r"#define COREBOOT_BUILD \"([^\"]+?)\""
DTK = r"(?:(?:DTK|GoldStar) [\x20-\x7E]+ BIOS Ver(?:sion)? |(?:DTK)/[\x21-\x2E\x30-\x7E]+/BIOS )([\x21-\x7E]+)(?: [\x20-\x7E]+)?"
COREBOOT_OLD = r"(LinuxBIOS|coreboot)-([^_ ]+)[_ ](?:Normal |Fallback )?(?:.* )?starting\.\.\."
INTEL_CODE = (
    r"(?:\$(?:IBIOSI\$|FID|UBI)|Load Error\x00{2}Success\x00|S\x00l\x00o\x00t\x00 \x00\x30\x00:\x00 \x00+)([0-9A-Z]{8}\.[0-9A-Z]{3}(?:\.[0-9]{4}){4})",
    r"([A-Z]{2}[0-9A-Z]{3}[0-9]{2}[A-Z]\.[0-9]{2}[A-Z](?:\.[0-9]{4}){4})",
)
#: The older and the newer form of version and part number, and a maker's sign-on, in front of which older images have code.
MR = (
    r"Ver:? (V[\x21-\x2C\x2E-\x7E]+)(?:-| +Port )([\x21-\x7E]+)",
    r"[A-Z ]{7} \((?:r|tm)\)  (V[\x21-\x26\x28-\x7E]+) \x09 ([\x21-\x7E]+)",
    r"OEM SIGNON >>-->(?:[\x20-\x7E][\x00-\x1F\x7F-\xFF][\x00-\xFF]{14})?([\x20-\x7E]*?)\x00?<--<< OEM SIGNON",
)
QUADTEL = r"Copyright 19..-.... Quadtel Corp\. Version"
SUREPATH = r"SurePath BIOS Version ([\x20-\x7E]+)(?:[\x0D\x0A\x00]+([\x20-\x7E]+)?)?"
SUREPATH_ID = r"\xAA\x55VPD0RESERVE([0-9A-Z]{7})"
APRICOT = r"(?d)@\(#\)(?:Apricot .*|XEN-PC) BIOS [\x20-\x7E]+"
IBM_RIGHTS = (
    r"\(\(CC\)\)  CCOOPPYYRRIIGGHHTT  (?:IIBBMM  CCOORRPPOORRAATTIIOONN  11998811,,  ([0-9])\1([0-9])\2([0-9])\3([0-9])\4|11998811,,  ([0-9])\5([0-9])\6([0-9])\7([0-9])\8  IIBBMM  CCOORRPPOORRAATTIIOONN)  (?:--  )?AALLLL  RRIIGGHHTTSS  RREESSEERRVVEEDD|"
    r"\(C\) COPYRIGHT (?:IBM CORPORATION 1981, [0-9]{4}|1981, [0-9]{4} IBM CORPORATION) (?:- )?ALL RIGHTS RESERVED[ \x0D\x0A]*(?:[\x00\xFF]|US Government Users)"
)
TOSHIBA = (
    r"This BASIC was aborted,\x0Dbecause this machine has\x0Dno ROM BASIC\.\x0D\x0D Use Toshiba's BASIC\.\x0D|Toshiba Corporation\.( & Award Software Inc|ALL RIGHTS RESERVED)\.",
    r"(?s)(?:([\x21-\x7F]+\s*V[\x21-\x7F]{1,16}\s*)TOSHIBA |\x00{3}BIOS.{4}([\x20-\x7E]{16}))",
)
GENERAL = (
    r"General Software (?:\x00 )?([^\\\x0D\x0A]+)(?:rel\.|Revision)",
    r"([0-9]{2}/[0-9]{2}/[0-9]{2})\(C\) [0-9]+ General Software, Inc\. ([^\x00]{0,256})",
)
COMPAQ = (
    r"Copyright ([0-9]+ by )?COMPAQ Computer Corporation",
    r"Insert (?:DIAGNOSTIC diskette in Drive |COMPAQ DOS diskette)|You must load COMPAQ BASIC|[0-9]{2}/[0-9]{2}/[0-9]{2} +[^ ]+ +Copyright [0-9]+ by COMPAQ Computer Corporation",
    r"(?s)[0-9]{2}COMPAQ\xEA..\x00\xF0(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/[0-9]{2} ",
)
ICL = r"(?:ROM|System) BIOS (#[\x20-\x7E]+) Version ([\x20-\x7E]+)\x0D\x0A\(c\) Copyright [\x20-\x7E]+(?:\x0D\x0A\x0A\x00([\x20-\x7E]+))?"

#: Plain texts, parts of a rule's patterns, of which an artifact that the rule takes has one at least. They are far quicker to look
#: for than patterns, and most artifacts have none.
MARKS = {
    2: ("PowerBIOS Setup",), 3: ("Toshiba",), 4: ("Software Inc.", "SSooffttwwaarree IInncc", "AWARD SOFTWARE INC.", "Award Decompression Bios"), 5: (" Quadtel Corp. Version",),
    6: ("Phoenix", "PPhhooeenniixx"), 8: ("American Megatrends Inc", "AMIBIOSC", " Access Methods Inc.", "AMI- "), 10: ("Ver V", "Ver: V", ")  V"), 11: ("Acer Incorporated 1990", "Acer Boot Block v1.0"),
    12: ("Multitech Industrial Corp",), 13: ("AMPRO ",), 14: ("AMSTRAD plc", "Amstrad plc", "Amstrad Consumer Electronics plc"), 15: ("NCR'S VERSION IBM", " COMPUTER DEVICES INC. "),
    16: ("Central Point Software, Inc.",), 17: (" Chips & Technologies",), 18: (" Rom Bios Version ",), 19: ("COMPAQ",), 20: ("THIS IS NOT IBM BIOS COPAM",), 21: ("coreboot-", "Jumping to LinuxBIOS."),
    22: ("Datatech Enterprises", "DATATECH ENTERPRISES", "DTK Corp.", "GoldStar Co.,Ltd.", "GOLDSTAR  SYSTEM  SETUP"), 23: ("General Software",), 24: ("COPYRIGHT", "CCOOPPYYRRIIGGHHTT"),
    25: ("COPR. IBM", "COPYRIGHT IBM CORPORATION", "CCOOPPRR", "CCOOPPYYRRIIGGHHTT"), 26: ("OKICL1", " BIOS #"), 29: ("Juko Electronics",), 31: ("MYLEX ",), 32: (V.OLIVETTI[0],), 33: ("Philips ROM BIOS Version",),
    34: ("PROMAG SYSTEM BOARD",), 35: ("Schneider R",), 36: ("SystemSoft", "Insyde Software"), 37: ("IBM 1984 BIOS VERSION",), 38: ("tinyBIOS V",), 39: ("$PREPOST",), 40: ("(C)ZDS CORP",),
}
#: The signatures by which firmware of these vendors is known, in their order of precedence.
RULES = (
    Rule(2, "Award", find=V.award_power),
    Rule(3, "Award", "Toshiba", needs=TOSHIBA[:1], string=lambda t: F.right(F.concat(F.regexp_extract(t, TOSHIBA[1], 1), F.regexp_extract(t, TOSHIBA[1], 2)), F.lit(16))),
    Rule(4, "Award", find=V.award),
    Rule(5, "Quadtel", quadtel_version, needs=(r" Quadtel Corp\. Version ", QUADTEL), string=lambda t: newest_date(t, r"([0-9]{2}/[0-9]{2}/[0-9]{2})[^0-9]"), signon=lambda t: F.trim(quadtel(0x190, 0x100)(t))),
    Rule(6, "Phoenix", find=phoenix),
    Rule(7, "AMI", find=V.ami_uefi),
    Rule(8, "AMI", find=V.ami),
    Rule(9, "Intel", find=V.ami_intel),
    Rule(10, "MR", lambda t: F.coalesce(found(t, MR[0], 1), found(t, MR[1], 1)), string=lambda t: F.when(t.rlike(MR[0]), found(t, MR[0], 2)).otherwise(found(t, MR[1], 2)), signon=lambda t: F.trim(found(t, MR[2], 1)), least_size=2048),
    Rule(11, "Acer", find=V.acer),
    Rule(12, "Acer", "Multitech", needs=(r"(?d)Multitech Industrial Corp\..BIOS ([^\s]+ [^\s\x00]+)",), string=(r"(?d)Multitech Industrial Corp\..BIOS ([^\s]+ [^\s\x00]+)", 1)),
    Rule(13, "AMPRO", (r"(?d)AMPRO (.+) Rom-Bios[^\n]+\nVersion ([^ ]+)", 2), signon=(r"(?d)AMPRO (.+) Rom-Bios[^\n]+\nVersion ([^ ]+)", 1)),
    Rule(14, "Amstrad", "?", needs=(r"A(?:MSTRAD|mstrad(?: Consumer Electronics)?) plc", r"IBMUS NON CARBORUNDUM|fit new batteries|Veuillez mettre des piles neuves|Batterie da sostituire|ponga piles nuevas|neue Batterien einsetzen"), string=newest_entry_date),
    Rule(15, "CDI", lambda t: F.when(t.rlike(r"NCR'S VERSION IBM(?: CORP\.)? [AX]T ROM"), "NCR").when(t.contains(" COMPUTER DEVICES INC. "), ""), string=newest_entry_date),
    Rule(16, "CPS", (r"(?s)BIOS [Vv]([\x21-\x7E]+). Copyright [\x21-\x7E]+ +Central Point Software, Inc\.", 1), prefix="v"),
    Rule(17, "C&T", "?", needs=(r" Chips & Technologies", r"\x0D\x0A\x00((?:[\x01-\xFF]+ )?BIOS Version [\x01-\xFF]+)"), signon=(r"\x0D\x0A\x00((?:[\x01-\xFF]+ )?BIOS Version [\x01-\xFF]+)", 1)),
    Rule(18, "Commodore", (r"Commodore [\x20-\x7E]+ Rom Bios Version ([\x20-\x7E]+)[\x0D\x0A\x20-\x7E]*", 1), signon=lambda t: F.substring_index(F.regexp_extract(t, r"\xDA\xC4+\xBF[\x01-\xFF]+", 0), "\r\n\r\n", 1)),
    Rule(19, "Compaq", "?", also=lambda t: (t.rlike(COMPAQ[0]) & t.rlike(COMPAQ[1])) | t.rlike(COMPAQ[2]), string=newest_entry_date),
    Rule(20, "Copam", "?", needs=(r"THIS IS NOT IBM BIOS COPAM\(C\) [0-9]{4}",), string=newest_entry_date),
    Rule(21, coreboot(0), coreboot(1), needs=(r"coreboot-%s%s |Sage_coreboot-|Jumping to LinuxBIOS\.",), metadata=(("ID", coreboot_id), ("Build", lambda t: F.when(t.rlike(COREBOOT_NEW), found(t, COREBOOT_BUILD))))),
    Rule(22, "DTK", (DTK, 1), needs=(r"Datatech Enterprises Co\., Ltd\.|DATATECH ENTERPRISES CO\., LTD\.|\x0ADTK Corp\.|\(C\) Copyright by GoldStar Co\.,Ltd\.|GOLDSTAR  SYSTEM  SETUP",), metadata=(("ID", (DTK, 0)),)),
    Rule(23, "General", lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(t, GENERAL[0], 1), r"\(R\)|\(tm\)", ""), " BIOS ", " ")), needs=GENERAL, string=lambda t: F.concat_ws("\n", F.regexp_extract(t, GENERAL[1], 2), F.regexp_extract(t, GENERAL[1], 1))),
    Rule(24, "IBM", surepath, needs=(IBM_RIGHTS,), string=lambda t: F.nullif(F.concat_ws("\n", F.nullif(F.regexp_extract(t, SUREPATH_ID, 1), F.lit("")), newest_entry_date(t)), F.lit("")), signon=surepath_signon),
    Rule(25, "IBM", lambda t: F.when(part_numbers(t).isNotNull(), F.when(t.rlike(IBM_LONG), "PS/2 or PS/1").otherwise("PC series")), string=part_numbers),
    Rule(26, "ICL", lambda t: F.when(t.startswith("OKICL1\x01\x00"), "").otherwise(F.nullif(F.regexp_extract(t, ICL, 2), F.lit(""))), string=(ICL, 1), signon=(ICL, 3)),
    Rule(27, "Insyde", "?", needs=(r"InsydeH2O Version ",), header=V.UEFI_HEADER),
    Rule(28, "Intel", "UEFI", also=lambda t: t.rlike("|".join(INTEL_CODE)), header=V.UEFI_HEADER, signon=lambda t: F.coalesce(F.nullif(F.regexp_extract(t, INTEL_CODE[0], 1), F.lit("")), F.regexp_extract(t, INTEL_CODE[1], 1))),
    Rule(29, "Juko", (r"(?d)Juko (.+) BIOS ver (.+)", 2), needs=(r"Juko Electronics Industrial Co\.,Ltd\.",), string=(r"(?d)Juko (.+) BIOS ver (.+)", 1)),
    Rule(31, "Mylex", (r"MYLEX [\x20-\x7E]+ BIOS Version ([\x20-\x7E]+) ([0-9]{2}/[0-9]{2}/[0-9]{2})", 1), string=(r"MYLEX [\x20-\x7E]+ BIOS Version ([\x20-\x7E]+) ([0-9]{2}/[0-9]{2}/[0-9]{2})", 2)),
    Rule(32, "Olivetti", find=V.olivetti),
    Rule(33, "Philips", (r"\x0DPhilips ROM BIOS Version ([\x21-\x7E]+) ", 1)),
    Rule(34, "Promag", (r"\(C\) PROMAG SYSTEM BOARD VER\. ([^ ]+) [^\n]+\n([\r\n\x20-\x7E]+)", 1), signon=(r"\(C\) PROMAG SYSTEM BOARD VER\. ([^ ]+) [^\n]+\n([\r\n\x20-\x7E]+)", 2)),
    Rule(35, "Schneider", (r"EURO PC\s+BIOS (V[\x20-\x7E]+)", 1), needs=(r"Schneider (?:Rundfunkwerke|Rdf\.) AG",)),
    Rule(36, "SystemSoft", find=V.systemsoft),
    Rule(37, "Tandon", (r"NOT COPR. IBM 1984 BIOS VERSION ([\x20-\x7E]+)", 1)),
    Rule(38, "tinyBIOS", (r"(?<!\")tinyBIOS (V(?:[^\s]+))", 1), needs=(r" PC Engines",), signon=(r"([\x0A-\x7E]{1,256})[\x00\x0A\x0D]*tinyBIOS V", 1)),
    Rule(39, "Whizpro", text_at(lambda n: F.lit(0x0B), 8), needs=(r"\$PREPOST", r"\$BOOTBLK"), string=text_at(lambda n: F.shiftright(n, 2) + 0x30, 0x20), signon=text_at(lambda n: F.shiftright(n, 2) + 0x110, 0x20)),
    Rule(40, "Zenith", (r"([0-9]{2}/[0-9]{2}/[0-9]{2}) \(C\)ZDS CORP", 1), signon=(r"(?<![\x20-\x7E])[\x20-\x7E]+ Monitor, Version [\x20-\x7E]+", 0)),
)
RULES = tuple(replace(r, marks=MARKS.get(r.priority, ())) for r in RULES)
#: The beginnings of files that are of no use here.
DISCARD = (
    r"(?s)^(?:\x0A[\x00-\x05][\x00-\x01][\x01\x02\x04\x08]|BM|\xFF\xD8\xFF|GIF8|\x89PNG|%PDF|\xD0\xCF\x11\xE0\xA1\xB1\x1A\xE1|\x3F\x5F\x03\x00|"
    r"<(?:![Dd][Oo][Cc][Tt][Yy][Pp][Ee]|[Hh][Tt][Mm][Ll])[ >]|\x7FELF(?!.{124}ELFBoot\x00)|CPU-Z TXT Report|\s{7}File:   A|-+\[ AIDA32 |"
    r"HWiNFO64 Version |3DMARK2001 PROJECT|Report Dr. Hardware|\r\n(?:\s+HWiNFO v|\r\n\s+\r\n\s+Microsoft Diagnostics version )|"
    r"SIV[^\s]+ - System Information Viewer V|UID,Name,Score,)"
)
HEAD_BYTES = 32_782
#: What files of no use begin with that may need more than SHORT_BYTES to be told; the others' marks, and those of containers, end before.
DISCARD_LONGER, SHORT_BYTES = (b"\r\n", b"SIV", b"-"), 288


def as_latin1(data: Column) -> Column:
    """Bytes as a text of one character each."""
    return F.decode(data, "ISO-8859-1")


def is_discarded(head: Column) -> Column:
    return head.rlike(DISCARD)


def begins(content: Column, pattern: str, longer: tuple[bytes, ...]) -> Column:
    """Whether an artifact's head matches a pattern from its start on, told by the first SHORT_BYTES, as a text of the whole head is costly
    to make; the whole is looked at only where it starts with what a longer match does."""
    found = lambda n: as_latin1(F.substring(content, 1, n)).rlike(pattern)
    return found(SHORT_BYTES) | (reduce(lambda a, x: a | F.startswith(content, F.lit(x)), longer, F.lit(False)) & found(HEAD_BYTES))


def _finding(rule: Rule, text: Column, header: Column | None) -> Column:
    """The rule's finding, or null where it does not hold or has no version. What is quick to see comes first: the header, then plain texts."""
    made = _made(rule, text, header)
    if rule.marks:
        made = F.when(reduce(lambda a, m: a | text.contains(m), rule.marks[1:], text.contains(rule.marks[0])), made)
    if rule.header:
        made = F.lit(None) if header is None else F.when(header == F.encode(F.lit(rule.header), "ISO-8859-1"), made)
    return made


def _made(rule: Rule, text: Column, header: Column | None) -> Column:

    def take(what: Take | None) -> Column:
        if what is None:
            return F.lit(None).cast("string")
        if isinstance(what, str):
            return F.lit("" if what == "?" else what)
        return found(text, *what) if isinstance(what, tuple) else what(text)

    if rule.find:
        def ranked(done: Column) -> Column:
            version = F.when(done["version"] == "?", "").otherwise(done["version"])
            rest = [done[c].alias(c) for c in ("string", "signon", "metadata")]
            return F.when(done.isNotNull(), F.struct(F.lit(rule.priority).alias("priority"), done["vendor"].alias("vendor"), version.alias("version"), *rest))

        return bind(rule.find(text, header), ranked)
    version = take(rule.version)
    if rule.prefix:
        version = F.concat(F.lit(rule.prefix), version)
    holds = all_match(text, rule.needs) & (F.length(text) >= rule.least_size) & version.isNotNull()
    if rule.also:
        holds &= rule.also(text)
    vendor = F.lit(rule.vendor) if isinstance(rule.vendor, str) else rule.vendor(text)
    return F.when(
        holds,
        F.struct(
            F.lit(rule.priority).alias("priority"), vendor.alias("vendor"), version.alias("version"),
            take(rule.string).alias("string"), F.replace(take(rule.signon), F.lit("\r"), F.lit("")).alias("signon"),
            F.filter(F.array(*[V.entry(k, take(w)) for k, w in rule.metadata]).cast("array<string>"), lambda m: m.isNotNull()).alias("metadata"),
        ),
    )


def classify(df: DataFrame, text: Column, rules: Sequence[Rule] = RULES, header: Column | None = None) -> DataFrame:
    """``df`` with ``finding``: the winning rule's priority, vendor, version, string, sign-on and metadata; null where none holds.

    Rules are tried in order of priority and later ones are not evaluated for an artifact once one wins. An unknown
    version, ``?``, wins like any other and is blank in the result.
    """
    ordered = sorted(rules, key=lambda r: r.priority)
    # A generator, so that the text is decoded and the chain walked once a row however often the finding is used.
    return df.withColumn("finding", F.explode(F.transform(F.array(text), lambda t: F.coalesce(*[_finding(r, t, header) for r in ordered]))))
