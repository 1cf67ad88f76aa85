"""Findings of vendors whose identification takes more than a pattern: blocks at fixed distances, decoded texts, lines in order.

Each function takes an artifact's bytes as Latin-1 text and gives a struct (vendor, version, string, signon, metadata),
null where the vendor's signs or version are missing. All are built-in column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import at_offset, bind, filled, fold_lines, found, place, places_of, pivot_date, printable_runs, read_string, tidy_lines

UEFI_HEADER = "\x00\xFFUEFIExtract\xFF\x00"


def entry(key: str, value: Column) -> Column:
    """A metadata line, further lines indented below the first; null for no value."""
    return F.rtrim(F.concat(F.lit(f"[{key}] "), F.replace(value, F.lit("\n"), F.lit("\n" + " " * (len(key) + 3)))))


def finding(vendor: Column | str, version: Column, string: Column | None = None, signon: Column | None = None, *metadata: Column) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else filled(c)
    lines = F.filter(F.array(*metadata), lambda m: m.isNotNull()) if metadata else F.array().cast("array<string>")
    vendor = F.lit(vendor) if isinstance(vendor, str) else vendor
    done = lambda version: F.struct(vendor.alias("vendor"), version.alias("version"), text(string).alias("string"), text(signon).alias("signon"), lines.alias("metadata"))
    return bind(version, lambda v: F.when(v.isNotNull(), done(v)))


#: The patterns, places and names by which firmware of these vendors is known. A look-behind before a run of
#: printable text starts each run once; the match is the same.
ACER = (
    r"Copyright \(C\) Acer Incorporated 1990|Acer Boot Block v1\.0",
    r"(?:ACER|\x00{4})\x00(V[0-9\.]+)\x00\x00|(V[0-9\.]+)[\x00 ][0-9]{2}/[0-9]{2}/[0-9]{2,4}\x00|(?<![\x20-\x7E])[\x20-\x7E]*ACER BIOS (V[\x20-\x7E]+)\x00{2}",
    r"(?:([\x20-\x7E]{4,})\x00)?([A-Z]{3}[0-9A-F]{2}[A-Z0-9]{2,3}-[A-Z0-9]{3}-[0-9]{6}-[\x21-\x7E]+)(?: +([\x20-\x7E]+))?",
    r"(?<![\x20-\x7E])((?:[\x20-\x7E]{4,}\x00)+)([\x20-\x7E]{8})\x00\x00?\.([\x20-\x7E]{5})\x00",
)
AMI = r"American Megatrends Inc|AMIBIOSC| Access Methods Inc\.|AMI- ([0-9]{2}/[0-9]{2}/[0-9]{2}) (?:IBM is a TM of IBM|[\x00-\xFF]{2}   AMI-[^-]+-BIOS )"
AMI_DATE = r"([0-9\xB0-\xB9]{2}/[0-9\xB0-\xB9]{2}/[0-9\xB0-\xB9]{2})[^0-9]"
AMI_CSM = r"^63-0100-000001-00101111-[0-9]{6}-Chipset-0AAAA000$"
AMI_BLOCK = (
    r"(?:AMIBIOS (?:(0[1-9][0-9]{2}[\x00-\xFF]{2})[\x00-\xFF]{2}|W ([0-9]{2}) ([0-9]{2})[\x00-\xFF]|[0-9]\.[0-9]\x00[A-Z]\x00{3})|0123AAAAMMMMIIII|\(AAMMIIBBIIOOSS\))"
    r"(?:([\x00-\xFF]{2}/[0-9]{2}/[0-9]{2})\(C\)[0-9]{4} American Megatrends,? Inc(?:\.,?[^\n]All[^\n]Rights[^\n]Reserved|/Hewlett-Packard Company)|[0-9]\$RAIDUAC[0-9])"
)
AMI_TABLE = r"\$\$CT[\x01\x02]([\x20-\x7E]+)"
AMI_TABLE_TRIM = r"(?i)[- ]+(?:Table|B(?:oot[- ]?)?Block|BtBlk|POST(?: Init)?|Cfg|Config|Port)"
AMI_OLD_BLOCK = r"\(C\)(?:[0-9]{4}(?:AMI,404-263-8181|TGem-HCS,PSC,JGS|TriGem Computer )|( Access Methods Inc\.))"
AMI_OLD = (
    r"(?:(?: Date:- ?|AMI- )[0-9]{2}/[0-9]{2}/[0-9]{2}|DDaattee(?:::|  )--(?:  )?([0-9])\1([0-9])\2//([0-9])\3([0-9])\4//([0-9])\5([0-9])\6|\xFF{4}FLASH-[0-9]{6})|"
    r"\xFE\xD5\x4D\xF5\x9D\x55\xF5\x5D\xB5\x85\x8D\xFE\xE5\x85\x7D\x35\x9E\xFE\x8D\x85\x5D\xFE\xCD\x85\x6D\xFE\x65\xF5\x9D\xD5"
)
AMI_OLD_DATE = r"\xAA\x55[\x00-\xFF]{1,16}([0-9]{2}/[0-9]{2}/[0-9]{2})|\xFF{4}FLASH-([0-9]{2})([0-9]{2})([0-9]{2})"
AMI_OLD_STRING = r"\xFE(?:[\x00-\x95\x97-\xFD\xFF]{4}\x96(?:[\x00-\x95\x97-\xFF]{4}\x96)?[\x00-\x95\x97-\xFF]{6}|\x6D\xD4\xCC\x8E\xFE[\x00-\xFF]{1,64})"
AMI_OLD_SIGNON = r"(?d)(?<![0-9A-Za-z- ])([0-9A-Za-z- ]*BIOS \(C\).*(?:AMI|American Megatrends Inc\.?))(?:, for ([\x0D\x0A\x20-\x7E]+))?"
AMI_OLD_SETUP = r"[A-Za-z][0-9/]+([\x20-\x27\x29-\x7E]*(SETUP PROGRAM FOR | SETUP UTILITY)[\x20-\x27\x29-\x7E]*)\(C\)19"
AMI_PC_CHIPS = r"ADVANCED SYSTEM SETUP UTILITY VERSION[\x20-\x7E]+?PC CHIPS INC"
AMI_8088_STRING = r"\xEC\x5F\x6C\x60\x5A\x5C\xEA\xF0\xEC([\x00-\x6B\x6D-\xFF]{11,64})\x6C"
AMI_SETUPS = (
    ("Color", "Improper Use of Setup may Cause Problems !!"),
    ("Easy", "AMIBIOS EASY SETUP UTILIT"),
    ("HiFlex", "\\HAMIBIOS HIFLEX SETUP UTILIT"),
    ("Intel", "Advanced Chipset Configuration  \\QPress"),
    ("New", "AMIBIOS NEW SETUP UTILIT"),
    ("Simple", "\\HAMIBIOS SIMPLE SETUP UTILIT"),
    ("WinBIOS", " Wait----"),
)
INTEL_VERSION = r"(?:BIOS (?:Release|Version) )?([0-9]\.[0-9]{2}\.[0-9]{2}\.[A-Z][0-9A-Z]{1,})|(?:\$IBIOSI\$)?([0-9A-Z]{8}\.([0-9A-Z]{3})\.[0-9A-Z]{3,4}(?:\.[0-9A-Z]{1,4}\.[0-9]{10}|(?:\.[0-9]{4}){3}))"
INTEL_86 = r"^[0-9A-Z]{8}\.86[0-9A-Z]\.[0-9A-Z]{3,4}\.[0-9A-Z]{1,4}\.[0-9]{10}$"
INTEL_PREFIX = r"^(?:BIOS (?:Release|Version) |\$IBIOSI\$)"
AMI_UEFI = r"\$SGN\$|ALASKAA M I|[Xx]-UEFI-AMI|AMITSESetup"
AMI_UEFI_SIGNON = r"\$(?:(?:IBIOSI|MSESGN)\$|UBI)([\x20-\x7E]{4,})"
AWARD = r"(?:Award|A w a r d) Software Inc\.|AAwwaarrdd SSooffttwwaarree IInncc\.\.|COPYRIGHT AWARD SOFTWARE INC\.|Award Decompression Bios"
AWARD_IGNORE = r"search=f000,0,ffff,S,\"|VGA BIOS Version (?:[^\r]+)\r\n(?:Copyright \(c\) (?:[^\r]+)\r\n)?Copyright \(c\) (?:NCR \& )?Award"
AWARD_AST = r"\(c\) COPYRIGHT 1984,[0-9]{4}(?:A w a r d|Award) Software Inc\.|IBM COMPATIBLE A(S)T BIOS"
AWARD_EARLY = r"([0-9A-Z][\x21-\x7E]+) BIOS V([0-9.]+)[\x21-\x7E]* COPYRIGHT"
AWARD_BIF = r"(?s)\$BIF.{5}([\x20-\x7E]+)\x00[^\n]([\x20-\x7E]+)\x00"
AWARD_EVAL = r"^\([a-zA-Z0-9]{1,8}\) EVALUATION ROM - NOT FOR SALE$"
AWARD_MEDALLION = r"Award [\x20-\x7E]+\x00Copyright \(C\) 1984-[0-9]{2,4}, Award Software, Inc\.\x00"
AWARD_NEW_DATE = r"N((?:[0-9]{2})/(?:[0-9]{2})/)([0-9]{2})([0-9]{2})(\1\3)"
AWARD_STRING_DATE = r"^(?:[0-9]{2})/(?:[0-9]{2})/([0-9]{2,4})-"
AWARD_VERSION = r" (?:v([^-\s]+)|V(?:ersion )?[^0-9]*([0-9]\.[0-9][0-9A-Z]?))(?:[. ]([\x20-\x7E]+))?"
AWARD_NET = ("CPLRESELLERID", "BINCPUTBL", "BINIDETBL")
AWARD_MAKERS, AWARD_TURN = ("Award Software Inc. ", "Phoenix Technologies, Ltd "), 6
POWER = (r"PowerBIOS Setup", r"IBM COMPATIBLE BIOS COPYRIGHT AWARD SOFTWARE INC\.", r"[\x01-\xFF]+\x00", r"Version ([\x21-\x7E]+)", r"- [\x20-\x7E]+\x0D\x0A\x00")
#: How far in front of its mark the sign-on stands.
POWER_SIGNON = 0xE00E
ENTRY_DATE = r"(?s)(?:\xEA..\x00\xF0|\xE9..)((?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/[0-9]{2})"
OLIVETTI = ("COPYRIGHT (C)   OLIVETTI", r"No ROM BASIC available - RESET|ROM BASIC Not Available,", r"^(?:COPYRIGHT \(C\) OLIVETTI )?([0-9]{2}/[0-9]{2}/[0-9]{2})$", r"^Version ([^\s]+)")
SYSTEMSOFT = (
    r"(?:SystemSoft|Insyde Software(?: Presto)?) BIOS |SystemSoft SCU\. Copr 1983-",
    r"(?:(?<![\x20-\x7E])[\x20-\x7E]+ BIOS [Ff]or [\x20-\x7E]+|SystemSoft [\x20-\x7E]+ BIOS) (?:Vers(?:\.|ion) 0?([^ \x0D\x0A]+)(?: ([\x20-\x7E]+))?| *\(c\))",
    r"(Insyde Software Presto|SystemSoft MobilePRO) BIOS Version ([^ \x0D\x0A]+)(?: ([\x20-\x7E]+))?",
    r"(?<![\x20-\x7E])([\x20-\x7E]+ SCU [Ff]or [\x20-\x7E]+ [Cc]hipset)",
    r"(?<![\x20-\x7E])([\x20-\x7E]+ BIOS [Ff]or [\x20-\x27\x29-\x7E]+)\(",
    r"(?:\x0D\x0A){1,}\x00\x08\x00([\x20-\x7E]+)",
)


def turned(text: str, size: int) -> list[str]:
    """All stretches of ``size`` characters of a text written in a circle."""
    return [(text + text)[k : k + size] for k in range(len(text))]


AWARD_BLOCK = "(?:" + "|".join(rf"\Q{x}\E" for m in AWARD_MAKERS for x in turned(m, AWARD_TURN)) + (
    r")[\x00-\xFF]{8}IBM COMPATIBLE|[0-9]{2}/[0-9]{2}/[0-9]{4} {4}IBM COMPATIBLE (?:[0-9]+ )?BIOS COPYRIGHT Award Software Inc\.|"
    r"IBM COMPATIBLE (?:[0-9]+ )?BIOS COPYRIGHT Award Software Inc\."
)


def acer(t: Column, header: Column | None = None) -> Column:
    numbered, named = found(t, ACER[1], 0), found(t, ACER[1], 3)
    version = F.coalesce(found(t, ACER[1], 1), found(t, ACER[1], 2), named)
    new, old = found(t, ACER[2], 2), found(t, ACER[3], 3)
    ids = F.regexp_replace(F.replace(found(t, ACER[3], 1), F.lit(" \0"), F.lit("\n")), "\x00", "\n")
    return F.when(
        t.rlike(ACER[0]),
        finding(
            "Acer", version, F.coalesce(new, old), F.when(new.isNotNull(), F.trim(found(t, ACER[2], 3))).otherwise(found(t, ACER[3], 2)),
            F.when(named.isNotNull(), entry("ID", F.rtrim(F.regexp_replace(numbered, r"\x00+$", "")))),
            F.when(new.isNotNull(), entry("ID", found(t, ACER[2], 1))).when(old.isNotNull(), entry("ID", F.regexp_replace(ids, r"\n+$", ""))),
        ),
    )


def codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def spelled(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda c: F.char(c.bitwiseAND(127))), "")


def hidden_string(text: Column) -> Column:
    """The text that complements, turned left by five bits, spell from here on; its last letter has the top bit."""
    plain = F.transform(codes(F.substring(text, 1, 256)), lambda c: F.shiftleft(F.lit(255) - c, 5).bitwiseOR(F.shiftright(F.lit(255) - c, 3)).bitwiseAND(255))

    def whole(c: Column) -> Column:
        end = F.array_position(F.transform(c, lambda x: x >= 128), True)
        return spelled(F.when(end > 0, F.slice(c, F.lit(1), end.cast("int"))).otherwise(c))

    return bind(plain, whole)


def intel_mark(t: Column) -> Column:
    """The last fitting Intel version in the data, null without any; a generic one does not replace one of a maker."""
    hits = F.regexp_extract_all(t, F.lit(INTEL_VERSION), F.lit(0))

    def newer(sign: Column, hit: Column) -> Column:
        name = F.regexp_replace(hit, INTEL_PREFIX, "")
        generic = F.regexp_extract(name, r"^[0-9A-Z]{8}\.([0-9A-Z]{2})", 1) == "86"
        return F.when((~generic | ~sign.rlike(INTEL_86)) & ~F.contains(sign, name), name).otherwise(sign)

    return F.nullif(F.aggregate(hits, F.lit(""), newer), F.lit(""))


def intel_header(header: Column | None) -> Column:
    """The version text of an Intel update header, null if there is none."""
    if header is None:
        return F.lit(None).cast("string")
    head = F.decode(header, "ISO-8859-1")
    return F.when((F.substring(head, 91, 5) == "FLASH") & (F.substring(head, 113, 14) != "User Data Area"), read_string(F.substring(head, 113, 1 << 20)))


def core_version(t: Column) -> Column:
    core = found(F.substring(t, place(t, "AMIBIOS"), F.length(t)), r"AMIBIOSC(0[1-9][0-9]{2})", 1)
    return F.concat(core, F.lit("00"))


def ami_intel(t: Column, header: Column | None = None) -> Column:
    sign, core = intel_header(header), F.when(t.contains("AMIBIOS"), core_version(t))
    vendor = F.when(core.isNotNull(), "AMI").when(~t.contains("AMIBIOS") & t.rlike(r"PhoenixBIOS(?:\(TM\))? "), "Phoenix").otherwise("Intel")
    return F.when(sign.isNotNull(), finding(vendor, F.coalesce(core, F.lit("?")), None, sign))


def ami_tables(t: Column) -> Column:
    """The names of register tables, shortened, distinct and in order."""
    names = F.transform(F.regexp_extract_all(t, F.lit(AMI_TABLE), F.lit(1)), lambda n: F.trim(F.regexp_replace(n, AMI_TABLE_TRIM, "")))
    names = F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(n, r"(^| )([A-Za-z]+)(Time)($| )", "$1$2 $3$4"), r"(^| )W(?:in|IN)([0-9]{3})", "$1Winbond $2"))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(names)), "\n"), F.lit(""))


def ami_block(t: Column, intel: Column, then: Callable[..., Column]) -> Column:
    """``then(version, string, at)`` of the identification block; null without one."""
    hit, at = F.regexp_extract(t, AMI_BLOCK, 0), place(t, AMI_BLOCK)
    group = lambda h, k: found(h, AMI_BLOCK, k)
    six = lambda h: bind(group(h, 1), lambda g: F.when(g.rlike("[0-9]$"), g).otherwise(F.concat(F.substring(g, 1, 4), F.lit("00"))))
    version = lambda h: F.coalesce(six(h), F.concat(group(h, 2), group(h, 3), F.lit("00")), group(h, 4))
    tagged = lambda at, x: bind(read_string(at_offset(t, at, 0xEC, 0x14)), lambda g: F.when(g.startswith("_TG_"), F.concat(F.rtrim(x), F.lit("-"), F.ltrim(F.substring(g, 5, 64)))).otherwise(x))
    whole = lambda at: bind(read_string(at_offset(t, at, 0x78, 0x28)), lambda x: tagged(at, x))
    return F.when(hit != "", bind(F.struct(version(hit).alias("v"), at.alias("at")), lambda b: bind(whole(b["at"]), lambda x: then(b["v"], x, b["at"]))))


def ami_color(t: Column, intel: Column) -> Column:
    """From the identification block of 1990 and later."""

    def block(version: Column, string: Column, at: Column) -> Column:
        long = at_offset(t, at, 0x123, 8) == " Inc.,\0 "
        sign = bind(at_offset(t, at, 0x100, 0x100), lambda x: F.when(long, F.substring_index(x, "\0\0", 1)).otherwise(read_string(x)))
        sign = F.concat(F.coalesce(F.concat(intel, F.lit("\n")), F.lit("")), sign)
        lines = F.transform(F.split(F.replace(sign, F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.trim(x))
        rights = lambda x: F.coalesce(F.get(F.filter(x, lambda y: y.contains("American Megatrends")), F.lit(0)), F.get(x, F.lit(0)))

        def rest(x: Column) -> Column:
            first = F.array_position(x, rights(x))
            return F.array_join(F.filter(x, lambda y, k: (y != "") & (k + 1 != first)), "\n")

        setups = F.array_join(F.filter(F.array(*[F.when(t.contains(mark), F.lit(name)) for name, mark in AMI_SETUPS]), lambda x: x.isNotNull()), ", ")
        done = bind(lines, lambda x: finding(
            "AMI", version, string, rest(x), entry("ID", F.nullif(rights(x), F.lit(""))), F.when(F.regexp_extract(t, AMI_BLOCK, 2) != "", entry("Setup", F.lit("WinBIOS"))),
            entry("Setup", F.nullif(setups, F.lit(""))), entry("Table", ami_tables(t)),
        ))
        return F.when(~string.rlike(AMI_CSM), done)

    return ami_block(t, intel, block)


def ami_old(t: Column, intel: Column) -> Column:
    """From the date and the encoded string of images before the identification block."""
    dated = F.translate(found(t, AMI_DATE, 1), "".join(map(chr, range(0xB0, 0xBA))), "0123456789")
    flash = F.concat_ws("/", *[found(t, AMI_OLD_DATE, k) for k in (2, 3, 4)])
    version = F.when(~t.rlike(AMI_OLD_DATE), dated).otherwise(F.coalesce(found(t, AMI_OLD_DATE, 1), flash))
    early, after = found(t, AMI, 1), F.substring(t, F.greatest(place(t, AMI_OLD_DATE), F.lit(1)), F.length(t))

    def own(x: Column) -> Column:
        plain = lambda h: F.when(h.contains("Intel Corporation") | (F.length(h) <= 8), "").otherwise(F.regexp_replace(h, "-?K$", ""))
        return bind(hidden_string(F.substring(x, place(x, AMI_OLD_STRING) + 1, F.lit(256))), plain)

    def rebuilt(block: Column) -> Column:
        day = F.trim(F.replace(read_string(at_offset(t, block, 0x9C, 8)), F.lit("/"), F.lit("")))
        made = F.concat(F.lit("????-"), F.upper(F.hex(F.encode(at_offset(t, block, -0xBB, 2), "ISO-8859-1"))), F.lit("-"), day)
        return bind(made, lambda x: F.when(x.rlike(r"^\?{4}-(0000|0166)-"), "").otherwise(x))

    def done(e: Column, block: Column) -> Column:
        turn = lambda c: F.shiftleft(F.pmod(-c, F.lit(256)), 1).bitwiseOR(F.shiftright(F.pmod(-c, F.lit(256)), 7))
        first = F.when(t.rlike(AMI_8088_STRING), spelled(F.transform(codes(F.regexp_extract(t, AMI_8088_STRING, 1)), turn))).otherwise(F.concat(F.lit("????-"), F.replace(e, F.lit("/"), F.lit(""))))
        string = F.when(block > 0, bind(after, lambda x: F.when(x.rlike(AMI_OLD_STRING), own(x)).otherwise(rebuilt(block)))).when(e.isNotNull(), first)
        named = F.regexp_extract(F.regexp_extract(t, AMI_OLD_SIGNON, 1), r"^[^\x00\x0D\x0A\x80-\xFF]*", 0)
        setup = F.replace(found(t, AMI_OLD_SETUP, 1), found(t, AMI_OLD_SETUP, 2), F.lit(""))
        sign = F.when(t.rlike(AMI_OLD_SIGNON), F.regexp_replace(read_string(F.regexp_extract(t, AMI_OLD_SIGNON, 2)), r"\n{2,}", "\n")).otherwise(intel)
        when = F.when((block == 0) & e.isNotNull(), e).otherwise(version)
        return finding("AMI", when, string, sign, entry("ID", filled(named)), entry("Setup", F.coalesce(setup, F.when(t.rlike(AMI_PC_CHIPS), "PC Chips"))))

    return bind(early, lambda e: bind(place(t, AMI_OLD_BLOCK), lambda block: done(e, block)))


def ami(t: Column, header: Column | None = None) -> Column:
    def by_age(intel: Column) -> Column:
        bare = finding("AMI", F.when(t.contains("AMIBIOS"), core_version(t)), None, intel)
        old = F.when(F.length(t) >= 1024, F.when(t.rlike(AMI_OLD), ami_old(t, intel)).when(intel.isNotNull(), bare))
        return F.when(t.rlike(AMI_BLOCK), ami_color(t, intel)).otherwise(old)

    return F.when(t.rlike(AMI), bind(F.coalesce(intel_header(header), intel_mark(t)), by_age))


def ami_uefi(t: Column, header: Column | None = None) -> Column:
    if header is None:
        return finding("AMI", F.lit(None).cast("string"))
    revision = F.instr(t, " ACPI BIOS Rev")
    before = F.substring(t, F.greatest(revision - 256, F.lit(1)), F.least(revision - 1, F.lit(256)))
    revised = F.when((revision > 0) & F.contains(before, F.lit("\0")), read_string(F.substring(F.concat(F.substring_index(before, "\0", -1), F.substring(t, revision, F.lit(256))), 1, 256)))
    signed = F.substring(t, place(t, r"(?s)\$SGN\$[\x01-\xFF]..") + 8, F.lit(512))
    second = F.replace(F.substring_index(F.substring_index(signed, "\0", 2), "\0", -1), F.lit("\r"), F.lit(""))
    sign = F.coalesce(found(t, AMI_UEFI_SIGNON, 1), revised, F.when(t.rlike(r"(?s)\$SGN\$[\x01-\xFF].."), second))
    here = F.coalesce(header == F.encode(F.lit(UEFI_HEADER), "ISO-8859-1"), F.lit(False)) & t.rlike(AMI_UEFI)
    string = F.when(t.rlike(AMI), ami_block(t, sign, lambda version, string, at: string))
    return F.when(here, finding("AMI", F.lit("UEFI"), string, sign))


def award(t: Column, header: Column | None = None) -> Column:
    medallion = found(t, AWARD_MEDALLION, 0)

    def block(at: Column) -> Column:
        """(version, string, signon, metadata) of the block at a place; null if its string is a bare remainder."""
        own = F.substring_index(read_string(at_offset(t, at, 0x61, 0x60)), "\r", 1)
        name = F.when(medallion.isNotNull(), read_string(medallion)).otherwise(own)
        number = lambda n: F.coalesce(found(n, AWARD_VERSION, 1), found(n, AWARD_VERSION, 2))
        return bind(name, lambda n: bind(number(n), lambda v: numbered(at, n, v)))

    def numbered(at: Column, name: Column, number: Column) -> Column:
        bare, packard = name == "Award Modular BIOS Version ", name.startswith("Award Modular BIOS/")
        giga = number.isNull() & ~bare & ~packard & t.contains("GIGABYTEFLAG\0")
        version = F.when(number.isNotNull(), F.concat(F.lit("v"), number)).when(bare, "Intel").when(packard, "Packard Bell").when(giga, "?")
        far = read_string(at_offset(t, at, 0x71A, 0x100))
        sign = bind(read_string(at_offset(t, at, 0xC1, 0x4E)), lambda x: F.when(x.contains(" BUSINESS MACHINES CORP."), far).otherwise(x))
        sign = F.concat(F.when(number.isNull() & packard, F.concat(F.substring(name, 20, 96), F.lit("\n"))).otherwise(""), sign)
        real = F.concat(F.regexp_extract(t, AWARD_BIF, 1), F.lit(" "), F.regexp_extract(t, AWARD_BIF, 2))
        test = lambda x: ((number == "6.00PG") | giga) & x.rlike(AWARD_EVAL) & t.rlike(AWARD_BIF)
        sign = bind(sign, lambda x: F.when(test(x), real).otherwise(x))
        early = F.coalesce(F.substring(number, 1, 2).isin("2.", "3."), F.lit(False))
        net = F.when(~early & t.contains(AWARD_NET[0]) & t.contains(AWARD_NET[1]) & t.contains(AWARD_NET[2]), F.lit("[PhoenixNet]"))
        hybrid = F.when(~early & t.contains("EFI CD/DVD Boot Option"), F.lit("[UEFI] Gigabyte Hybrid EFI"))
        done = lambda string: F.struct(version.alias("version"), string.alias("string"), sign.alias("sign"), F.array(entry("ID", name), hybrid, net).alias("metadata"))
        left = lambda x: F.coalesce((F.length(x) <= 11) & x.endswith("-"), F.lit(False))
        return bind(F.when(~early, dated(at)), lambda x: F.when(~left(x), done(x)))

    def dated(at: Column) -> Column:
        """The string of a block, with the date of a later change where there is one."""
        year = lambda x: F.length(F.regexp_extract(x, AWARD_STRING_DATE, 1))
        new = lambda x: bind(F.when(year(x) == 2, found(t, AWARD_NEW_DATE, 4)).when(year(x) > 0, F.substring(found(t, AWARD_NEW_DATE, 0), 2, 10)), lambda d: F.concat(d, F.substring(x, F.length(d) + 1, F.lit(256))))
        further = read_string(at_offset(t, at, 0xCE0, 0x10))
        return bind(read_string(at_offset(t, at, 0xC71, 0x6F)), lambda x: F.when(x.contains(" Award Software Inc. "), further).otherwise(F.coalesce(new(x), x)))

    blocks = F.filter(F.transform(places_of(t, AWARD_BLOCK), block), lambda b: b.isNotNull())
    ast = F.when(found(t, AWARD_AST, 1).isNotNull(), place(t, r"IBM COMPATIBLE AST BIOS") + 16).otherwise(place(t, AWARD_AST))
    near = bind(read_string(at_offset(t, ast, 0x44, 0x100)), lambda x: F.when(x.startswith("A"), x).otherwise(read_string(at_offset(t, ast, 0x80, 0x100))))
    end = lambda x: F.array_position(F.transform(x, lambda y: y.contains("IBM IS A TRADEMARK OF INTERNATIONAL BUSINESS MACHINES CORP.")), True)
    kept = bind(F.split(near, "\n"), lambda x: bind(end(x), lambda e: F.when(e > 0, F.slice(x, F.lit(1), (e - 1).cast("int"))).otherwise(x)))
    ast_sign = F.array_join(F.filter(kept, lambda x: ~x.startswith("Copyright ") & ~x.startswith("All Rights Reserved")), "\n")
    early_at = place(t, AWARD_EARLY)

    def chosen(b: Column) -> Column:
        first = F.get(b, F.lit(0))
        kept = F.filter(first["metadata"], lambda m: m.isNotNull())
        whole = F.struct(
            F.lit("Award").alias("vendor"), first["version"].alias("version"), filled(first["string"]).alias("string"),
            filled(tidy_lines(first["sign"])).alias("signon"), kept.alias("metadata"),
        )
        other = F.when(t.rlike(AWARD_AST), finding("Award", F.lit("AST"), None, tidy_lines(ast_sign))).when(
            early_at > 0, finding("Award", F.concat(F.lit("v"), F.regexp_extract(t, AWARD_EARLY, 2)), None, tidy_lines(read_string(at_offset(t, early_at, 0x3C, 0x50))))
        )
        return F.when(F.size(b) == 0, other).when(first["version"].isNotNull(), whole)

    return F.when(t.rlike(AWARD) & ~t.rlike(AWARD_IGNORE), bind(blocks, chosen))


def award_power(t: Column, header: Column | None = None) -> Column:
    at = place(t, POWER[1])
    entries = F.filter(F.regexp_extract_all(at_offset(t, at, 0x82, 0x80), F.lit(POWER[2]), F.lit(0)), lambda x: F.length(x) > 2)
    entries = F.transform(entries, lambda x: read_string(x))

    def made(e: Column) -> Column:
        several = F.size(e) > 1
        serial = F.concat_ws(" ", found(t, ENTRY_DATE, 1), F.trim(F.regexp_replace(found(t, POWER[4], 0), r"[\x00\r\n]+$", "")))
        last = bind(F.regexp_replace(F.when(several, F.element_at(e, -1)), "^m", ""), lambda x: F.when((F.trim(x) == "Serial No.") & (serial != ""), serial).otherwise(x))
        names = F.when(several, F.slice(e, F.lit(1), F.size(e) - 1)).otherwise(e)
        name = F.array_join(F.filter(F.transform(names, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != ""), "\n")
        version = F.concat_ws(" ", F.lit("PowerBIOS"), found(name, POWER[3], 1))
        return finding("Award", version, last, read_string(at_offset(t, at, -POWER_SIGNON, 0x100)), F.when(F.size(e) > 0, entry("ID", name)))

    return F.when(t.contains(POWER[0]) & (at > 0), bind(entries, made))


def olivetti(t: Column, header: Column | None = None) -> Column:
    """A date line gives the newest date, and the line after it may give the version; the first that fits a line takes it."""
    start = F.struct(F.lit(False).alias("trap"), F.lit("?").alias("version"), F.lit("").alias("date"))
    later = lambda s, d: F.when((s["date"] == "") | (pivot_date(d) > pivot_date(s["date"])), d).otherwise(s["date"])
    checks = [
        (lambda s, line: s["trap"], lambda s, line: F.struct(F.lit(False).alias("trap"), F.coalesce(found(line, OLIVETTI[3], 1), s["version"]).alias("version"), s["date"].alias("date"))),
        (lambda s, line: line.rlike(OLIVETTI[2]), lambda s, line: F.struct(F.lit(True).alias("trap"), s["version"].alias("version"), later(s, F.regexp_extract(line, OLIVETTI[2], 1)).alias("date"))),
    ]
    done = bind(fold_lines(printable_runs(t), start, checks), lambda s: finding("Olivetti", s["version"], s["date"]))
    return F.when(t.contains(OLIVETTI[0]) & t.rlike(OLIVETTI[1]), done)


def systemsoft(t: Column, header: Column | None = None) -> Column:
    whole, mobile = found(t, SYSTEMSOFT[1], 0), found(t, SYSTEMSOFT[2], 0)
    number = F.coalesce(found(t, SYSTEMSOFT[1], 1), F.lit("?"))
    number = F.when(whole.isNotNull(), F.when(F.length(number) <= 2, "?").otherwise(number))
    maker = F.substring_index(found(t, SYSTEMSOFT[2], 1), " ", -1)
    version = F.coalesce(F.concat(maker, F.lit(" "), found(t, SYSTEMSOFT[2], 2)), number)
    name = F.regexp_replace(F.regexp_replace(whole, "^IBM ", ""), r" \(c\)$", "")
    chip = F.when(whole.isNull(), F.coalesce(found(t, SYSTEMSOFT[3], 1), found(t, SYSTEMSOFT[4], 1)))
    from_here = F.when(mobile.isNotNull(), place(t, SYSTEMSOFT[2]) + F.length(mobile)).otherwise(place(t, SYSTEMSOFT[1]) + F.length(whole))
    lines = F.regexp_extract_all(F.substring(t, from_here, F.length(t)), F.lit(SYSTEMSOFT[5]), F.lit(1))
    sign = F.array_join(F.filter(lines, lambda x: ~(x.startswith("Copyright") & (x.contains("SystemSoft") | x.contains("Insyde")))), "\n")
    return F.when(t.rlike(SYSTEMSOFT[0]), finding("SystemSoft", version, None, sign, entry("ID", name), entry("ID", mobile), entry("ID", chip)))
