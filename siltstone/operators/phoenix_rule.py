"""The rule for a vendor whose newer images hold chained records, and whose older ones are known by their texts alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import bind, filled, found, place, read_string, tidy_lines
from .phoenix import FIRST_WITHIN, HEAD_BYTES, MEMORY, NEXT_WITHIN, RECORD, SEGMENT, byte, offsets_of, part, tail, word
from .vendors import UEFI_HEADER, entry, finding

#: The texts by which the vendor is known, and those that only speak of it.
KNOWN = r"Phoenix (?:Technologies Ltd|Software Associates|Compatibility Corp|ROM BIOS)|PPhhooeenniixx  TTeecchhnnoollooggiieess|\x00IBM AT Compatible Phoenix NuBIOS"
SPOKEN = r"search=f000,0,ffff,S,\"|\x00\xC3\x82as Ltd. de Phoenix del \xC2\x83 de Tecnolog\xC3\x83\x00"
#: The forms of versions, newest first.
TIANO = r"Phoenix BIOS SC-T (v[0-9\.]+)[\x20-\x7E]*"
XX86 = r"(PhoenixBIOS\(TM\) )[\x00-\xFF]{0,512}?(([A-Z][0-9]86|for ([\x20-\x7E]+?)(?: ?\(TM\))? (?:CPU )?- ([^ ]+)) Version )?([0-9]\.[0-9]{2})([\x20-\x7E]*)"
GRID = r"\xBE[\x00-\xFF]{2}\xE8[\x00-\xFF]{2}\x5E\xC3(([\x20-\x7E]*?) Version [\x20-\x7E]*?([0-9]\.[0-9]{2})[\x20-\x7E]*)[\x00-\xFF]+(PhoenixBIOS\(TM\) )\x00"
ROM_BIOS = r"(?:Phoenix )?((?:80[0-9a-zA-Z]+|V[1-4]0 |[0-9]{3})(?:/EISA)? )?ROM BIOS (PLUS )?Ver(?:sion|s\.)? ?([0-9]\.[A-Z]?[0-9]{2})[\x20-\x7E]*"
COMPATIBLE = r"(?:BIOS ROM|ROM BIOS)[\x0D\x0A\x20-\x7E]+Compatibility Software[\x0D\x0A\x20-\x7E]+Phoenix[\x0D\x0A\x20-\x7E]+"
HP = r"([\x21-\x7E]+ [\x21-\x7E]+) \(C\)Copyright 1985-.... Hewlett-Packard Company, All Rights Reserved[\x20-\x7E]+"
TIANO_MARK = r"SecureCore Tiano \(TM\) Preboot Agent |CSM_Egroup Code Ending"
#: The forms of sign-ons: two makers' models, and the older images' copyright or prompt in front of one.
DELL = r"Dell System [\x20-\x7E]+"
DELL_VERSION = r"(?:BIOS [Vv]ersion(?!  =):?|(?:80[0-9]{2,3}|Phoenix) ROM BIOS PLUS Version [^\s]+) ([A-Z0-9\.]+)"
DELL_CODE, DELL_AT, DELL_FILE_AT = r"^[A-Z][0-9]{2}$", 0x20, 0x30
COMMODORE = r"\xDA\xC4+\xBF[\x01-\xFF]+"
NEC = r"\xE9[\x00-\xFF]{2}(NEC Corporation\x0D\x0A[\x0D\x0A\x20-\x7E]*)"
RIGHTS = r"(Copyright \(C\) [0-9]{4} Digital Equipment Corporation)?\x0D\x0AAll Rights Reserved\x0D\x0A(?:\x0A(?:\x00(?:[\x90\xF4]\x01)?)?|\x0D\x0A\x0D\x0A)([\x00-\xFF]{0,256})"
REBOOT = r"\(R\)eboot, other keys to continue\x00\xFF+([\x00-\xFF]{0,256})"


def chain(data: Column) -> Column:
    """(segment, system, power_on): the offset of the first segment whose chain is valid, and those of the chain's first records of two kinds; null without one.

    The same as ``phoenix.chains``, as one fold over a single image's possible records for each segment mark.
    """
    start = lambda at: F.struct(
        (at + HEAD_BYTES).alias("from"), F.lit(FIRST_WITHIN).alias("within"), F.lit(False).alias("over"), F.lit(False).alias("bad"), F.lit(0).alias("n"), F.lit(-1).alias("system"), F.lit(-1).alias("power_on"))

    def step(s: Column, c: Column) -> Column:
        head = F.substring(data, c + 1, F.lit(HEAD_BYTES))
        size, name = word(head, 8), part(head, 0, 6)
        wrong = (F.octet_length(head) < HEAD_BYTES) | (part(head, 6, 9) == RECORD) | (size < HEAD_BYTES)
        first = lambda k, mark: F.when((s[k] < 0) & (name == mark), c).otherwise(s[k]).alias(k)
        taken = F.struct((c + F.coalesce(size, F.lit(0))).alias("from"), F.lit(NEXT_WITHIN).alias("within"), wrong.alias("over"), wrong.alias("bad"), (s["n"] + 1).alias("n"), first("system", "BCPSYS"), first("power_on", "BCPOST"))
        ended = F.struct(s["from"].alias("from"), s["within"].alias("within"), F.lit(True).alias("over"), s["bad"].alias("bad"), s["n"].alias("n"), s["system"].alias("system"), s["power_on"].alias("power_on"))
        return F.when(s["over"] | (c < s["from"]), s).when(c + len(RECORD) > s["from"] + s["within"], ended).otherwise(taken)

    def first_valid(places: Column) -> Column:
        marks = F.filter(places, lambda c: part(data, c, c + HEAD_BYTES) == SEGMENT)
        walked = F.transform(marks, lambda m: F.struct(m.alias("segment"), F.aggregate(places, start(m), step).alias("s")))
        # A segment without records ends the search.
        good = F.get(F.filter(walked, lambda w: ~w["s"]["bad"]), 0)
        return bind(good, lambda w: F.when(w["s"]["n"] > 0, F.struct(w["segment"].alias("segment"), w["s"]["system"].alias("system"), w["s"]["power_on"].alias("power_on"))))

    return bind(offsets_of(data, RECORD), first_valid)


def recorded(t: Column) -> Column:
    """(version, build, id, signon, post): what the records tell; null without a chain that has a system record."""

    def told(d: Column, c: Column) -> Column:
        base = F.lit(MEMORY) - F.octet_length(d)
        s, major, minor, size = c["system"], byte(d, c["system"] + 6), byte(d, c["system"] + 7), word(d, c["system"] + 8)
        maj, mid = byte(d, s + 10), byte(d, s + 11)
        two = lambda n: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(2)), "0")
        version = F.when(maj > 4, F.concat(F.lit("4."), two(maj))).when((maj == 4) & (mid >= 6), F.concat(F.lit("4.0 Release "), mid.cast("string"), F.lit(".0"))).otherwise(F.concat_ws(".", maj.cast("string"), two(mid)))
        clean = lambda a, b: F.trim(F.replace(part(d, s + a, F.least(s + b, s + size)), F.lit("\0"), F.lit(" ")))
        code = F.when((major == 0) & (size > 0x33), clean(0x33, 0x3B)).when((major != 0) & (size > 0x37), clean(0x37, 0x3F)).otherwise("")
        dates = F.when(major == 0, F.array(*[F.concat_ws(" ", clean(a, a + 8), clean(a + 8, a + 16)) for a in (0x0F, 0x1F)])).otherwise(F.array(clean(0x0F, 0x20), clean(0x21, 0x32)))
        dates = F.filter(F.transform(dates, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("00/00/00") & (size > 0x0F))
        build = F.array_join(F.filter(F.concat(F.array(code), dates), lambda x: x != ""), "\n")
        own = F.shiftright((base + c["segment"]).bitwiseAND(0xF0000), 4)
        late = (major >= 3) & (size >= 0x6B) & ~((major == 3) & (minor <= 1))
        ids = F.when(late, word(d, s + 0x69)).otherwise(own)
        signs = F.when((major == 1) & (minor >= 5) & (size >= 0x6D), word(d, s + 0x6B)).when(late, ids).otherwise(own)
        p = c["power_on"]
        post = (p >= 0) & (word(d, p + 8) >= 0x25)
        at = ids * 16 + word(d, p + 0x1B) - base
        at = F.when(byte(d, at) == 0, at + 1).otherwise(at)
        text = lambda x: filled(F.trim(read_string(part(d, x, x + 4096))))
        direct = signs * 16 + word(d, p + 0x23) - base
        # From 4.04 on the pointer is to a pointer in a table; from 4.06 on the table is in a file of its own.
        sign = F.when((maj == 4) & (mid >= 6) | (maj >= 6), F.lit(None)).when((maj >= 5) | (mid >= 4), signs * 16 + word(d, direct) - base).otherwise(direct)
        return F.struct(version.alias("version"), build.alias("build"), F.when(post & (at >= 0), text(at)).alias("id"), F.when(post & (sign >= 0), read_string(part(d, sign, sign + 4096))).alias("signon"), post.alias("post"))

    data = tail(F.encode(t, "ISO-8859-1"))
    return F.when(t.contains(SEGMENT), bind(data, lambda d: bind(chain(d), lambda c: F.when(c["system"] >= 0, told(d, c)))))


def spelled_version(t: Column, header: Column | None) -> Column:
    """(version, string, signon, id) by the first form of version that the text has; null with none."""
    row = lambda version, id_=None, string=None, signon=None: F.struct(
        version.alias("version"), *[(F.lit(None).cast("string") if c is None else c).alias(k) for k, c in (("string", string), ("signon", signon), ("id", id_))])
    tiano = row(F.concat(F.lit("SecureCore Tiano "), found(t, TIANO)), found(t, TIANO, 0))
    group = lambda p, k: F.regexp_extract(t, p, k)
    chip = F.concat(F.element_at(F.split(F.trim(group(XX86, 4)), "/"), -1), F.lit(" "), group(XX86, 5))
    branch = F.when(group(XX86, 4) != "", chip).when(group(XX86, 3) != "", group(XX86, 3)).otherwise("??86")
    xx86 = row(F.concat_ws(" ", branch, group(XX86, 6)), F.concat(*[group(XX86, k) for k in (1, 2, 6, 7)]))
    grid = row(F.concat_ws(" ", F.coalesce(found(t, GRID, 2), F.lit("??86")), group(GRID, 3)), F.concat(group(GRID, 4), group(GRID, 1)))
    pre = F.trim(F.replace(group(ROM_BIOS, 1), F.lit("  "), F.lit(" ")))
    pre = F.when((F.length(pre) >= 5) & pre.startswith("80"), F.substring(pre, 3, 99)).otherwise(pre)
    number = F.concat(group(ROM_BIOS, 2), group(ROM_BIOS, 3))
    rom = row(F.when(group(ROM_BIOS, 1) != "", F.concat_ws(" ", pre, number)).otherwise(number), group(ROM_BIOS, 0))
    whole, maker = group(COMPATIBLE, 0), found(t, HP)
    cut = F.instr(F.reverse(whole), "noisreV\r\n")
    at = F.when(maker.isNotNull() & (cut > 0), F.length(whole) - cut - 7)
    before, after = F.substring(whole, F.lit(1), F.coalesce(at - 1, F.length(whole)).cast("int")), F.when(at.isNotNull(), F.substring(whole, at.cast("int"), F.lit(4096)))
    compatible = row(F.when(maker.isNotNull(), "HP").otherwise("Tandy"), F.regexp_replace(before, r"^\s+|\s+$", ""), maker, after)
    marked = F.lit(False) if header is None else F.coalesce(header == F.encode(F.lit(UEFI_HEADER), "ISO-8859-1"), F.lit(False))
    forms = F.when(t.contains("Phoenix BIOS SC-T v") & t.rlike(TIANO), tiano).when(t.contains("PhoenixBIOS(TM) ") & t.rlike(XX86), xx86).when(t.contains("PhoenixBIOS(TM) \0") & t.rlike(GRID), grid)
    forms = forms.when(t.contains("ROM BIOS ") & t.rlike(ROM_BIOS), rom).when(t.contains("Compatibility Software") & t.rlike(COMPATIBLE), compatible)
    return forms.when(marked & t.rlike(TIANO_MARK), row(F.lit("SecureCore Tiano")))


def spelled_signon(t: Column) -> Column:
    """(signon, dell): the sign-on of an image without records that point to one, and whether the first form of it is the one that also is a version."""
    model, at = found(t, DELL, 0), place(t, r"Dell System [\x20-\x7E]")
    code = lambda c: F.when(c.rlike(DELL_CODE), c)
    near, far = F.substring(t, at + DELL_AT, F.lit(3)), F.substring(t, DELL_FILE_AT + 1, 3)
    version = F.coalesce(code(near), found(t, DELL_VERSION), code(far))
    dell = F.concat(model, F.coalesce(F.concat(F.lit("\nBIOS Version: "), version), F.lit("")))
    old = F.when(t.rlike(RIGHTS), F.when(F.regexp_extract(t, RIGHTS, 1) == "", F.regexp_extract(t, RIGHTS, 2))).otherwise(found(t, REBOOT))
    old = bind(old, lambda x: F.when(~x.startswith("\xfa") & (F.length(read_string(x)) > 3), read_string(x)))
    signon = F.coalesce(dell, found(t, COMMODORE, 0), found(t, NEC), old)
    return F.struct(signon.alias("signon"), model.isNotNull().alias("dell"))


def phoenix(t: Column, header: Column | None = None) -> Column:
    """The vendor's finding: what the records tell comes before what texts spell."""

    def made(r: Column) -> Column:
        return bind(F.when(r.isNull(), spelled_version(t, header)), lambda v: merged(r, v))

    def merged(r: Column, v: Column) -> Column:
        def done(s: Column) -> Column:
            version = F.coalesce(r["version"], v["version"], F.when(s["dell"], "Dell"))
            signon = tidy_lines(F.replace(F.coalesce(r["signon"], s["signon"], v["signon"]), F.lit("\0"), F.lit(" ")))
            return finding("Phoenix", version, v["string"], signon, entry("Build", filled(r["build"])), entry("ID", filled(F.coalesce(r["id"], v["id"]))))

        return bind(F.when(~F.coalesce(r["post"], F.lit(False)), spelled_signon(t)), done)

    known = (t.contains("Phoenix") | t.contains("PPhhooee")) & t.rlike(KNOWN) & ~t.rlike(SPOKEN)
    return F.when(known, bind(recorded(t), made))
