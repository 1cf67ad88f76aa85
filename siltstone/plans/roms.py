"""Small firmware-like images, one or more for each rule of the chain, with what the chain must find in them.

The registered query puts them behind the texts of a table; its SQL has the expected results as a table of values.
"""

from __future__ import annotations

from ..operators.vendors import UEFI_HEADER

UEFI = UEFI_HEADER.encode("latin-1")
#: An update header of a maker: a mark at 90, the version at 112.
FLASH = (bytes(90) + b"FLASH").ljust(112, b"\0") + b"1.00.05.CB0\0"


def at(size: int, **places: bytes) -> bytes:
    """An image of zeros with texts at places, given as ``x`` and hexadecimal digits."""
    out = bytearray(size)
    for place, text in places.items():
        k = int(place[1:], 16)
        out[k : k + len(text)] = text
    return bytes(out)


def hidden(text: str) -> bytes:
    """A text as complements turned right by five bits, the last letter with its top bit set."""
    code = [*text.encode()[:-1], ord(text[-1]) | 128]
    return bytes(255 - ((c >> 5 | c << 3) & 255) for c in code)


def negated(text: str) -> bytes:
    """A text as negatives turned right by one bit."""
    return bytes(-(c >> 1 | c << 7) & 255 for c in text.encode())


AMI_COLOR = dict(x0=b"0123AAAAMMMMIIII07/25/94(C)1994 American Megatrends Inc., All Rights Reserved", x78=b"40-0100-006259-00101111-072594-SIS3486-0",
                 x100=b"AMIBIOS (C)1994 American Megatrends Inc.,\r\nBoard X\r\n\0", x210=b"AMIBIOS EASY SETUP UTILITY\0 Wait----", x250=b"$$CT\x01Chip Table\0$$CT\x02Port POST Init\0")
AMI_SIX = AMI_COLOR | dict(x0=b"AMIBIOS 062710xx07/15/97(C)1997 American Megatrends Inc., All Rights Reserved", xec=b"_TG_ 7\0", x210=b"", x250=b"")
OLD = dict(x0=b"\xaa\x55____04/30/90", x20=b"(C)1990AMI,404-263-8181", x40=b" Date:- 04/30/90 ", x60=b"\xfe" + hidden("DINT-1123-043090-K8-K"),
           x90=b"386-BIOS (C)1989 American Megatrends Inc., for Maker of Boards\0")
AWARD_BLOCK = dict(x0=b"Award " + b"Software" + b"IBM COMPATIBLE", x61=b"Award Modular BIOS v4.51PG An Energy Star Ally\0", xc1=b"Line one\r\n\x0b Line two \0",
                   xc71=b"08/21/98-i440BX-W977-2A69KX1XC-00\0", xd00=b"(c) Award Software Inc.")


def record(name: bytes, body: bytes, major: int, minor: int) -> bytes:
    """A chained record."""
    return name + bytes([major, minor]) + (10 + len(body)).to_bytes(2, "little") + body


def phoenix(core: tuple[int, int], revision: tuple[int, int], pointer: bool, broken: bool = False) -> bytes:
    """64 KB with a chain at 0x4000, an identification at 0x3000 and a sign-on at 0x3100, which a pointer at 0x3200 may lead to."""
    system = bytearray(0x63)
    system[0:3], system[5:22], system[0x2D:0x35] = bytes([*core, 0]), b"03/04/97 01:02:03", b"BUILD 12"
    system[0x5F:0x61] = (0xF000).to_bytes(2, "little")
    system[0x61:0x63] = (0xF000).to_bytes(2, "little")
    post = bytearray(0x1B)
    post[0x11:0x13] = (0x3000).to_bytes(2, "little")
    post[0x19:0x1B] = (0x3200 if pointer else 0x3100).to_bytes(2, "little")
    chain = b"BCPSEGMENT" + (b"BCPSYS" + bytes(4) + b"BCPSEGMENT" if broken else b"") + record(b"BCPSYS", bytes(system), *revision) + b"-" + record(b"BCPOST", bytes(post), 0, 3)
    return at(0x10000, x100=b"Phoenix Technologies Ltd", x3000=b"PhoenixBIOS 4.0 ID\0", x3100=b"Board sign-on\r\n second line \0", x3200=(0x3100).to_bytes(2, "little"), x4000=chain)


#: name, header, image, and what is found: vendor, version, string, sign-on, metadata.
IMAGES: list[tuple[str, bytes | None, bytes, tuple[str, str, str, str, str] | None]] = [
    ("power", None, at(0x200, x0=b"IBM COMPATIBLE BIOS COPYRIGHT AWARD SOFTWARE INC.", x82=b"PowerBIOS Version 2.10\0Copyright X\0mS7SI0A\0", x120=b"PowerBIOS Setup"),
     ("Award", "PowerBIOS 2.10", "S7SI0A", "", "[ID] PowerBIOS Version 2.10\n     Copyright X")),
    ("toshiba", None, b"Toshiba Corporation.ALL RIGHTS RESERVED.\0\0\0\0BIOS1234T1000 V4.00 xyz!", ("Award", "Toshiba", "T1000 V4.00 xyz!", "", "")),
    ("award", None, at(0xE00, **AWARD_BLOCK), ("Award", "v4.51PG", "08/21/98-i440BX-W977-2A69KX1XC-00", "Line one\nLine two", "[ID] Award Modular BIOS v4.51PG An Energy Star Ally")),
    ("award new date", None, at(0xE00, **AWARD_BLOCK | dict(xd40=b"N03/04/2001" + b"03/04/01")), ("Award", "v4.51PG", "03/04/01-i440BX-W977-2A69KX1XC-00", "Line one\nLine two", "[ID] Award Modular BIOS v4.51PG An Energy Star Ally")),
    ("award second block", None, at(0xE00, **AWARD_BLOCK | dict(xc71=b"short-\0")) + at(0xE00, **AWARD_BLOCK | dict(x61=b"Award Modular BIOS v4.20\0", xc71=b"05/05/94-OPTI-82C895-00\0")),
     ("Award", "v4.20", "05/05/94-OPTI-82C895-00", "Line one\nLine two", "[ID] Award Modular BIOS v4.20")),
    ("award old", None, at(0xE00, **AWARD_BLOCK | dict(x61=b"286 Modular BIOS V3.03 NFS\0")), ("Award", "v3.03", "", "Line one\nLine two", "[ID] 286 Modular BIOS V3.03 NFS")),
    ("award net", None, at(0xE00, **AWARD_BLOCK | dict(xd40=b"CPLRESELLERID BINCPUTBL BINIDETBL EFI CD/DVD Boot Option")),
     ("Award", "v4.51PG", "08/21/98-i440BX-W977-2A69KX1XC-00", "Line one\nLine two", "[ID] Award Modular BIOS v4.51PG An Energy Star Ally\n[UEFI] Gigabyte Hybrid EFI\n[PhoenixNet]")),
    ("award medallion", None, at(0xE00, **AWARD_BLOCK | dict(xd40=b"Award Medallion BIOS v6.0\0Copyright (C) 1984-98, Award Software, Inc.\0")),
     ("Award", "v6.0", "08/21/98-i440BX-W977-2A69KX1XC-00", "Line one\nLine two", "[ID] Award Medallion BIOS v6.0")),
    ("award ast", None, at(0x300, x0=b"(c) COPYRIGHT 1984,1990Award Software Inc.", x44=b"AST Premium 386\nCopyright AST\nRev 1.0\nIBM IS A TRADEMARK OF INTERNATIONAL BUSINESS MACHINES CORP.\nx\0"),
     ("Award", "AST", "", "AST Premium 386\nRev 1.0", "")),
    ("award early", None, at(0x200, x0=b"XT BIOS V2.05 COPYRIGHT AWARD SOFTWARE INC.", x3c=b"Early machine\0"), ("Award", "v2.05", "", "Early machine", "")),
    ("quadtel", None, b"..Copyright 1985-1992 Quadtel Corp. Version 3.05".ljust(2 + 0xC8, b".") + b"QUADTEL 386 BIOS Version Q3.05.\0".ljust(0xC8, b"\0") + b" Hello 04/05/91 \0", ("Quadtel", "3.05 (Phoenix)", "04/05/91", "Hello 04/05/91", "")),
    ("phoenix old", None, phoenix((4, 3), (1, 4), False), ("Phoenix", "4.03", "", "Board sign-on\nsecond line", "[Build] BUILD 12\n        03/04/97 01:02:03\n[ID] PhoenixBIOS 4.0 ID")),
    ("phoenix middle", None, phoenix((4, 5), (1, 5), True, True), ("Phoenix", "4.05", "", "Board sign-on\nsecond line", "[Build] BUILD 12\n        03/04/97 01:02:03\n[ID] PhoenixBIOS 4.0 ID")),
    ("phoenix release", None, phoenix((4, 6), (3, 2), True), ("Phoenix", "4.0 Release 6.0", "", "", "[Build] BUILD 12\n        03/04/97 01:02:03\n[ID] PhoenixBIOS 4.0 ID")),
    ("phoenix tiano", None, b"Phoenix Technologies Ltd\0Phoenix BIOS SC-T v2.1 Build 3\0", ("Phoenix", "SecureCore Tiano v2.1", "", "", "[ID] Phoenix BIOS SC-T v2.1 Build 3")),
    ("phoenix pentium", None, b"Phoenix Technologies Ltd\0PhoenixBIOS(TM) for Pentium(TM) CPU - 82430FX Version 1.03 patch\0", ("Phoenix", "Pentium 82430FX 1.03", "", "", "[ID] PhoenixBIOS(TM) for Pentium(TM) CPU - 82430FX Version 1.03 patch")),
    ("phoenix a486", None, b"Phoenix Technologies Ltd\0PhoenixBIOS(TM) \1\2A486 Version 1.01\0\r\nAll Rights Reserved\r\n\n\0Old board\0", ("Phoenix", "A486 1.01", "", "Old board", "[ID] PhoenixBIOS(TM) A486 Version 1.01")),
    ("phoenix rom bios", None, b"Phoenix Software Associates\x0080386 ROM BIOS PLUS Version 1.10 07\0(R)eboot, other keys to continue\0\xff\xffSign here\0", ("Phoenix", "386 PLUS 1.10", "", "Sign here", "[ID] 80386 ROM BIOS PLUS Version 1.10 07")),
    ("phoenix dell", None, b"Phoenix Technologies Ltd\0Dell System Dimension XPS".ljust(25 + 32, b"\0") + b"A07\0", ("Phoenix", "Dell", "", "Dell System Dimension XPS\nBIOS Version: A07", "")),
    ("phoenix hp", None, b"Phoenix Compatibility Corp\0ROM BIOS one Compatibility Software two Phoenix three\n\rVersion D.02.02\0Vectra ES (C)Copyright 1985-1988 Hewlett-Packard Company, All Rights Reserved.\0",
     ("Phoenix", "HP", "Vectra ES", "Version D.02.02", "[ID] ROM BIOS one Compatibility Software two Phoenix three")),
    ("phoenix only spoken of", None, b"Phoenix Technologies Ltd search=f000,0,ffff,S,\"x", None),
    ("phoenix without version", None, b"Phoenix Technologies Ltd and no more", None),
    ("ami uefi", UEFI, b"$SGN$\x01abFirst line\0Board sign-on\r\0", ("AMI", "UEFI", "", "Board sign-on", "")),
    ("ami uefi maker", UEFI, b"ALASKAA M I..$MSESGN$Maker 1.2 Release\0", ("AMI", "UEFI", "", "Maker 1.2 Release", "")),
    ("ami color", None, at(0x400, **AMI_COLOR), ("AMI", "07/25/94", "40-0100-006259-00101111-072594-SIS3486-0", "Board X", "[ID] AMIBIOS (C)1994 American Megatrends Inc.,\n[Setup] Easy, WinBIOS\n[Table] Chip\n        Port")),
    ("ami six", None, at(0x400, **AMI_SIX), ("AMI", "062710", "40-0100-006259-00101111-072594-SIS3486-0-7", "Board X", "[ID] AMIBIOS (C)1994 American Megatrends Inc.,")),
    ("ami win", None, at(0x400, **AMI_SIX | dict(x0=b"AMIBIOS W 04 02x12/15/93(C)1993 American Megatrends Inc., All Rights Reserved", xec=b"")),
     ("AMI", "040200", "40-0100-006259-00101111-072594-SIS3486-0", "Board X", "[ID] AMIBIOS (C)1994 American Megatrends Inc.,\n[Setup] WinBIOS")),
    ("ami old", None, at(0x500, **OLD), ("AMI", "04/30/90", "DINT-1123-043090-K8", "Maker of Boards", "[ID] 386-BIOS (C)1989 American Megatrends Inc.")),
    ("ami 8088", None, at(0x500, x0=b"AMI- 05/10/88 IBM is a TM of IBM", x40=negated("(C)AMI, (") + negated("8088-BIOS-0510") + b"\x6c"), ("AMI", "05/10/88", "8088-BIOS-0510", "", "")),
    ("ami intel", FLASH, b"AMIBIOS 94 AMIBIOSC0632 and more", ("AMI", "063200", "", "1.00.05.CB0", "")),
    ("intel", FLASH, b"packed data only", ("Intel", "", "", "1.00.05.CB0", "")),
    ("mr", None, b"Ver: V1.65-B123" + b"\0" * 2048, ("MR", "V1.65", "B123", "", "")),
    ("mr new", None, b"MR BIOS (r)  V2.01 \t ACER01" + b"\0" * 2048, ("MR", "V2.01", "ACER01", "", "")),
    ("mr sign-on", None, b"Ver V1.44 Port OPT495 OEM SIGNON >>-->Maker of boards\0<--<< OEM SIGNON" + b"\0" * 2048, ("MR", "V1.44", "OPT495", "Maker of boards", "")),
    ("mr code before sign-on", None, b"Ver V1.44 Port OPT495 OEM SIGNON >>-->P\x01" + b"c" * 14 + b"Other maker<--<< OEM SIGNON" + b"\0" * 2048, ("MR", "V1.44", "OPT495", "Other maker", "")),
    ("acer", None, b"Acer Boot Block v1.0\0ACER\0V3.0\0\0\x01\x02ACRF1M33-E00-960509-R02-A1 Hello there\0", ("Acer", "V3.0", "ACRF1M33-E00-960509-R02-A1", "Hello there", "")),
    ("acer first", None, b"Copyright (C) Acer Incorporated 1990\0\x01M1 ACER BIOS V1.0 R2\0\0\x02Acer ID text\0REV 1.00\0.J3abc\0", ("Acer", "V1.0 R2", "J3abc", "REV 1.00", "[ID] M1 ACER BIOS V1.0 R2\n[ID] Acer ID text")),
    ("multitech", None, b"Multitech Industrial Corp.,BIOS 01/02/86 ver.2.1\0", ("Acer", "Multitech", "01/02/86 ver.2.1", "", "")),
    ("ampro", None, b"AMPRO LB/PC Rom-Bios of today\nVersion 3.2 x", ("AMPRO", "3.2", "", "LB/PC", "")),
    ("amstrad", None, b"AMSTRAD plc please fit new batteries\xea\x5b\xe0\0\xf003/04/88", ("Amstrad", "", "03/04/88", "", "")),
    ("ncr", None, b"NCR'S VERSION IBM CORP. AT ROM", ("CDI", "NCR", "", "", "")),
    ("cps", None, b"BIOS V3.1\xfe Copyright 1991 Central Point Software, Inc.", ("CPS", "v3.1", "", "", "")),
    ("chips", None, b" Chips & Technologies\r\n\0PC BIOS Version 2.2\0", ("C&T", "", "", "PC BIOS Version 2.2", "")),
    ("commodore", None, b"Commodore PC-10 Rom Bios Version 4.38\r\n", ("Commodore", "4.38", "", "", "")),
    ("compaq", None, b"01COMPAQ\xea\x5b\xe0\x00\xf003/04/88 ", ("Compaq", "", "03/04/88", "", "")),
    ("copam", None, b"THIS IS NOT IBM BIOS COPAM(C) 1985\xea\x5b\xe0\x00\xf001/02/86 \xe9..12/31/85", ("Copam", "", "01/02/86", "", "")),
    ("coreboot", None, b'coreboot-%s%s starting\0# This image was built using coreboot 4.12-20\0#define COREBOOT_BUILD "Mon 1"\0', ("coreboot", "4.12", "", "", "[ID] coreboot 4.12-20\n[Build] Mon 1")),
    ("linuxbios", None, b"Jumping to LinuxBIOS.\0LinuxBIOS-1.1.8_Fallback Tue starting...", ("LinuxBIOS", "1.1.8", "", "", "[ID] LinuxBIOS-1.1.8_Fallback Tue")),
    ("dtk", None, b"Datatech Enterprises Co., Ltd.\0DTK 386 BIOS Ver 4.26 Rev. 2\0", ("DTK", "4.26", "", "", "[ID] DTK 386 BIOS Ver 4.26 Rev. 2")),
    ("general", None, b"General Software Embedded BIOS (tm) 4.1 Revision 2\0" + b"05/06/97(C) 1997 General Software, Inc. Demo board\0", ("General", "Embedded  4.1", "Demo board\n05/06/97", "", "")),
    ("surepath", None, b"(C) COPYRIGHT IBM CORPORATION 1981, 1996 ALL RIGHTS RESERVED\0SurePath BIOS Version 1.02 \r\nPC 300\0\xaa\x55VPD0RESERVEABC1234", ("IBM", "SurePath 1.02", "ABC1234", "PC 300", "")),
    ("ibm", None, b"61X8940  COPR. IBM 1987 and 33F4498 COPR. IBM 1988, 33F4498 COPR. IBM 1988", ("IBM", "PC series", "33F4498\n61X8940", "", "")),
    ("icl", None, b"System BIOS #7 Version 1.04\r\n(c) Copyright ICL\r\n\n\0Hello", ("ICL", "1.04", "#7", "Hello", "")),
    ("insyde", UEFI, b"InsydeH2O Version 3", ("Insyde", "", "", "", "")),
    ("intel uefi", UEFI, b"$FIDABCDEFGH.86A.0001.2002.0003.0004", ("Intel", "UEFI", "", "ABCDEFGH.86A.0001.2002.0003.0004", "")),
    ("juko", None, b"Juko Electronics Industrial Co.,Ltd.\nJuko NEST BIOS ver 2.30\n", ("Juko", "2.30", "NEST", "", "")),
    ("mylex", None, b"MYLEX 386/20 BIOS Version 6.2 04/11/90\0", ("Mylex", "6.2", "04/11/90", "", "")),
    ("olivetti", None, b"COPYRIGHT (C)   OLIVETTI\0No ROM BASIC available - RESET\x0005/11/90\0Version 2.01\x0004/12/88\0Nothing more\0", ("Olivetti", "2.01", "05/11/90", "", "")),
    ("philips", None, b"\rPhilips ROM BIOS Version 2.12 \0", ("Philips", "2.12", "", "", "")),
    ("promag", None, b"(C) PROMAG SYSTEM BOARD VER. 1.3 of 1992\nGreen machine\0", ("Promag", "1.3", "", "Green machine", "")),
    ("schneider", None, b"Schneider Rdf. AG EURO PC  BIOS V2.06\0", ("Schneider", "V2.06", "", "", "")),
    ("systemsoft", None, b"\x01SystemSoft BIOS for Intel 430TX Version 1.01.45\r\n\0\x08\0Copyright SystemSoft\r\n\0\x08\0Notebook X\0", ("SystemSoft", "1.01.45", "", "Notebook X", "[ID] SystemSoft BIOS for Intel 430TX Version 1.01.45")),
    ("mobilepro", None, b"\x01Insyde Software Presto BIOS Version 2.2 (9)\0\x01SystemSoft SCU. Copr 1983-97\0\x01SystemSoft SCU for Intel 440BX chipset\0", ("SystemSoft", "Presto 2.2", "", "", "[ID] Insyde Software Presto BIOS Version 2.2 (9)\n[ID] SystemSoft SCU for Intel 440BX chipset")),
    ("tandon", None, b"\0\xff NOT COPR. IBM 1984 BIOS VERSION 3.61\0", ("Tandon", "3.61", "", "", "")),
    ("tiny", None, b"x\0Board 1\r\0tinyBIOS V1.4a (C) PC Engines", ("tinyBIOS", "V1.4a", "", "Board 1", "")),
    ("zenith", None, b"\x0105/13/87 (C)ZDS CORP\0Z-100 Monitor, Version 1.2\0", ("Zenith", "05/13/87", "", "Z-100 Monitor, Version 1.2", "")),
    ("two makers", None, b"NOT COPR. IBM 1984 BIOS VERSION 9\0\rPhilips ROM BIOS Version 1 ", ("Philips", "1", "", "", "")),
    ("schneider without maker", None, b"EURO PC BIOS V2.06 but no maker", None),
    ("ami too small", None, b"American Megatrends Inc AMI- 05/10/88", None),
    ("uefi without header", None, b"InsydeH2O Version 3", None),
    ("award display", None, b"Award Software Inc. IBM COMPATIBLE VGA BIOS Version 1\r\nCopyright (c) Award", None),
    ("empty", None, b"", None),
]
