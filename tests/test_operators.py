import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalar as S
from siltstone.operators import assemble as A
from siltstone.operators import classify as C
from siltstone.operators import features as X
from siltstone.operators import relations as R
from siltstone.operators.unpack import open_one, unpack
from siltstone.sources import files, sinks
from siltstone.streaming import classify_stream as stream

ROMS = [
    ("tandon", b"\0\xff NOT COPR. IBM 1984 BIOS VERSION 3.61\0", ("Tandon", "3.61", None, None)),
    ("zenith", b"\x0105/13/87 (C)ZDS CORP\0Z-100 Monitor, Version 1.2\0", ("Zenith", "05/13/87", None, "Z-100 Monitor, Version 1.2")),
    ("mylex", b"MYLEX 386/20 BIOS Version 6.2 04/11/90\0", ("Mylex", "6.2", "04/11/90", None)),
    ("philips", b"\rPhilips ROM BIOS Version 2.12 \0", ("Philips", "2.12", None, None)),
    ("cps", b"BIOS V3.1\xfe Copyright 1991 Central Point Software, Inc.", ("CPS", "v3.1", None, None)),
    ("copam", b"THIS IS NOT IBM BIOS COPAM(C) 1985\xea\x5b\xe0\x00\xf001/02/86 \xe9..12/31/85", ("Copam", "", "01/02/86", None)),
    ("juko", b"Juko Electronics Industrial Co.,Ltd.\nJuko NEST BIOS ver 2.30\n", ("Juko", "2.30", "NEST", None)),
    ("small", b"Ver: V1.65-B123", None),
    ("mr", b"Ver: V1.65-B123" + b"\0" * 2048, ("MR", "V1.65", "B123", None)),
    ("both", b"NOT COPR. IBM 1984 BIOS VERSION 9\0\rPhilips ROM BIOS Version 1 ", ("Philips", "1", None, None)),
    ("schneider", b"EURO PC BIOS V2.06 but no maker", None),
    ("toshiba", b"Toshiba Corporation.ALL RIGHTS RESERVED.\0\0\0\0BIOS1234T1000 V4.00 xyz!", ("Award", "Toshiba", "T1000 V4.00 xyz!", None)),
    ("ncr", b"NCR'S VERSION IBM CORP. AT ROM", ("CDI", "NCR", None, None)),
    ("commodore", b"Commodore PC-10 Rom Bios Version 4.38\r\n", ("Commodore", "4.38", None, "")),
    ("compaq", b"01COMPAQ\xea\x5b\xe0\x00\xf003/04/88 ", ("Compaq", "", "03/04/88", None)),
    ("coreboot", b"coreboot-%s%s starting\0# This image was built using coreboot 4.12-20\0", ("coreboot", "4.12", None, None)),
    ("linuxbios", b"Jumping to LinuxBIOS.\0LinuxBIOS-1.1.8_Fallback Tue starting...", ("LinuxBIOS", "1.1.8", None, None)),
    ("ibm", b"61X8940  COPR. IBM 1987 and 33F4498 COPR. IBM 1988, 33F4498 COPR. IBM 1988", ("IBM", "PC series", "33F4498\n61X8940", None)),
    ("ibm2", b"0099FF33445566\x00" + b"1122AA33445566  ((CC))  CCOOPPYYRRIIGGHHTT  IIBBMM  CCOORRPPOORRAATTIIOONN  11998877", ("IBM", "PS/2 or PS/1", "12A3456", None)),
    ("icl", b"System BIOS #7 Version 1.04\r\n(c) Copyright ICL\r\n\n\0Hello", ("ICL", "1.04", "#7", "Hello")),
    ("tiny", b"x\0Board 1\r\0tinyBIOS V1.4a (C) PC Engines", ("tinyBIOS", "V1.4a", None, "Board 1")),
    ("quadtel", b"..Copyright 1985-1992 Quadtel Corp. Version 3.05".ljust(2 + 0xC8, b".") + b"QUADTEL 386 BIOS Version Q3.05.\0".ljust(0xC8, b"\0") + b" Hello 04/05/91 \0", ("Quadtel", "3.05 (Phoenix)", "04/05/91", "Hello 04/05/91")),
    ("surepath", b"(C) COPYRIGHT IBM CORPORATION 1981, 1996 ALL RIGHTS RESERVED\0SurePath BIOS Version 1.02 \r\nPC 300\0\xaa\x55VPD0RESERVEABC1234", ("IBM", "SurePath 1.02", "ABC1234", "PC 300")),
    ("apricot", b"(C) COPYRIGHT 1981, 1996 IBM CORPORATION ALL RIGHTS RESERVED\0@(#)XEN-PC BIOS v2\0@(#)Version 2.1\0\xea\x5b\xe0\0\xf001/02/96", ("IBM", "SurePath", "01/02/96", "XEN-PC BIOS v2\nVersion 2.1")),
    ("insyde without header", b"InsydeH2O Version 3", None),
    ("none", b"", None),
    ("null", None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b, _ in ROMS], "name string, content binary")
    got = {r["name"]: r["finding"] for r in C.classify(df, C.as_latin1(F.col("content"))).collect()}
    for name, _, want in ROMS:
        f = got[name]
        assert (want is None) == (f is None), name
        if want:
            assert (f["vendor"], f["version"], f["string"], f["signon"]) == want, name


def test_rules_of_a_header(spark):
    df = spark.createDataFrame([(bytearray(h) if h else None, bytearray(b)) for h, b in [
        (b"\0\xffUEFIExtract\xff\0", b"InsydeH2O Version 3"), (b"\0\xffUEFIExtract\xff\0", b"$FIDABCDEFGH.86A.0001.2002.0003.0004"), (None, b"InsydeH2O Version 3"), (b"x", b"InsydeH2O Version 3")
    ]], "h binary, c binary")
    got = [r["finding"] and (r["finding"]["vendor"], r["finding"]["signon"]) for r in C.classify(df, C.as_latin1(F.col("c")), header=F.col("h")).collect()]
    assert got == [("Insyde", None), ("Intel", "ABCDEFGH.86A.0001.2002.0003.0004"), None, None]


def test_features(spark, tmp_path):
    data = b"..FACP\x74\0\0\0" + b"x" * 20 + b"MSFT" + b"DSDT\x10\0\0\0" + b"x" * 20 + b"MSFT" + b"FACP\x75\0\0\0" + b"x" * 20 + b"MSFT"
    sli = b"123456789012Genuine NVIDIA Certified SLI Ready Motherboard for BoardABCD-Copyright 2007 NVIDIA"
    df = spark.createDataFrame([(bytearray(data + sli),)], "c binary").withColumn("t", C.as_latin1(F.col("c")))
    assert df.select(X.acpi_tables(F.col("t"))).first()[0] == ["FACP"]
    assert df.select(X.combined_metadata(df, ("SLI", X.sli_board(F.col("t"))), ("ACPI", F.array_join(X.acpi_tables(F.col("t")), " ")), ("Build", F.lit("")))).first()[0] == "[ACPI] FACP\n[SLI] Board"
    names = spark.createDataFrame([("amipci_10DE_0020.rom",), ("amipci_1.rom",)], "n string").select(X.rom_ids(F.col("n"))).collect()
    assert tuple(names[0][0]) == (0x10DE, 0x20) and names[1][0] is None
    signs = spark.createDataFrame([("B", 0, -4, bytearray(b"wxyz")), ("A", 0, -4, bytearray(b"wxyz")), ("A", 1, -8, bytearray(b"no")), ("C", 0, -4, bytearray(b"other"[:4]))], "key string, place int, from_end long, pattern binary")
    blobs = spark.createDataFrame([("p", bytearray(b"12345678wxyz")), ("q", bytearray(b"12nowxyz"[:4] + b"wxyz")), ("r", bytearray(b"y"))], "path string, content binary")
    assert {r.path: r.signature for r in X.signature_hits(blobs, signs).collect()} == {"p": "B", "q": "B"}


def test_assembly(spark):
    text = b"The quick brown fox jumps over the lazy dog!"
    rows = [("d", "a.bio", text[::2]), ("d", "b.bin", text[1::2]), ("e", "X.BIO", b"12"), ("e", "x.bi1", b"34"), ("e", "y.bio", b"5")]
    df = spark.createDataFrame([(f, n, len(c), bytearray(c)) for f, n, c in rows], "folder string, name string, size int, content binary")
    assert {r.image: bytes(r.content) for r in A.by_stem(df.filter("folder = 'e'")).collect()} == {"e/x": b"1234", "e/y": b"5"}
    assert text in [bytes(r.content) for r in A.interleaved(df.filter("folder = 'd'")).collect()]


def test_discard(spark):
    rows = [(b"\x89PNG...", True), (b"<html >", True), (b"\x7fELF" + bytes(200), True), (b"\x7fELF" + bytes(124) + b"ELFBoot\0", False), (b"plain", False), (b" BM", False)]
    df = spark.createDataFrame([(bytearray(b), w) for b, w in rows], "c binary, want boolean")
    assert df.filter(C.is_discarded(C.as_latin1(F.col("c"))) != F.col("want")).count() == 0


def nested() -> bytes:
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/rom.bin", b"inner")
        f.writestr("pic.png", b"\x89PNG")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w", format=tarfile.USTAR_FORMAT) as f:
        info = tarfile.TarInfo("deep.zip")
        info.size = len(z.getvalue())
        f.addfile(info, io.BytesIO(z.getvalue()))
    return gzip.compress(t.getvalue())


def test_unpack_to_the_end(spark, tmp_path):
    rows = [("x/nested.tgz", nested()), ("x/leaf.bin", b"leaf"), ("x/bad.zip", b"PK\3\4broken"), ("x/seven.7z", b"7z\xbc\xaf\x27\x1c.."), ("x/pic.gif", b"GIF89a"), ("x/none", None)]
    df = spark.createDataFrame([(p, bytearray(b) if b is not None else None) for p, b in rows], "path string, content binary")
    got = {r["path"]: (bytes(r["content"]), r["event"]) for r in unpack(df, str(tmp_path)).collect()}
    assert got == {
        "x/nested.tgz:/content:/deep.zip:/a/rom.bin": (b"inner", "leaf"),
        "x/leaf.bin": (b"leaf", "leaf"),
        "x/bad.zip": (b"PK\3\4broken", "failed zip: BadZipFile"),
        "x/seven.7z": (b"7z\xbc\xaf\x27\x1c..", "unsupported 7z"),
    }
    shallow = {r["path"]: r["event"] for r in unpack(df.limit(1), str(tmp_path), depth=1).collect()}
    assert shallow == {"x/nested.tgz:/content:/deep.zip": "too deep"}


def test_hex_records():
    event, members = open_one(b":0400000001020304F2\r\n:02000600AABB93\r\n:0100000009F6\r\n:00000001FF\r\n")
    assert event == "hex" and list(members) == [("content", b"\x09\x02\x03\x04\0\0\xaa\xbb")]


def test_sources(spark, tmp_path):
    (tmp_path / "t" / "g").mkdir(parents=True)
    for name, data in ((files.COMBINED, b"12"), ("a", b"A"), ("b", b"BB")):
        (tmp_path / "t" / "g" / name).write_bytes(data)
    (tmp_path / "t" / "single").write_bytes(b"S")
    tree = files.grouped(files.scan_tree(spark, f"{tmp_path}/t"))
    rows = {r["name"]: r for r in tree.collect()}
    assert len({rows[n]["group_id"] for n in (files.COMBINED, "a", "b")}) == 1 and rows["a"]["interleave_parts"] == 2
    assert rows["single"]["group_id"].endswith("/t/single")

    (tmp_path / "pci.ids").write_text("# x\n0001  One\n\t0002  Two\n\t\t0003 0004  Sub\n00ab  Vendor B\nC 01  Class\n\t00  Sub class\n")
    ids = files.pci_ids(spark, f"{tmp_path}/pci.ids")
    assert sorted(map(tuple, ids.collect()), key=str) == sorted([(1, None, "One", None), (1, 2, "One", "Two"), (171, None, "Vendor B", None)], key=str)
    some = spark.createDataFrame([(1, 2), (1, 9), (7, 7)], "vendor_id int, device_id int")
    assert {tuple(r) for r in files.pci_names(some, ids).select("vendor", "device").collect()} == {("One", "Two"), ("One", "[Unknown]"), ("[Unknown]", "")}

    cells = ["Ven", "1.0", "x", "y", "z", "FFFF0", "4142", "FFFF5", "hi", "0", "", "0", "", "0", "", "0", "", "0", "0"]
    (tmp_path / "sig").write_text("known_bios(" + ",".join(f'"{c}"' for c in cells) + ")\n")
    assert [(r.key, r.from_end, bytes(r.pattern)) for r in files.signatures(spark, f"{tmp_path}/sig").orderBy("place").collect()] == [("Ven\n1.0", -16, b"AB"), ("Ven\n1.0", -11, b"hi")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(" a\tb ", 'say "x"', None), ("line\nbreak", "", "v")], "`Sign-on` string, b string, c string")
    assert [r[0] for r in sinks.tidy(df).select(sinks.xsv_row(df, ";")).collect()][0] == '"a b";"say ""x""";""'
    assert [r[0] for r in sinks.tidy(df).select(sinks.json_object(df)).collect()] == ['{"signon":"a b","b":"say \\"x\\""}', '{"signon":"line\\nbreak","c":"v"}']
    assert [r[0] for r in df.select(sinks.json_row(df)).collect()][1] == '["line\\nbreak","","v"]'
    sinks.write_xsv(df, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert back.count() == 2 and back.columns == df.columns
    sinks.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_stream_classifies_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for turn in range(2):
        (tmp_path / "in" / f"rom{turn}").write_bytes(b"NOT COPR. IBM 1984 BIOS VERSION %d" % turn)
        stream.write_findings(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.version for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["0", "1"]
    assert stream.vendor_counts(stream.findings(stream.arriving(spark, f"{tmp_path}/in"))).isStreaming


def test_relations_on_edges(spark):
    i = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 12), ("b", 2, 20)], "g string, b long, e long")
    assert sorted(map(tuple, R.gaps(i, "g", "b", "e", F.lit(20).cast("long")).collect())) == [("a", 8, 10), ("a", 12, 20), ("b", 0, 2)]
    s = spark.createDataFrame([("d", k, n) for k, n in enumerate([3, 5, 4, 4, 0, None])], "g string, k int, n long")
    assert sorted((r.a, r.b, r.whole) for r in R.size_pairs(s, "g", "k", "n").collect()) == [(1, 0, 8), (2, 3, 8)]
    p = spark.createDataFrame([(1, "a/b/c")], "k int, p string").select(R.ancestors(F.col("p"))).first()[0]
    assert p == ["a", "a/b", "a/b/c"]


@pytest.mark.parametrize("text, want", [("Foo Semiconductor Corp., Ltd.", "Foo"), ("Digital Equipment Corporation", "DEC"), ("Advanced Micro [AMD]", "AMD"), ("", ""), (None, None)])
def test_clean_vendor(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(S.clean_vendor(F.col("v"))).first()[0] == want
