import gzip
import lzma
import struct
import zlib

from pyspark.sql import functions as F

from siltstone.operators import carve as V
from siltstone.operators.classify import as_latin1


def frame(spark, *rows):
    return spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")


def test_headers(spark):
    df = frame(spark, ("cap", bytes(2048) + b"x" * 4096), ("not", bytes(2048) + b"x" * 4095), ("apr", b"head" + b"y" * 8192), ("even", b"z" * 8192), ("empty", b""))
    got = {r.path: len(r.c) for r in df.select("path", V.strip_capsule(F.col("content")).alias("c")).collect()}
    assert got == {"cap": 4096, "not": 6143, "apr": 8196, "even": 8192, "empty": 0}
    header, image = V.strip_to_power(F.col("content"), 4)
    got = {r.path: (r.h and bytes(r.h), len(r.i)) for r in df.select("path", header.alias("h"), image.alias("i")).collect()}
    assert got["apr"] == (b"head", 8192) and got["even"] == (None, 8192) and got["empty"] == (None, 0)


def test_partitions(spark):
    boot = bytearray(512)
    boot[446:462] = struct.pack("<4xB3xII", 6, 1, 2)
    boot[462:478] = struct.pack("<4xB3xII", 0, 1, 2)
    boot[478:494] = struct.pack("<4xB3xII", 1, 9, 2)
    boot[510:] = b"\x55\xaa"
    rows = V.partitions(frame(spark, ("d", bytes(boot) + b"a" * 512 + b"b" * 512 + b"c" * 512), ("n", bytes(2048)))).collect()
    assert [(r.path, r.partition, r.type, bytes(r.content)) for r in rows] == [("d", 0, 6, b"a" * 512 + b"b" * 512)]


def test_marks(spark):
    data = b"\0" * 0x28 + b"_FVH.._FVH" + b"PCIR\x86\x80\x01\x12PCIR\x86\x80\x01\x12PCIR\xff\xff\0\0PCIR\x02\x10\x34\x56" + b"$PnP123456\x00\x01\x02\x03"
    t = as_latin1(F.col("content"))
    r = frame(spark, ("a", data), ("b", b"")).select("path", V.places(t, "_FVH").alias("p"), V.volumes(t).alias("v"), V.option_roms(t).alias("o"), V.pnp_headers(t).alias("n")).orderBy("path").collect()
    assert (r[0].p, r[0].v, [tuple(x) for x in r[0].o], r[0].n) == ([40, 46], [0, 6], [(0x1002, 0x5634), (0x8086, 0x1201)], [0x00010203])
    assert (r[1].p, r[1].v, r[1].o, r[1].n) == ([], [], [], [])


def test_streams(spark):
    text = b"a needle in every stream " * 3
    raw = zlib.compressobj(wbits=-15)
    data = b"JUNK" + zlib.compress(text) + b"\xff" * 9 + gzip.compress(text) + b"\xff" * 5 + lzma.compress(text, lzma.FORMAT_XZ) + b"\xff" * 3 + raw.compress(text) + raw.flush()
    got = V.search_streams(frame(spark, ("f", data), ("none", b"plain needle"), ("empty", b"")), b"needle in", least=len(text), stretch=64).collect()
    assert {(r.path, r.offset) for r in got if r.algorithm == "zlib15"} == {("f", 4)}
    assert {r.algorithm for r in got} >= {"zlib15", "zlib31", "xz", "zlib-15"} and {r.path for r in got} == {"f"}
