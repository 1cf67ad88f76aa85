import io
import random
import struct
import zipfile

from pyspark.sql import functions as F

from siltstone.operators import carve as V
from siltstone.operators import unpack as U


def frame(spark, rows):
    return spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")


def zipped(*members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return raw.getvalue()


def test_no_artifact_ends_the_job(spark, tmp_path, monkeypatch):
    broken = bytearray(zipped(("a", b"first member"), ("b", bytes(5000))))
    broken[-200:-150] = b"\xff" * 50
    ast = bytearray(0x9000 + 9216)
    ast[V.AST_AT : V.AST_AT + len(V.AST_MARK)] = V.AST_MARK.encode()
    ast[V.AST_PAYLOAD : V.AST_PAYLOAD + len(V.AST_TEXT)] = V.AST_TEXT.encode()
    ast[V.AST_PAYLOAD + V.AST_HEAD - 5 : V.AST_PAYLOAD + V.AST_HEAD - 1] = b"\xff" * 4
    rows = [
        ("runs", b"SNIPAC41\xff\xff\xff\xffabc"),
        ("many runs", b"SNIPAC41\x00\x00\x00\x03" * 3),
        ("small runs", b"xSNIPAC41\x03\x00\x00\x00y"),
        ("floppy", bytes(ast)),
        ("intel", b"$IBI\0\0\0\0" + struct.pack("<II", 0xFFFFFFFF, 0xFFFFFFFF) + b"x"),
        ("broken", bytes(broken)),
        ("cut", zipped(("a", random.Random(1).randbytes(9000)))[:4000]),
        ("plain", b"\x01plain"),
    ]
    got = {r.path: r for r in U.unpack(frame(spark, rows), str(tmp_path)).collect()}
    assert got["runs"].event == got["many runs"].event == U.TOO_LARGE and bytes(got["runs"].content) == rows[0][1]
    assert bytes(got["small runs:/payload"].content) == b"xAAAy" and got["plain"].event == "leaf"
    assert got["cut"].event.startswith("failed zip") and {p.split(":")[0] for p in got} == {p for p, _ in rows}


def test_random_bytes_behind_every_mark(spark, tmp_path):
    rng = random.Random(9)
    marks = [b"PK\3\4", b"\x1f\x8b\x08", b"BZh9", b"\xfd7zXZ\0", b"$IBI", b"SNIPAC7F", b"CPU-Z version\t", b":10000000", b"Rar!", bytes(257) + b"ustar", bytes(90) + b"FLASH", V.AST_MARK.encode()]
    rows = [(f"{k}-{j}", m + rng.randbytes(rng.choice([0, 1, 7, 40, 700]))) for k, m in enumerate(marks) for j in range(25)]
    got = U.unpack(frame(spark, rows), str(tmp_path)).collect()
    assert all(r.event for r in got) and {r.path.split(":")[0] for r in got} <= {p for p, _ in rows}
    parts = V.partitions(frame(spark, [("d", rng.randbytes(446) + rng.randbytes(64) + b"\x55\xaa" + rng.randbytes(900))] + [("e", bytes(450) + b"\x06\0\0\0\1\0\0\0\xff\xff\xff\xff" + bytes(48) + b"\x55\xaa" + b"z" * 700)]))
    assert [bytes(r.content) for r in parts.filter("path = 'e'").collect()] == [b"z" * 700] and parts.count() >= 1


def test_limits_of_a_container(monkeypatch):
    monkeypatch.setattr(U, "CONTAINER_BYTES", 25_000)
    data = zipped(*[(f"m{k}", bytes(10_000)) for k in range(5)])
    rows = U.opened("z", None, 0, data)
    assert next(rows)[0] == "z:/m0"  # members come one by one
    rows = list(rows)
    assert [r[0] for r in rows] == ["z:/m1", "z"] and rows[-1][4] == U.TOO_MUCH and rows[-1][3] == data
    monkeypatch.setattr(U, "MEMBERS", 1)
    assert [r[4] for r in U.opened("z", None, 0, data)] == [None, U.TOO_MANY]


def test_directories_with_wrong_lengths(spark, tmp_path):
    entry = lambda name, data, size=None, flag=0: bytes(10) + struct.pack("<H", len(data) if size is None else size) + bytes(5) + name.ljust(11, b"\0") + bytes([flag]) + bytes(3) + data
    ros = lambda *e: b"ROS".ljust(32, b"\0") + b"".join(e)
    rows = [
        ("good", ros(entry(b"A/B     TXT", b"\1first"), entry(b"C       BIN", b"\1second"))), ("over", ros(entry(b"A", b"\1one"), entry(b"B", b"\1two", 999))), ("cut", ros(entry(b"A", b"\1one"))[:-20]),
        ("empty", ros()), ("unsure", ros(entry(b"A", b"\1one"), entry(b"B", b"\1all the rest", 3, 0x10))), ("many", ros(*[entry(b"N%d" % k, b"") for k in range(5000)])), ("random", b"ROS" + random.Random(1).randbytes(5000)),
    ]
    got = {}
    for r in U.unpack(frame(spark, rows), str(tmp_path), sets=False).collect():
        got.setdefault(r.path.split(":")[0], {})[r.path.partition(":/")[2]] = (r.event, bytes(r.content))
    assert got["good"]["A\\B     .TXT"] == ("leaf", b"\1first") and got["good"]["C       .BIN"][1] == b"\1second" and got["good"][""][0] == "listed"
    assert got["over"][""][0] == got["cut"][""][0] == got["many"][""][0] == U.WRONG_LENGTH and got["over"]["A."][1] == b"\1one" and len(got["over"]) == 2
    assert got["empty"][""][0] == "empty directory" and got["unsure"]["B."][1] == b"\1all the rest" and got["random"][""][0] == U.WRONG_LENGTH
