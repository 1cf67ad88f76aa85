import random
import struct

from pyspark.sql import functions as F

from siltstone.operators import carve as V
from siltstone.operators import stores as O
from siltstone.operators.classify import as_latin1


def update(rng, size, date=b"\x99\x19\x07\x04", right=True, data_size=None):
    body = bytearray(rng.randbytes(size))
    body[0:12] = struct.pack("<II", 1, 5) + date
    body[28:36] = struct.pack("<II", size - 48 if data_size is None else data_size, size)
    body[16:20] = bytes(4)
    total = sum(struct.unpack(f"<{size // 4}I", body)) + (not right)
    body[16:20] = struct.pack("<I", -total & 0xFFFFFFFF)
    return bytes(body)


def one_by_one(raw):
    """Backwards from the end, each place by itself."""
    out, limit = [], len(raw)
    for at in range(len(raw) - 2048, -1, -1):
        if not (1 <= raw[at + 11] <= 0x12 and 1 <= raw[at + 10] <= 0x31):
            continue
        held, total = struct.unpack_from("<II", raw, at + 28)
        size = 2048 if held == 0 else total
        if total & 0x3FF or size < 2048 or at + size > limit or held & 3 or sum(struct.unpack_from(f"<{size // 4}I", raw, at)) & 0xFFFFFFFF:
            continue
        out.append((at, size))
        limit = at
    return out[::-1]


def test_updates_against_one_by_one(spark):
    rng = random.Random(3)
    images = []
    for k in range(40):
        parts = [rng.randbytes(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [update(rng, rng.choice([2048, 3072, 4096]), right=rng.random() < 0.8, data_size=rng.choice([None, None, 0])), bytes(rng.randint(0, 9))]
        images.append((str(k), bytearray(b"".join(parts))))
    images += [("zeros", bytearray(9000)), ("short", bytearray(2047)), ("none", None)]
    got = {}
    for r in O.updates(spark.createDataFrame(images, "path string, content binary")).collect():
        got.setdefault(r.path, []).append((r.place, r.size))
        if r.place + 12 <= 10_000_000 and r.path.isdigit() and bytes(dict(images)[r.path])[r.place + 8 : r.place + 12] == b"\x99\x19\x07\x04":
            assert r.date == "1999-04-07"
    for path, raw in images:
        assert got.get(path, []) == one_by_one(bytes(raw or b"")), path
    assert sum(map(len, got.values())) > 20


def variable(name, value, status=0x7F, wrong=0, owner=bytes(16)):
    names = (name + "\0").encode("utf-16le")
    head = lambda s, c: struct.pack("<2sHIII16sH", b"\xaa\x55", s, 3, len(names), len(value), owner, c)
    plain = head(0x7F, 0) + names + value
    plain += b"\0" * (len(plain) % 2)
    return head(status, -sum(struct.unpack(f"<{len(plain) // 2}H", plain)) + wrong & 0xFFFF) + names + value


def store(*variables, more=0):
    log = b"".join(variables)
    return b"$VSS" + struct.pack("<I8x", 16 + len(log) + more) + log


def test_variables(spark, tmp_path):
    log = [variable("A", b"1"), variable("B", b"\xaa\x55inner\xaa\x55"), variable("A", b"22"), variable("B", b"3", status=0x3F), variable("C", b"444", wrong=1), variable("A", b"5", owner=b"o" * 16)]
    rows = [
        ("one", b"xx" + store(*log) + b"\xff" * 50), ("two", store(log[0], log[2]) + b".." + store(log[2], log[0]) + b"...."), ("cut", store(log[0]) + b"\xff" * 3),
        ("long", store(log[0], more=5000)), ("broken", store(log[0], b"\xaa\x55" + b"\xff" * 60) + b"  "), ("none", b"$VS"), ("many", store(*[variable("N", b"%d" % k) for k in range(100)]) + b"-"),
    ]
    got = {}
    for r in O.variables(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"), str(tmp_path)).orderBy("path", "store", "n").collect():
        got.setdefault(r.path, []).append((r.store, r.n, r.name, bytes(r.value), r.status, r.summed, r.latest))
    assert [g[2:] for g in got["one"]] == [
        ("A", b"1", 0x7F, True, False), ("B", b"\xaa\x55inner\xaa\x55", 0x7F, True, True), ("A", b"22", 0x7F, True, True), ("B", b"3", 0x3F, True, False), ("C", b"444", 0x7F, False, False), ("A", b"5", 0x7F, True, True)]
    assert [g[3:4] + g[6:] for g in got["two"]] == [(b"1", False), (b"22", True), (b"22", False), (b"1", True)] and len({g[0] for g in got["two"]}) == 2
    assert len(got["cut"]) == len(got["broken"]) == 1 and "long" not in got and "none" not in got and len(got["many"]) == 100 and got["many"][-1][6]


def test_last_places_and_flash_tools(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(t, rng.randint(0, 12)) for t in texts], "t string, b int")
    for r in df.select("t", "b", V.last_place(F.col("t"), "ab").alias("x"), V.last_place(F.col("t"), "ab", F.col("b")).alias("y")).collect():
        assert (r.x if r.x is not None else -1) == r.t.rfind("ab") and (r.y if r.y is not None else -1) == r.t[: r.b].rfind("ab")
    tail = bytes(rng.choices(b"xyz", k=32768))
    rows = [
        ("end", b"MZ Micro Firmware, Incorporated * ..." + tail), ("bare", b"MZ" + tail), ("small", b"MZ AOpen FLASH ROM Utility R" + tail[:8192]), ("open", b"MZ Software\\AMI\\AFUWIN _EMBEDDED_ROM_START_\0abc"),
        ("exact", (b"MZ Micro Firmware, Incorporated * " + tail)[:32768]),
    ]
    got = {r.p: r.s for r in spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "p string, c binary").select("p", V.strip_flash_tool(as_latin1(F.col("c"))).alias("s")).collect()}
    assert got == {"end": tail.decode(), "bare": None, "small": None, "open": None, "exact": None}
