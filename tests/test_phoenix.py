import random
import struct

from pyspark.sql import functions as F

from siltstone.operators import phoenix as P
from siltstone.operators import relations as R

CATEGORY_NAMES = dict(enumerate(P.CATEGORIES))


def frame(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").repartition(2)


def walk(data):
    """The first valid chain of a space's bytes, record by record."""
    at = -1
    while (at := data.find(b"BCPSEGMENT", at + 1)) >= 0:
        place, out, good = at + 10, [], True
        if data[place : place + 3] != b"BCP":
            k = data[place : place + 1024].find(b"BCP")
            if k < 0:
                return []
            place += k
        while data[place : place + 3] == b"BCP":
            head = data[place : place + 10]
            if len(head) != 10 or head[6:9] == b"BCP" or struct.unpack_from("<H", head, 8)[0] < 10:
                good = False
                break
            size = struct.unpack_from("<H", head, 8)[0]
            out.append((at, head[:6].decode("latin-1"), head[6], head[7], place, size))
            place += size
            if data[place : place + 3] != b"BCP":
                k = data[place : place + 256].find(b"BCP")
                if k < 0:
                    break
                place += k
        if good:
            return out
    return []


def record(name, body=b"", major=0, minor=0, size=None):
    return struct.pack("<6sBBH", name, major, minor, 10 + len(body) if size is None else size) + body


def random_image(rng):
    out = bytearray()
    for _ in range(rng.randint(0, 4)):
        out += bytes(rng.choices(b"xyB\xff\xc3", k=rng.randint(0, 300))) + b"BCPSEGMENT" + bytes(rng.choice([0, 0, 5, 1010, 1012, 1014, 1022]))
        for _ in range(rng.randint(0, 9)):
            body = bytes(rng.choices(b"abBC", k=rng.randint(0, 40)))
            out += record(rng.choice([b"BCPSYS", b"BCPIO ", b"BCPCHP", b"BCPBCP"]), body, rng.randint(0, 3), 1, rng.choice([None] * 8 + [3, len(body) + 4, len(body) + 14]))
            out += bytes(rng.choice([0, 0, 0, 1, 100, 252, 253, 254, 256]))
    return bytes(out) + bytes(rng.choice([0, 3, 700]))


def test_chains_against_a_walk(spark, tmp_path):
    rng = random.Random(11)
    images = [(f"i{k}", random_image(rng)) for k in range(150)] + [("none", b""), ("cut", b"xBCPSEGMENTBCPSYS\1"), ("long", b"xBCPSEGMENT" + record(b"BCPIO ") * 300)]
    spaces = P.spaces(frame(spark, images))
    got = {}
    for r in P.chains(spaces, str(tmp_path)).orderBy("path", "n").collect():
        got.setdefault(r.path, []).append((r.segment, r.signature, r.major, r.minor, r.place, r.size))
    broken = 0
    for path, data in images:
        base = P.MEMORY - len(data)
        want = [(s + base, g, a, b, p + base, z) for s, g, a, b, p, z in walk(data)]
        assert got.get(path, []) == want, path
        broken += data.count(b"BCPSEGMENT") > 0 and not want
    assert len(got["long"]) == 300 and broken > 10 and len(got) > 40


def test_footers_and_segments(spark):
    body = bytes(random.Random(1).choices(b"qwert", k=65536))
    rows = frame(spark, [("foot", body + b"BC" + bytes(40)), ("short", body + b"x" * 11), ("kept", body + b"x" * 40), ("big", b"z" * P.MEMORY + body)])
    got = {r.path: (r.base, bytes(r.data)) for r in P.spaces(rows).collect()}
    assert got["foot"] == got["short"] == (P.MEMORY - 65536, body) and got["kept"][1] == body + b"x" * 40
    assert got["big"] == (0, b"z" * (P.MEMORY - 65536) + body)
    rows = spark.createDataFrame([("a", bytearray(bytes(20) + b"end"), [(4, bytearray(b"abcdef")), (6, bytearray(b"XY")), (P.MEMORY - 2, bytearray(b"12345"))]), ("b", bytearray(bytes(20) + b"end"), [])], "path string, content binary, segments array<struct<address:long,data:binary>>")
    got = {r.path: (r.base, bytes(r.data)) for r in P.spaces(rows).collect()}
    assert got["a"][0] == 0 and got["a"][1] == bytes(4) + b"abXYef" + bytes(P.MEMORY - 13) + b"e12" and got["b"] == (P.MEMORY - 23, bytes(20) + b"end")


def table_image(major, minor, tables, segment=None, post=None, extra=b""):
    """64 KB that end the space: tables at 0x100 on, the array at 0x80, the chain at 0x4000."""
    data = bytearray(65536)
    for k, (category, model) in enumerate(tables):
        data[0x80 + 2 * k : 0x82 + 2 * k] = struct.pack("<H", 0x100 + 16 * k)
        data[0x101 + 16 * k : 0x103 + 16 * k] = bytes([model, category << 4])
    body = bytearray(0x80)
    body[0:3] = bytes([4, 6, 0])
    start, end = 0x80, 0x80 + 2 * len(tables)
    if major >= 3:
        body[0x5B:0x61] = struct.pack("<HHH", start, end, 0xF000 if segment is None else segment)
    else:
        body[0x5D:0x61] = struct.pack("<HH", start, end)
    chain = b"BCPSEGMENT" + record(b"BCPSYS", bytes(body), major, minor) + (post or b"") + extra
    data[0x4000 : 0x4000 + len(chain)] = chain
    data[0x3000:0x3010] = b"Identification\0\0"
    return bytes(data)


def test_register_tables(spark, tmp_path):
    post = record(b"BCPOST", struct.pack("<17xH10x", 0x3000), 1, 3)
    gone = record(b"BCPOST", struct.pack("<17xH10x", 0x9000), 1, 3)
    tables = [(0, 7), (1, 200), (5, 3), (0, 7)]
    rows = [
        ("own", table_image(3, 1, tables, 0x1234)), ("named", table_image(3, 2, tables, 0xF000, post)), ("mended", table_image(3, 2, tables, 0x7000, gone)), ("low", table_image(3, 2, tables, 0x0100)),
        ("middle", table_image(1, 5, tables)), ("old", table_image(1, 4, tables)), ("many", table_image(3, 1, [(1, k) for k in range(65)])),
        ("devices", table_image(1, 4, [], extra=record(b"BCPCHP", b"\x09") + record(b"BCPIO ", b"\x08\x01", 1) + record(b"BCPMCD", b"\x07") + record(b"BCPCHP", b"\x06", 1))),
    ]
    spaces = P.spaces(frame(spark, rows))
    records = P.chains(spaces, str(tmp_path))
    got = {}
    for r in P.register_tables(spaces, records).collect():
        got.setdefault(r.path, set()).add((r.category, r.model))
    assert got["own"] == got["named"] == got["low"] == got["middle"] == set(tables)
    assert "old" not in got and "many" not in got and got["devices"] == {(0, 9), (3, 8), (6, 7)}
    models = spark.createDataFrame([(0, 7, "CHIP A"), (5, 3, "CHIP A"), (1, 200, "CHIP B"), (2, 7, "OTHER")], "category int, model int, name string")
    lines = {r.path: r.names for r in R.grouped_names(P.table_names(P.register_tables(spaces, records), models), "path", "category", "name").collect()}
    assert lines["own"] == "CHIP A (Bridge, System)\nCHIP B (Cache)" and "devices" not in lines


def test_builds(spark, tmp_path):
    old = bytearray(0x40)
    old[0:3], old[5:13], old[13:21], old[21:29], old[0x29:0x31] = bytes([4, 1, 0]), b"01/02/93", b"10:11:12", b"00/00/00", b"CODE1\0\0\0"
    new = bytearray(0x40)
    new[0:3], new[5:22], new[0x17:0x28], new[0x2D:0x35] = bytes([4, 6, 0]), b"03/04/97 01:02:03", b"00/00/00 00:00:00", b"CODE2   "
    rows = [("old", b"xBCPSEGMENT" + record(b"BCPSYS", bytes(old), 0, 3)), ("new", b"xBCPSEGMENT" + record(b"BCPSYS", bytes(new), 3, 1)), ("alr", b"xBCPSEGMENT" + record(b"BCPSYS", bytes([5, 10, 3]), 3, 1))]
    records = P.chains(P.spaces(frame(spark, rows)), str(tmp_path))
    got = {r.path: (r.version, r.build) for r in P.builds(records).collect()}
    assert got == {"old": ("4.01", "CODE1\n01/02/93 10:11:12"), "new": ("4.0 Release 6.0", "CODE2\n03/04/97 01:02:03"), "alr": ("4.05", "")}


def test_system_and_board(spark, tmp_path):
    data = bytearray(65536)
    for at, text in ((0x10, b"Maker"), (0x20, b"Model 5 "), (0x30, b"1.0"), (0x40, b"MAKER")):
        data[at : at + len(text) + 1] = text + b"\0"
    dmi = lambda board, system: record(b"BCPDMI", struct.pack("<3H6x3H", *board, *system), 2, 10)
    rows = []
    for name, board, system in (("alike", (0x40, 0x20, 0x30), (0x10, 0x20, 0x30)), ("two", (0x10, 0xFFFF, 0x30), (0x10, 0x20, 0)), ("none", (0, 0, 0), (0xFFFF, 0, 0))):
        chain = b"BCPSEGMENT" + record(b"BCPSYS", bytes(20), 1, 4) + dmi(board, system)
        rows.append((name, bytes(data[:0x4000]) + chain + bytes(65536 - 0x4000 - len(chain))))
    spaces = P.spaces(frame(spark, rows))
    got = {}
    for r in P.dmi_lines(spaces, P.chains(spaces, str(tmp_path))).collect():
        got.setdefault(r.path, []).append(r.line)
    assert got == {"alike": ["[Board/System] MAKER Model 5 1.0"], "two": ["[System] Maker Model 5 ", "[Board] Maker  1.0"]}


def test_pieces_of_ranges_that_lie_over_each_other(spark):
    rng = random.Random(7)
    rows = [(f"g{k % 5}", b := rng.randint(0, 90), b + rng.randint(0, 40), rng.randint(0, 4), f"s{k}") for k in range(60)]
    got = R.overlaid(spark.createDataFrame(rows, "g string, a long, z long, rank int, s string"), "g", "a", "z", "rank", "s").collect()
    cells = {}
    for r in got:
        for x in range(r.begin, r.end):
            assert (r.g, x) not in cells
            cells[r.g, x] = (r.source, r.offset + x - r.begin)
    for g in {r[0] for r in rows}:
        for x in range(140):
            over = [(rank, s, a) for h, a, z, rank, s in rows if h == g and a <= x < z]
            assert cells.get((g, x)) == ((max(over)[1], x - max(over)[2]) if over else None)
    for r in got:  # pieces of one range that touch are one
        assert not any(q.g == r.g and q.source == r.source and q.begin == r.end and q.offset == r.offset + r.end - r.begin for q in got)
