"""A generation of unpacking looks at no more of an artifact, and makes no more of it, than it must."""

import lzma
import random
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from siltstone.functions.scalar import bind
from siltstone.operators import carve as V
from siltstone.operators import classify as C
from siltstone.operators import groups as G
from siltstone.operators import unpack as U
from siltstone.plans import catalogue

HEAD = C.HEAD_BYTES


def contents():
    """Heads of all kinds, with marks within, across and behind what is looked at."""
    rng = random.Random(3)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    prose = b"\0" + b"some words of an invented text, and more of them. " * 9
    out = [b"", b"x", b"MZ", b"M", prose, prose[1:], noise(700), b":" + b"0A" * 300 + b"\r\n", b":0A0A0A0A0A\n", b":" + b"0A" * 300, b"-" * 400 + b"[ AIDA32 ", b"-[ AIDA32 ", b"-" * HEAD + b"[ AIDA32 "]
    out += [b"\r\n" + b" " * 500 + b"HWiNFO v", b"\r\n" + b" " * 500 + b"\r\n \r\n Microsoft Diagnostics version ", b"SIV" + b"x" * 500 + b" - System Information Viewer V", b"SIV - System"]
    out += [b"\x7fELF" + noise(124) + b"ELFBoot\0" + noise(300), b"\x7fELF" + noise(400), b"<!DocType html", b"<HTMLx", b" \t\r\n\f  File:   A", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"UID,Name,Score,"]
    out += [noise(257) + b"ustar" + noise(90), noise(256) + b"ustar", noise(258) + b"ustar" + noise(90), b"PK\3\4", b"\xfd7zXZ\0" + noise(9), b"MSCF", b"ISc(", b"7z\xbc\xaf\x27\x1c"]
    for mark in U.STRIP_MARKS:
        out += [noise(k) + mark.encode() + noise(40) for k in (0, 5, 283, 300, HEAD - len(mark), HEAD - len(mark) + 1, HEAD)]
    out += [b"\xc3SNIPAC0A\xff\xff\xff\x7f", b"SNIPACxx", b"\xe9SNIPA\xc3", b"SNIPAC0A\x10\0\0\0" * 3]
    out += [noise(112) + b"\1" + noise(4) + b"A" * 32 + noise(14) + b"B" * 8, noise(113) + noise(4) + b"A" * 32 + noise(14) + b"B" * 7, noise(111) + b"A" * 32]
    return out


def test_heads_are_told_by_their_first_bytes(spark):
    df = spark.createDataFrame([(bytearray(c),) for c in contents()] + [(None,)], "c binary")
    content = F.col("c")
    head = C.as_latin1(F.substring("c", 1, HEAD))
    whole = bind(C.as_latin1(content), lambda t: F.coalesce(*[strip(t) for _, strip in U.STRIPS]))
    marked = reduce(lambda a, m: a | head.contains(m), U.STRIP_MARKS, head.startswith("MZ")) | head.rlike(V.OMF_HEAD) | head.rlike(V.OMF_HEAD.replace("^", "^.{112}"))
    runs = bind(C.as_latin1(content), lambda t: V.runs_size(t))
    pairs = {
        "discarded": (C.begins(content, C.DISCARD, C.DISCARD_LONGER), head.rlike(C.DISCARD)),
        "box": (C.begins(content, U.CONTAINER, (b":",)), head.rlike(U.CONTAINER)),
        "stripped": (U.stripped(content), F.when(marked, F.encode(whole, "ISO-8859-1"))),
        "over": (U.over_limits(content), F.when(head.rlike(V.RUN_MARK), F.when(runs > V.RUNS_MOST, U.TOO_LARGE))),
    }
    for name, (got, want) in pairs.items():
        rows = df.select("c", got.alias("got"), want.alias("want")).collect()
        assert all(r.got == r.want for r in rows), name
        assert sum(r.got not in (None, False) for r in rows) > 0, name


def test_shares_are_sought_in_bytes(spark, tmp_path, monkeypatch):
    """As in texts of one character a byte, which are not made."""
    rng, plans, write = random.Random(5), [], G.write
    shown = [t[k::n].encode() for t in G.WOVEN_TEXTS for n, k in G.SHARES]
    files = [(f"f{i}", bytes(rng.randrange(256) for _ in range(40)) + s + b"\xff" * (60 - len(s)) + t) for i, (s, t) in enumerate(zip(shown, rng.sample(shown, len(shown))))]
    files = [(p, c[:100].ljust(100, b".")) for p, c in files] + [("far1", b"." * G.PROBE + shown[0]), ("far2", b"." * (G.PROBE - 1) + shown[1] + b"." * (1 + len(shown[0]) - len(shown[1])))]
    now = spark.createDataFrame([(p, None, 0, bytearray(c)) for p, c in files], U.SCHEMA.replace(", event string", ""))
    monkeypatch.setattr(G, "write", lambda df, folder: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, folder))[1])
    got = {r.path: r.shares for r in G.shown_shares(now, G.facts(now), str(tmp_path)).collect()}
    want = {p: [k for k, (n, j) in enumerate(G.SHARES) if any(t[j::n] in c[: G.PROBE].decode("latin-1") for t in G.WOVEN_TEXTS)] for p, c in files}
    assert got == want and sum(map(bool, want.values())) >= len(shown)
    assert not any(f"1, {G.PROBE}), ISO-8859-1" in p for p in plans)


def test_windows_of_streams_fit_their_texts():
    """A stream of a short text asks for no window of megabytes, and is as long as it was."""
    texts = ["", "text", "words of a text " * 5000]
    for text, packed in zip(texts, catalogue.nested.func(pd.Series([2] * 3), pd.Series(texts))):
        inside = lzma.decompress(packed, memlimit=1 << 20)
        assert len(packed) == len(lzma.compress(inside))


def test_what_is_no_container_is_read_once(spark, tmp_path):
    """One pass gives the members of a directory, itself, payloads and what is left as it is."""
    entry = lambda name, size: bytes(10) + size.to_bytes(2, "little") + bytes(5) + name.ljust(8, b"\0") + b"BIN" + bytes(4)
    ros = b"ROS".ljust(32, b"\0") + entry(b"ONE", 3)
    rows = [("a", None, 0, bytearray(b"\0x")), ("b", "p", 1, bytearray(ros)), ("c", "q", 2, bytearray(b"SNIPAC00" + b"\xff\xff\xff\x7f" + b"x"))]
    spark.createDataFrame(rows, U.SCHEMA.replace(", event string", "")).write.parquet(f"{tmp_path}/in")
    now = spark.read.parquet(f"{tmp_path}/in")
    got = U.without_boxes(now)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    content, kept = F.col("content"), now.withColumn("_list", U.listing(F.col("content")))
    listed = {r.path: r["_list"] for r in kept.filter("_list is not null").collect()}
    payload = {r.path: r.p for r in now.select("path", U.stripped(content).alias("p")).collect() if r.p is not None}
    over = {r.path: r.o for r in now.select("path", U.over_limits(content).alias("o")).collect()}
    assert set(listed) == {"b"}
    want = [(f"b:/{m.name}", "b", 2, bytes(rows[1][3])[m.begin : m.begin + m.size], None) for m in listed["b"].members]
    event = U.WRONG_LENGTH if listed["b"].wrong else "listed" if listed["b"].members else "empty directory"
    want.append((*rows[1][:3], bytes(rows[1][3]), event))
    want += [(f"{p}:/payload", p, d + 1, payload[p], None) if p in payload else (p, q, d, bytes(c), over[p] or "leaf") for p, q, d, c in (rows[0], rows[2])]
    assert sorted(map(str, (tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got.collect()))) == sorted(map(str, want))
