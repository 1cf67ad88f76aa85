import random
import struct

from pyspark.sql import functions as F

from siltstone.operators import groups as G
from siltstone.operators import unpack as U
from siltstone.sources.files import COMBINED, HEADER

FILES = "path string, content binary"


def unpacked(spark, tmp_path, files, **kw):
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], FILES).repartition(3)
    rows = U.unpack(df, str(tmp_path), **kw).collect()
    return {r.path: (None if r.content is None else bytes(r.content), r.event, r.depth, r.parent) for r in rows}


def text_image(n, seed=1):
    data = bytearray(random.Random(seed).randbytes(n)).replace(b"\0", b"\1")
    data[40:40] = b"  ALL RIGHTS RESERVED  "
    return bytes(data[:n])


def test_interleaved_pairs_and_quads(spark, tmp_path):
    pair, quad = text_image(4096), text_image(8192, 2)
    files = [("a/u1.bin", pair[::2]), ("a/u2.bin", pair[1::2]), ("a/stray.bin", bytes(2048))]
    files += [(f"b/rom{k}.bin", quad[k::4]) for k in range(4)]
    files += [("c/lone.bin", pair[::2]), ("d/u1.bin", pair[::2]), ("d/u2.bin", pair[1::2] + b"x")]
    got = unpacked(spark, tmp_path, files)
    assert got["a/u1.bin:/deinterleaved_01.bin"][0] == pair and got["a/u1.bin:/deinterleaved_10.bin"][0][::2] == pair[1::2]
    images = [c for p, (c, *_) in got.items() if p.startswith("b/rom0.bin:/deinterleaved_")]
    assert len(images) == 24 == len(set(images)) and quad in images
    assert {got[f"b/rom0.bin:/interleaved_{k}.bin"][0] for k in range(4)} == {quad[k::4] for k in range(4)}
    assert got[f"a/u1.bin:/{COMBINED}"][:3] == (b"\0\0", "leaf", 1) and len(got[f"b/rom0.bin:/{COMBINED}"][0]) == 4
    assert {"a/stray.bin", "c/lone.bin", "d/u1.bin", "d/u2.bin"} <= set(got) and "a/u2.bin" not in got and "b/rom3.bin" not in got


def test_two_pairs_by_the_closest_names_in_a_container(spark, tmp_path):
    import io
    import zipfile

    one, two, raw = text_image(2048), text_image(2048, 3), io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, data in (("x-even.bin", one[::2]), ("x-odd.bin", one[1::2]), ("y-even.bin", two[::2]), ("y-odd.bin", two[1::2])):
            z.writestr(f"sub/{name}", data)
    got = unpacked(spark, tmp_path, [("box.zip", raw.getvalue())])
    assert got["box.zip:/sub/x-even.bin:/deinterleaved_01.bin"][0] == one and got["box.zip:/sub/y-even.bin:/deinterleaved_01.bin"][0] == two
    assert len(got) == 2 * (2 + 2 + 1)


def test_tails(spark, tmp_path):
    rng = random.Random(8)
    head, tail, other = rng.randbytes(262144 - 16384), rng.randbytes(16384), rng.randbytes(16384)
    flasher = [("AFLASH.EXE", b"MZ"), ("cnv.exe", b"MZ"), ("b.bat", b"aflash")]
    files = [("t/ABC1.BIN", head), ("t/abc1.tl", tail), ("t/zzz9.tl", other)] + [(f"t/{n}", c) for n, c in flasher]
    files += [("n/ABC1.BIN", head), ("n/abc1.tl", tail)]
    got = unpacked(spark, tmp_path, files)
    assert got["t/ABC1.BIN:/abc1.tl"][0] == head + tail and f"t/ABC1.BIN:/{HEADER}" in got
    assert "t/zzz9.tl" in got and "t/abc1.tl" not in got and {"n/ABC1.BIN", "n/abc1.tl"} <= set(got)


def nearest_by_hand(bases, candidates):
    """What rounds of the closest name give, one base after the other."""

    def closest(base, names):
        left = list(names)
        k = len(base)
        while len(left) != 1 and k > 0:
            left = [c for c in names if c[:k] == base[:k]]
            k -= 1
        return left

    out, bases, candidates = {}, set(bases), set(candidates)
    while True:
        picks = {}
        for b in sorted(bases):
            found = closest(b, sorted(candidates))
            if len(found) == 1:
                picks.setdefault(found[0], b)
        if not picks:
            return out
        for c, b in picks.items():
            out[b] = c
        bases -= set(picks.values())
        candidates -= set(picks)


def test_no_candidate_goes_to_two(spark, tmp_path):
    bases = ["m10x", "m10y", "m20", "k1"]
    candidates = ["m10z", "m20a", "k1b", "k2"]
    frame = lambda names, c: spark.createDataFrame([("g", n) for n in names], f"g string, {c} string").repartition(3)
    got = {r.base: r.name for r in G.assigned(frame(bases, "base"), frame(candidates, "name"), str(tmp_path)).collect()}
    assert len(set(got.values())) == len(got) == 4
    want = nearest_by_hand(bases, candidates)
    assert {b: c for b, c in got.items() if b in want} == want
    again = {r.base: r.name for r in G.assigned(frame(bases[::-1], "base"), frame(candidates[::-1], "name"), str(tmp_path)).collect()}
    assert again == got


def test_claims_are_granted_as_in_order(spark, tmp_path):
    rng = random.Random(4)
    for _ in range(3):
        claims = [(f"c{k:03}", rng.randint(0, 2), j, p) for k in range(60) for j, p in enumerate(rng.sample([f"p{x}" for x in range(70)], rng.randint(1, 4)))]
        kinds = {}
        claims = [(c, kinds.setdefault(c, kind), j, p) for c, kind, j, p in claims]
        taken, want = set(), set()
        for kind, c in sorted({(kind, c) for c, kind, _, _ in claims}):
            own = {p for d, _, _, p in claims if d == c}
            if not own & taken:
                taken |= own
                want.add(c)
        rng.shuffle(claims)
        got = G.granted(spark.createDataFrame(claims, "claim string, kind int, k int, path string"), str(tmp_path)).collect()
        assert {r.claim for r in got} == want and len({r.path for r in got}) == len(got)


def part(area, dest, body, last=0, version=b"V" * 20, area_size=0, length=None):
    head = bytearray(160 if len(version) > 14 else 128)
    head[32:37] = struct.pack("<BI", area, area_size)
    head[80:95] = struct.pack("<IIBB", dest, len(body) if length is None else length, 0, last) + b"FLASH"
    head[112 : 112 + len(version)] = version
    return bytes(head) + body


def test_update_parts(spark, tmp_path):
    rng = random.Random(2)
    a, b, c, boot = (rng.randbytes(65536) for _ in range(4))
    files = [("s/X.BIO", part(1, 0, a)), ("s/X.BI1", part(1, 65536, b)), ("s/X.BI2", part(1, 131072, c)), ("s/x.bbo", part(0, 0, boot, area_size=262144))]
    files += [("s/help.lng", b"nothing"), ("s/readme.txt", b"text")]
    # a short version swaps the halves; the middle part lacks
    files += [("i/y.bio", part(1, 0, a, version=b"1.00")), ("i/y.bi2", part(1, 131072, c, version=b"1.00"))]
    # an odd size is filled up in front, and a huge place is refused
    files += [("o/z.bio", part(1, 0, a[:50000], last=0xFF)), ("h/w.bio", part(1, 0xF0000000, a)), ("h/w.bi1", part(1, 0, a))]
    got = unpacked(spark, tmp_path, files)
    assert got["s/X.BIO:/intel.bin"][0] == a + b + c + boot
    assert got[f"s/X.BIO:/{HEADER}"][0] == files[0][1][:160] and "s/readme.txt" in got and "s/help.lng" not in got and "s/x.bbo" not in got
    image = got["i/y.bio:/intel.bin"][0]
    assert len(image) == 262144 and image[65536:131072] == a and image[196608:] == c and image[:65536] == bytes(65536)
    image = got["o/z.bio:/intel.bin"][0]
    assert len(image) & (len(image) - 1) == 0 and a[:50000] in image
    assert got["h/w.bio"][1] == got["h/w.bi1"][1] == G.SET_TOO_LARGE


def test_closest_other_is_that_of_shortening(spark):
    rng = random.Random(6)
    for _ in range(4):
        names = sorted({"".join(rng.choices("ab1", k=rng.randint(1, 6))) for _ in range(12)})
        bases = [(b, [b, *rng.sample(names, rng.randint(0, 3))]) for b in sorted(set(names[::2]) | {"ab", "b1b"})]
        frame = spark.createDataFrame([("g", b, w) for b, w in bases], "g string, base string, without array<string>")
        got = {r.base: r.name for r in G.closest_other(frame, spark.createDataFrame([("g", n) for n in names], "g string, name string")).collect()}
        for b, without in bases:
            others = [n for n in names if n not in without]
            for k in range(len(b), -1, -1):
                left = [n for n in others if n[:k] == b[:k]]
                if len(left) == 1:
                    assert got[b] == left[0]
                    break
            else:
                assert got[b] == next((n for n in others if n > b), others[-1])


def test_parts_that_show_several_shares(spark, tmp_path):
    """Texts at all alignments: every part shows every share."""
    body = b"".join(bytes(k) + b"ALL RIGHTS RESERVED" + bytes(64 - 19 - k) for k in range(4)) + bytes(256)
    got = unpacked(spark, tmp_path, [(f"q/r{k}.bin", body[k::4]) for k in range(4)])
    assert body in [c for p, (c, *_) in got.items() if "deinterleaved" in p] and len(got) == 29
