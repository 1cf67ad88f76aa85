"""What the fourth round's findings named: each test failed before."""

import io
import os
import random
import zipfile
from itertools import permutations

import pytest

from siltstone.operators import groups as G
from siltstone.operators import unpack as U
from siltstone.plans.catalogue import QUERIES
from siltstone.plans.roms import IMAGES

MARK = G.WOVEN_TEXTS[0].encode()


def frame(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def parts(folder, whole, n):
    return [(f"{folder}/p{k}.bin", whole[k::n]) for k in range(n)]


def orders(ours):
    """All that a set's parts make, by name."""
    out = {f"interleaved_{k}.bin": c for k, c in enumerate(ours)}
    for order in permutations(range(len(ours))):
        whole = bytearray(sum(map(len, ours)))
        for k, which in enumerate(order):
            whole[k :: len(ours)] = ours[which]
        out["deinterleaved_" + "".join(map(str, order)) + ".bin"] = bytes(whole)
    return out


def test_orders_of_interleaved_images_are_not_written(spark, tmp_path):
    """What is on disk stays in proportion to the parts, of which 24 orders are made."""
    rng = random.Random(4)
    wholes = {f"d{k}": MARK + rng.randbytes(40_002 - len(MARK)) + bytes(2) for k in range(4)}
    rows = [r for d, whole in wholes.items() for r in parts(d, whole, 4)]
    got = {r.path: (bytes(r.content), r.parent, r.depth, r.event) for r in U.unpack(frame(spark, rows), str(tmp_path)).collect()}
    want = {f"{d}/p0.bin:/{name}": (c, f"{d}/p0.bin", 1, "leaf") for d, whole in wholes.items() for name, c in orders([whole[k::4] for k in range(4)]).items()}
    marks = {f"{d}/p0.bin:/{G.COMBINED}": (bytes(4), f"{d}/p0.bin", 1, "leaf") for d in wholes}
    assert got == want | marks
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names)
    assert size < 4 * sum(len(c) for _, c in rows)


@pytest.mark.parametrize("depth", [0, 3])
def test_images_that_are_containers_are_opened(spark, tmp_path, depth):
    """Of the orders of an image those that are containers are opened, and files of no use dropped; both as they are read."""
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("m", b"\0" + MARK)
    zipped = inner.getvalue() + bytes(-len(inner.getvalue()) % 2)
    picture = b"BM" + bytes(6) + MARK + bytes(-len(MARK) % 2)
    made = [f"{d}/p0.bin:/{name}" for d, whole in (("z", zipped), ("b", picture)) for name in orders([whole[k::2] for k in range(2)])]
    made += [f"{d}/p0.bin:/{G.COMBINED}" for d in "zb"]
    got = {r.path: r for r in U.unpack(frame(spark, parts("z", zipped, 2) + parts("b", picture, 2)), str(tmp_path), depth=depth).collect()}
    image = "z/p0.bin:/deinterleaved_01.bin"
    if not depth:
        assert set(got) == set(made) and {r.event for r in got.values()} == {"too deep"} and bytes(got[image].content) == zipped
        return
    assert set(got) == {*made, f"{image}:/m"} - {image, "b/p0.bin:/deinterleaved_01.bin"}
    assert bytes(got[f"{image}:/m"].content) == b"\0" + MARK and got[f"{image}:/m"].depth == 2
    assert {r.event for r in got.values()} == {"leaf"}


def test_an_image_with_a_far_sign_on_behind_long_texts(spark, tmp_path):
    """Texts longer than the way from its mark back to its sign-on, which is none of the text."""
    power = [name for name, *_ in IMAGES].index("power")
    rows = [(k * len(IMAGES) + power, "w" * n) for k, n in enumerate([57_300, 57_340, 57_400, 65_500, 122_698])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.vendor, r.version, r.string, r.signon, r.metadata) for r in QUERIES["rom_vendors"](spark, str(tmp_path)).collect()}
    assert got == {i: IMAGES[power][3] for i, _ in rows}
