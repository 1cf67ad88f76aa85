from siltstone.operators import analyze as A
from siltstone.operators import unpack as U
from siltstone.plans.catalogue import device_table, rom
from siltstone.sources import files


def test_tree(spark, tmp_path):
    root = tmp_path / "roms"
    both = root / "0" / "board.zip:"
    for d in (root, both, root / "plain"):
        d.mkdir(parents=True, exist_ok=True)
    (root / "one.bin").write_bytes(b"NOT COPR. IBM 1984 BIOS VERSION 3.61\0" + rom(4, pci=(0x9004, [0x5078])))
    (root / "rom only.bin").write_bytes(rom(4, pci=(0x10DE, [0x21])) + b"FACP\x74\0\0\0" + b"x" * 20 + b"MSFT")
    (root / "nothing.txt").write_bytes(b"some text")
    (both / files.COMBINED).write_bytes(b"12")
    (both / "original.tm1").write_bytes(b"VERSION 9\0")
    (both / "original.tmp").write_bytes(b"NOT COPR. IBM 1984 BIOS ")
    (both / "amipci_10DE_0020.rom").write_bytes(b"raw")
    (root / "plain" / files.HEADER).write_bytes(b"\0\xffUEFIExtract\xff\0")
    (root / "plain" / "image").write_bytes(b"InsydeH2O Version 3\t")
    got = {r.file: r.asDict() for r in A.analyze(spark, str(root), device_table(spark)).collect()}
    assert got.keys() == {"one.bin", "rom only.bin", "board.zip", "plain/image"}
    assert (got["one.bin"]["vendor"], got["one.bin"]["version"], got["one.bin"]["roms"]) == ("Tandon", "3.61", "[9004:5078] Adaptec 7850")
    assert got["rom only.bin"] == {"file": "rom only.bin", "vendor": "", "version": "", "string": "", "signon": "", "metadata": "", "roms": "[10de:0021] NVIDIA Riva FE"}
    assert (got["board.zip"]["version"], got["board.zip"]["metadata"], got["board.zip"]["roms"]) == ("9", "[ROM] Interleaved", "[10de:0020] NVIDIA Riva FE GPU")
    assert (got["plain/image"]["vendor"], got["plain/image"]["metadata"]) == ("Insyde", "[UEFI] Filesystem")


def test_members_over_a_limit(spark, tmp_path, monkeypatch):
    import gzip
    import io
    import zipfile

    monkeypatch.setattr(U, "MEMBER_BYTES", 100)
    monkeypatch.setattr(U, "MEMBERS", 3)

    def zipped(*sizes):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, n in enumerate(sizes):
                z.writestr(f"m{k}", b"x" * n)
        return out.getvalue()

    assert list(U.opened("p", None, 0, zipped(10, 200))) == [("p:/m0", "p", 1, b"x" * 10, None), ("p:/m1", "p", 1, None, U.TOO_LARGE), ("p", None, 0, zipped(10, 200), U.TOO_LARGE)]
    rows = list(U.opened("p", None, 0, zipped(1, 2, 3, 4, 5)))
    assert [r[0] for r in rows] == ["p:/m0", "p:/m1", "p:/m2", "p"] and rows[-1][4] == U.TOO_MANY
    big = gzip.compress(b"y" * 101)
    assert list(U.opened("g", None, 0, big)) == [("g:/content", "g", 1, None, U.TOO_LARGE), ("g", None, 0, big, U.TOO_LARGE)]
    assert list(U.opened("g", None, 0, gzip.compress(b"y" * 100))) == [("g:/content", "g", 1, b"y" * 100, None)]


def test_pci_tables(spark, tmp_path):
    (tmp_path / "pci.ids").write_text("# x\n0001  One\n\t0002  Two\n\t\t0003 0004  Sub\n00ab  Vendor B\nC 01  Class\n\t00  Sub class\n\t\t02  Face\n\t01  Other\n")
    path = f"{tmp_path}/pci.ids"
    assert [tuple(r) for r in files.pci_subsystems(spark, path).collect()] == [(1, 2, 3, 4, "Sub")]
    assert [tuple(r) for r in files.pci_classes(spark, path).collect()] == [(1, None, None, "Class"), (1, 0, None, "Sub class"), (1, 0, 2, "Face"), (1, 1, None, "Other")]


def test_long_streams(spark):
    import zlib

    from siltstone.operators import carve as V

    noise = bytes(range(256)) * 20_000
    data = zlib.compress(noise + b"the needle" + noise)
    assert V.decoded(memoryview(data), "zlib15", b"the needle") == (2 * len(noise) + 10, True)
    assert V.decoded(memoryview(data[: len(data) // 3]), "zlib15", b"the needle")[1] is False


def test_levels_of_unpacking_are_peeled(spark):
    paths = ["a.zip:/b.bin:/c", "a.zip:/b.bin:", "a.zip:/x", "file:/r/a.zip:/b.bin:/d.rom:/e", "plain/x", "z.zip:/y:/q"]
    marks = ["a.zip:/b.bin:", "file:/r/a.zip:/b.bin:", "file:/r/a.zip:/b.bin:/d.rom:", "z.zip:", "z.zip:/y:"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.shown for r in A.peeled(frame, spark.createDataFrame([(m,) for m in marks], "folder string")).collect()}
    assert got == {"a.zip:/b.bin:/c": "a.zip:/b.bin", "a.zip:/b.bin:": "a.zip:/b.bin:", "a.zip:/x": "a.zip:/x", "file:/r/a.zip:/b.bin:/d.rom:/e": "file:/r/a.zip:/b.bin", "plain/x": "plain/x", "z.zip:/y:/q": "z.zip"}


def test_partitions_and_recovery_files_are_unpacked(spark, tmp_path):
    import struct

    boot = bytearray(b"Missing operating system".ljust(512, b"."))
    boot[446:510] = bytes(64)
    boot[446:462] = struct.pack("<4xB3xII", 6, 1, 2)
    boot[478:494] = struct.pack("<4xB3xII", 1, 9, 2)
    boot[510:] = b"\x55\xaa"
    rows = [("disk", bytes(boot) + b"\1" * 1024), ("silent", bytes(boot).replace(b"Missing", b"missing") + b"\1" * 1024), ("rec", b"head @(#)Apricot X" + b"\2" * 8192), ("long", b"@(#)Apricot ".ljust(5000, b"h") + b"\2" * 8192)]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.path: (r.event, bytes(r.content)) for r in U.unpack(df, str(tmp_path), sets=False).collect()}
    assert got["disk:/partition0"] == ("leaf", b"\1" * 1024) and got["disk"][0] == U.WRONG_LENGTH and got["silent"][0] == "leaf"
    assert got["rec:/payload"] == ("leaf", b"\2" * 8192) and got["long"][0] == "leaf" and len(got) == 5
