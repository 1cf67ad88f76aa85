import os

from siltstone.sources.plain_tree import scan_plain


def test_links_are_not_followed(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    for folder in (root / "a" / "deep", root / "b", outside):
        folder.mkdir(parents=True)
    for path, data in ((root / "top.bin", b"t"), (root / "a" / "one.bin", b"1"), (root / "a" / "deep" / "two.bin", b"22"), (outside / "far.bin", b"f")):
        path.write_bytes(data)
    os.symlink(root / "top.bin", root / "b" / "file link")
    os.symlink(root / "a", root / "b" / "folder link")
    os.symlink(outside, root / "outside link")
    os.symlink(root, root / "a" / "deep" / "loop")
    os.symlink(root / "nothing", root / "b" / "broken link")
    rows = scan_plain(spark, str(root)).collect()
    assert sorted((os.path.relpath(r.path, root), r.size, bytes(r.content)) for r in rows) == [("a/deep/two.bin", 2, b"22"), ("a/one.bin", 1, b"1"), ("top.bin", 1, b"t")]
    assert {(r.folder, r.name) for r in rows} >= {(str(root / "a" / "deep"), "two.bin")}
    assert [r.content for r in scan_plain(spark, str(root), contents=False).filter("name = 'one.bin'").collect()] == [None]
    os.symlink(root, tmp_path / "link to root")
    assert scan_plain(spark, str(tmp_path / "link to root")).count() == 0
