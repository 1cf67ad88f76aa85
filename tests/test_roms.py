from pyspark.sql import functions as F

from siltstone.operators import classify as C
from siltstone.plans.roms import IMAGES


def test_every_image(spark):
    rows = [(n, bytearray(h) if h is not None else None, bytearray(b)) for n, h, b, _ in IMAGES]
    df = spark.createDataFrame(rows, "name string, header binary, content binary")
    got = {r["name"]: r["finding"] for r in C.classify(df, C.as_latin1(F.col("content")), header=F.col("header")).collect()}
    bad = []
    for name, _, _, want in IMAGES:
        f = got[name]
        found = f and (f["vendor"], f["version"], f["string"] or "", f["signon"] or "", "\n".join(f["metadata"]))
        if found != want:
            bad.append((name, found, want))
    assert not bad, "\n".join(map(str, bad))


def test_every_rule_has_an_image(spark):
    rows = [(bytearray(h) if h is not None else None, bytearray(b)) for _, h, b, _ in IMAGES]
    found = C.classify(spark.createDataFrame(rows, "h binary, c binary"), C.as_latin1(F.col("c")), header=F.col("h"))
    # Whizpro reads from an end of its own; see the features of an image with one
    assert {r.priority for r in C.RULES} - {r[0] for r in found.select("finding.priority").collect()} == {39}


def test_whizpro(spark):
    image = bytearray(4096)
    image[100:115] = b"$PREPOST$BOOTBL"
    image[114:123] = b"$BOOTBLK\0"
    image[4096 - 11 : 4096 - 3] = b"1.23\0abc"
    image[4096 - 1024 - 0x30 :][:0] = b""
    image[4096 - (1024 + 0x30) : 4096 - (1024 + 0x30) + 5] = b"text\0"
    image[4096 - (1024 + 0x110) : 4096 - (1024 + 0x110) + 5] = b"sign\0"
    f = C.classify(spark.createDataFrame([(image,)], "c binary"), C.as_latin1(F.col("c"))).first()["finding"]
    assert (f["vendor"], f["version"], f["string"], f["signon"]) == ("Whizpro", "1.23", "text", "sign")


def test_marks_change_no_finding(spark, sf):
    """The rules without their plain texts find the same, in every image alone and behind a document."""
    from dataclasses import replace

    images = spark.createDataFrame([(bytearray(h) if h is not None else None, bytearray(b)) for _, h, b, _ in IMAGES], "h binary, c binary")
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit(None).cast("binary").alias("h"), F.encode("text", "UTF-8").alias("c"))
    behind = images.join(texts.limit(3).select(F.col("c").alias("t")), how="cross").select("h", F.concat("t", "c").alias("c"))
    rows = images.unionByName(texts).unionByName(behind)
    bare = [replace(r, marks=()) for r in C.RULES]
    one, two = (C.classify(rows, C.as_latin1(F.col("c")), rules, header=F.col("h")).select(F.md5("c").alias("k"), "h", "finding.*") for rules in (C.RULES, bare))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
