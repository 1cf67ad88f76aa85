"""What the third round's findings named: each test failed before."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from siltstone.llm import simhash
from siltstone.operators import relations as R
from siltstone.operators import unpack as U
from siltstone.plans import catalogue
from siltstone.plans.catalogue import QUERIES
from siltstone.plans.roms import IMAGES


def test_contents_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def make(i):
        made.add(1)
        return b"\0text %d" % i

    files = spark.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.udf(make, BinaryType())("id").alias("content"))
    assert U.unpack(files, str(tmp_path)).count() == 20 and made.value == 20


def test_nothing_is_broadcast_while_unpacking(spark, tmp_path, monkeypatch):
    key, seen, step = "spark.sql.autoBroadcastJoinThreshold", [], U.group_step
    before = spark.conf.get(key)
    monkeypatch.setattr(U, "group_step", lambda *a: (seen.append(spark.conf.get(key)), step(*a))[1])
    U.unpack(spark.createDataFrame([("a", bytearray(b"\0x"))], "path string, content binary"), str(tmp_path)).collect()
    assert set(seen) == {"-1"} and spark.conf.get(key) == before


def names(n, seed, letters="ab12é"):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3, None]), "".join(rng.choice(letters) for _ in range(rng.randrange(6)))) for _ in range(n)]


def prefix(a, b):
    return len(os.path.commonprefix([a, b]))


@pytest.mark.parametrize("seed", range(3))
def test_closest_by_sorted_names(spark, seed):
    """Against all pairs; no row is taken apart into its prefixes."""
    bases, cands = names(60, seed) + [(4, "a"), (5, "b")], names(12 + 20 * seed, seed + 9) + [(4, "xyz")]
    left, right = spark.createDataFrame(bases, "g int, base string"), spark.createDataFrame(cands, "g int, name string")
    near, shortened = {}, {}
    for g, b in {x for x in bases if x[0]}:
        own = sorted({c for k, c in cands if k == g})
        alike = [c for c in own if c[:1] == b[:1]]
        if alike:
            near[g, b] = min((-prefix(b, c), c) for c in alike)[::-1]
        if len(own) == 1:
            shortened[g, b] = own[0]
            continue
        left_over = [x for k in range(len(b), 0 if b else -1, -1) if len(x := [c for c in own if c.startswith(b[:k]) and (b or not c)]) == 1]
        digits = lambda x: x[: next((k for k, c in enumerate(x) if not c.isdigit()), len(x))]
        if left_over:
            shortened[g, b] = left_over[0][0]
        elif alike:
            shortened[g, b] = min(alike, key=lambda c: (abs(int(digits(c) or 0) - int(digits(b) or 0)), c[len(digits(c)) :], c))
    got = R.closest_name(left, right, "g", "base", "name")
    assert {(r.g, r.base): (r.name, -r.shared) for r in got.collect()} == near
    got = R.closest_prefix(left, right, "g", "base", "name")
    assert {(r.g, r.base): r.name for r in got.collect()} == shortened
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["payloads", "flash_tools", "rom_names", "rom_vendors"])
def test_packed_tables_are_dealt_to_tasks(spark, sf, name):
    """A table of one row group is no single task's work."""
    got = QUERIES[name](spark, sf)
    if name == "flash_tools":  # of its written tables
        assert all(r.n > 0 for r in got.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect())
        assert len(got.inputFiles()) > 3
    else:
        assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()


def test_images_behind_texts_of_any_length(spark, tmp_path):
    """Null texts, and lengths at which the end of an image of 64 KB looks like a footer."""
    names = [name for name, *_ in IMAGES]
    old, award = names.index("phoenix old"), names.index("award")
    lengths = [65_516, 49_116, 49_084, 65_501, 32_764]
    rows = [(k * len(IMAGES) + old, "w" * n) for k, n in enumerate(lengths)] + [(9 * len(IMAGES) + award, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.vendor, r.version, r.string, r.signon, r.metadata) for r in QUERIES["rom_vendors"](spark, str(tmp_path)).collect()}
    assert got == {i: IMAGES[i % len(IMAGES)][3] for i, _ in rows}


def test_images_leave_python_in_small_frames(spark, sf):
    """However large the batches are that come in."""
    assert catalogue.IMAGES_AT_ONCE * 8192 <= 4 << 20
    got = catalogue.chained_images(spark, sf)
    want = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    tables = [[((i + k) % 8, (i * 7 + k * 31) % 256) for k in range(i % 4 + 1)] for i in want["doc_id"]]
    want = dict(zip(want["doc_id"].astype(str), catalogue.chained(want["doc_id"], want["text"], tables)))
    assert {r.path: bytes(r.content) for r in got.collect()} == want


def test_one_of_each_goes_by_fingerprints_too(spark):
    """Texts whose fingerprints are close are one class, whatever their sets of shingles: a line that repeats outweighs the rest."""
    line = " ".join(f"w{k}" for k in range(7))
    texts = [" ".join([line] * 40 + [f"a{n}x{k}" for k in range(12)]) for n in range(2)] + [" ".join(f"c{k}" for k in range(90))]
    bits = [simhash.text_fingerprint(t) for t in texts]
    close = (bits[0] ^ bits[1]).bit_count() <= simhash.DISTANCE
    sets = [simhash.distinct(simhash.shingle_hashes(t, (5,))[0]) for t in texts]
    assert close and len(set(sets[0]) & set(sets[1])) < 0.8 * len(set(sets[0]) | set(sets[1]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [0, 2]
    want = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert want == {0, 2}
