import zlib
from collections import Counter

from pyspark.sql import functions as F

from siltstone.llm import sharding


def test_law_and_mixture(documents):
    rows = sharding.interleave_shards(documents, 40).collect()
    texts = {r.doc_id: r for r in documents.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        t = texts[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.stratum) == (len(t) + 16, zlib.crc32(t), texts[r.doc_id].source)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = Counter(r.stratum for r in rows)
    for shard, n in sizes.items():
        mix = Counter(r.stratum for r in rows if r.shard == shard)
        assert all(abs(mix[s] - share[s] * n / len(rows)) < 2.01 for s in share)


def test_against_brute_force(spark):
    """The order of all rows, ranked one by one, cut into shards; some strata have one row each."""
    rows = [(k, f"text {k % 37}" if k % 11 else None, f"s{k % 3}" if k % 4 else f"only{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keyed = df.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"))
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(17), "doc_id", "crc", "size")).withColumn("u", F.pmod(F.xxhash64(F.lit(17), F.concat(F.lit("="), "source")), F.lit(sharding.PHASES)))
    strata = {}
    for r in keyed.collect():
        strata.setdefault(r.source, []).append((r.h, r.doc_id, (r.u + 0.5) / sharding.PHASES))
    order = sorted(((k + 1 - u) / len(v), f"={s}", h, i) for s, v in strata.items() for k, (h, i, u) in enumerate(sorted(v)))
    want, at = {}, 0
    for shard in range(7):
        end = -(-(shard + 1) * len(order) // 7)
        want |= {i: (shard, k) for k, (*_, i) in enumerate(order[at:end])}
        at = end
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave_shards(df, 7).collect()} == want


def test_seed_and_repeat(documents):
    a, b, c = (sorted(map(tuple, sharding.interleave_shards(documents, 7, seed=s).collect())) for s in (1, 1, 2))
    assert a == b and a != c


def test_odd_rows(odd, empty):
    rows = sharding.interleave_shards(odd, 3).collect()
    assert len(rows) == odd.count() and sorted(Counter(r.shard for r in rows).values()) == [3, 4, 4]
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert sharding.interleave_shards(empty).count() == 0
    assert sorted(r.shard for r in sharding.interleave_shards(odd.limit(2), 40).collect()) == sorted({r.shard for r in sharding.interleave_shards(odd.limit(2), 40).collect()})
