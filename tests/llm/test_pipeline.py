import numpy as np

import corpus_pipeline as cp

from siltstone.llm import simhash
from siltstone.llm.common import materialize


def test_stages_on_their_own_input(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf))
        assert out.columns == columns
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()})
        docs = out
    before, after = seen["language"]
    assert len(after) >= 0.99 * len(before)
    before, after = seen["lines"]
    assert set(after) <= set(before) and any(after[k] != before[k] for k in after)
    before, after = seen["near_duplicates"]
    prints = {k: simhash.wide_fingerprint(t, (5,))[0] for k, t in before.items()}
    far = lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b]).sum())
    assert all(any(far(k, j) <= simhash.WIDE_DISTANCE for j in before if j != k) for k in set(before) - set(after))
    words = {k: t.lower().split() for k, t in after.items()}
    sets = {k: {tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} for k, w in words.items()}
    kept = sorted(after)
    alike = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for x, a in enumerate(kept) for b in kept[x + 1 :] if not sets[a].isdisjoint(sets[b])]
    assert sum(x >= 0.8 for x in alike) <= 1
    before, after = seen["benchmark_leaks"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    squeeze = lambda t: " ".join(t.lower().split())
    assert not any(squeeze(b.text) in squeeze(t) for b in bench for t in after.values())
    assert set(before) - set(after) and len(after) > 0.9 * len(before)
    pieces = cp.pack(spark, docs, sf).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == set(after)


def test_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"))
    assert 5 in {r.doc_id for r in docs.collect()}
    assert cp.STAGES[-1][1](spark, docs, "").count() > 0
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    sf = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, "clean words of a first text"), (1, "clean words of a first text"), (1, f"and {leak} here"), (None, leak), (None, "another clean text without an id"), (3, f"{leak} again")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = cp.benchmark_leaks(spark, docs, sf).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(i), t) for i, t in rows if leak not in t)
    left = cp.near_duplicates(spark, docs, sf).collect()
    # the three texts around the passage are one class
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted({(str(i), t) for i, t in rows if leak not in t or t.startswith("and")})


def test_run(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert rows and max(fill.values()) <= 2048 and set(rows[0].asDict()) >= {"doc_id", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"}
