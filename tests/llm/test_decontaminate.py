import random
from itertools import combinations

import numpy as np

from siltstone.llm import common
from siltstone.llm import decontaminate as dc


def brute(docs, items):
    """Pairs with a stretch of STRETCH words (or a whole shorter passage), SIMILARITY of them equal, on some diagonal, and a seed there."""
    out = set()
    for i, text in docs:
        d = dc.token_hashes(text)
        for j, passage in items:
            q = dc.token_hashes(passage)
            for shift in range(-len(q), len(d)):
                if dc.overlap(d, q, shift):
                    out.add((i, j))
                    break
    return out


def test_substitutions_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(14, 40)))) for k in range(30)]
    docs = []
    for k in range(120):
        text = rng.choices(words, k=rng.randint(0, 200))
        if k % 3 == 0:
            planted = items[k % 30][1].split()
            for at in rng.sample(range(len(planted)), len(planted) // 6):
                planted[at] = "other"
            text[10:10] = planted
        docs.append((k, " ".join(text).upper() if k % 2 else " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got <= want and len(got & want) >= 0.95 * len(want)
    assert {k for k, _ in got} <= {k for k in range(120) if k % 3 == 0}


def test_all_lengths_are_exact(spark):
    """Every passage of 1 to 16 words with every set of substitutions that the rule allows, and one more."""
    rng, docs, items = random.Random(6), [], []
    for n in range(1, 17):
        passage = [f"p{n}x{k}" for k in range(n)]
        items.append((n, " ".join(passage)))
        for k in range(0, n // 5 + 2):
            for at in combinations(range(n), k) if n < 14 else [rng.sample(range(n), k)]:
                text = [f"f{rng.random()}" for _ in range(rng.randint(0, 3))] + [f"other{w}" if j in at else w for j, w in enumerate(passage)]
                docs.append((len(docs), " ".join(text + [f"g{rng.random()}"] * rng.randint(0, 3))))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(*frames).collect()}
    assert got == brute(docs, items) and len({i for _, i in got}) == 16


def test_passages_of_one_id_or_none(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma delta epsilon"), (None, "one two three four five six"), (7, "red green blue white black"), (7, "a b c d e f g h i j")], "item_id long, text string")
    docs = [(1, "x alpha beta gamma delta epsilon"), (2, "one two other four five six y"), (3, "red green blue white black"), (4, "z a b c d e f g h i j"), (None, "red green blue white pink")]
    rows = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id, r.equal_words) for r in rows} == {(1, None, 5), (2, None, 5), (3, 7, 5), (4, 7, 10), (None, 7, 4)}


def test_driver_passages(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = dc.contaminated(documents, bench).collect()
    texts = {r.doc_id: " ".join(r.text.split()) for r in documents.collect()}
    whole = {(i, b.item_id) for b in bench.collect() for i, t in texts.items() if " ".join(b.text.split()) in t}
    assert whole and whole <= {(r.doc_id, r.item_id) for r in rows}
    assert all(r.equal_words >= 10 for r in rows)


def test_seeds_ignore_places():
    a = np.arange(12, dtype=np.uint64)
    b = a.copy()
    b[3] = 99
    assert dc.seeds(a)[0][0] == dc.seeds(b)[0][0] and dc.seeds(a)[1][0] != dc.seeds(b)[1][0]
    assert [len(x) for x in dc.seeds(a[:5])] == [0, 0, 0, 0]


def test_odd_rows(odd, empty):
    items = odd.select("doc_id", "text").toDF("item_id", "text")
    rows = dc.contaminated(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} >= {(5, 5), (5, 6), (6, 5), (6, 6), (1, 1), (1, 10), (10, 1), (None, None)}
    assert not {r.doc_id for r in rows} & {2, 3, 7} and {r.item_id for r in rows if r.doc_id == 8} == {8}
    assert dc.contaminated(empty, items).count() == 0
    assert dc.contaminated(odd, items.limit(0)).count() == 0


def test_shared_hashes_and_copies(spark, monkeypatch):
    """Copies of a document are one class, and what many share is split over parts; the pairs are the same."""
    same = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame([(k, f"{same} own{k} tail{k} words{k} here{k} now{k}") for k in range(12)], "item_id long, text string")
    texts = [f"lead{k % 3} {same} " + (f"own{k % 12} tail{k % 12} words{k % 12} here{k % 12} now{k % 12}" if k % 2 else "something else that is nowhere") for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {tuple(r) for r in dc.contaminated(docs, items).collect()}
    whole = {(k, k % 12) for k in range(40) if k % 2}
    assert whole == {(r[0], r[1]) for r in rows if r[2] == 13} and {(r[4], r[5]) for r in rows if r[2] == 13} == {(1, 14)}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "PAIRS_AT_ONCE", 20)
    assert {tuple(r) for r in dc.contaminated(docs, items).collect()} == rows
