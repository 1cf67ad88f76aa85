import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import hard_negatives as hn
from siltstone.llm import queries

FIELDS = "vec_id long, embedding array<long>, label int"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, v, label in rows:
        if is_anchor(i):
            scored = sorted((-dot(v, u), j, k) for j, u, k in rows if j != i)
            for s, p, _ in [x for x in scored if x[2] == label][:positives]:
                inside = [(t, j) for t, j, k in scored if k != label and -low * s <= -100 * t <= -high * s][:negatives]
                out += [(i, p, n + 1, j, -s, -t) for n, (t, j) in enumerate(inside)]
    return sorted(out)


def rows_of(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (12, dim))
    x = centres[rng.integers(0, 12, n)] * rng.integers(1, 3, (n, 1)) + rng.integers(-spread, spread + 1, (n, dim))
    x[: n // 3] = x[0]  # one vector for a third of all rows
    return [(i, v.tolist(), int(k)) for i, v, k in zip(rng.permutation(n).tolist(), x, rng.integers(0, 4, n))]


@pytest.mark.parametrize("spread", [3, 150])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "BLOCK", 50)
    monkeypatch.setattr(hn, "ANCHORS", 20)
    rows = rows_of(spread, 600, 7, spread)
    got = hn.mine(spark.createDataFrame(rows, FIELDS).repartition(3), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_tree_covers_and_prunes():
    rows = rows_of(1, 900, 6, 2)
    x = np.array([r[1] for r in rows])
    top = float((x * x).sum(1).max())
    tree = hn.CoverTree(np.arange(len(x)), np.zeros(len(x), np.int64), x, top)
    for (a, b), r, (c, d) in zip(zip(tree.begin, tree.end), tree.radius, tree.children):
        below = hn.lifted(tree.vectors[a:b], top)
        assert np.linalg.norm(below - below[0], axis=1).max() <= r + tree.slack
        assert all(tree.radius[k] <= r / 2 + tree.slack for k in range(c, d)) and (c == d or (tree.begin[c], tree.end[d - 1]) == (a, b))
    q = x[-20:]
    own = (q * q).sum(1)[:, None]
    nodes, alive, _ = tree._leaves(q.astype(float), own * 9 // 10, np.full((20, 1), hn.HIGH))
    leaves = int((tree.children[:, 0] == tree.children[:, 1]).sum())
    assert 0 < alive.sum() < 0.5 * leaves * len(q)
    for k, v in enumerate(q):
        inside = np.flatnonzero(tree.vectors @ v >= own[k] * 9 // 10)
        assert all(any(alive[k, j] and tree.begin[n] <= row < tree.end[n] for j, n in enumerate(nodes)) for row in inside)


def test_odd_rows(spark):
    rows = rows_of(9, 60, 5, 40)
    odd = [(None, [1, 2, 3, 4, 5], 1), (100, None, 1), (101, [1, None, 3, 4, 5], 1), (102, [9, 9, 9, 9, 9], None), (103, [50, 60], 2), (104, [], 3), rows[0], rows[0]]
    df = spark.createDataFrame(rows + odd, FIELDS).withColumn("id", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("tag", F.lit(None).cast("int"))
    want = brute(rows + [(103, [50, 60], 2), (104, [], 3)], lambda i: i % 3 == 0)
    assert sorted(map(tuple, hn.mine(df, F.col("vec_id") % 3 == 0).collect())) == want
    assert hn.mine(df.limit(0), F.lit(True)).count() == 0 and hn.mine(df, F.lit(None).cast("boolean")).count() == 0
    assert hn.mine(df.filter("label is null"), F.lit(True)).count() == 0


def test_large_numbers_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-(1 << 28), 1 << 28) * 2 + 1 for _ in range(4)], i % 3) for i in range(60)]
    got = hn.mine(spark.createDataFrame(rows, FIELDS), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 5 == 0)


def test_query_is_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(c.sql(queries.ORACLES["op12_hard_negatives"]).fetchall())
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, sf).collect())) == want and len(want) > 20
