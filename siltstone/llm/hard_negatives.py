"""Hard negatives by maximum inner products in windows, from cover trees over norm-augmented vectors.

A further component lifts all candidates to the norm of the longest, so that those with a large inner product with an
anchor are those near it, and a ball round a centre bounds the inner products of all that it covers. The top of the tree is
a few pivots, chosen farthest first from a bounded sample; every row falls to its nearest pivot's cell, and a cell is
split into blocks of bounded size. Each block is a cover tree: the children of a node cover its rows with half its radius
or less, and keep the radius that they need.

An anchor goes to the blocks of the cells whose bounds meet its windows. There it descends the tree by levels past nodes
whose bounds lie outside all its windows, takes the leaves that are left best bound first, and skips those that fell
behind the scores found meanwhile. Leaves are verified by whole integer inner products. Positives are sought in the
anchor's own cell first; their scores bound the search of the other cells, and then give the windows of the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidy

#: Rows of a block, and of a leaf that is not divided further.
BLOCK, LEAF = 2048, 8
#: Most pivots, and most rows and bytes of the sample that they are chosen from.
CELLS, SAMPLE_ROWS, SAMPLE_BYTES = 256, 2048, 4 << 20
#: Anchors of a task; candidates are repeated for each so many.
ANCHORS = 1 << 18
#: Anchors that descend together.
TOGETHER = 256
#: Beyond all scores. Scores that a long can't hold are cut to these.
HIGH = 1 << 62
#: Squared norms below this have exact inner products in floating point.
EXACT = 2.0**53
ROW = "id long, label long, vec binary, tag array<long>, base array<long>, lo array<long>, hi array<long>"


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with a component that gives each the squared norm ``top``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])


def distances(points: np.ndarray, centre: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(2 * (top - points @ centre.T), 0))


def farthest_first(points: np.ndarray, count: int, top: float, within: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Up to ``count`` points, each the farthest from those before, until all are ``within`` reach; each point's nearest and its distance."""
    chosen, owner = [0], np.zeros(len(points), np.int64)
    near = distances(points, points[0], top)
    while len(chosen) < count and near[far := int(near.argmax())] > within:
        d = distances(points, points[far], top)
        closer = d < near
        owner[closer], near[closer] = len(chosen), d[closer]
        chosen.append(far)
    return chosen, owner, near


class CoverTree:
    """A cover tree over a block of candidates; the rows below a node are a range of ``rows``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: float):
        self.exact = top < EXACT
        self.slack = 1e-6 * (1 + np.sqrt(top))
        points = lifted(vectors, top)
        rows = np.arange(len(ids))
        nodes, k = [(0, len(ids))], 0
        radius, children = [], []
        while k < len(nodes):
            a, b = nodes[k]
            d = distances(points[rows[a:b]], points[rows[a]], top)
            radius.append(float(d.max()))
            first = len(nodes)
            if b - a > LEAF and radius[-1] > self.slack:
                _, owner, near = farthest_first(points[rows[a:b]], b - a, top, radius[-1] / 2)
                # A child's centre goes to the front, where the child looks for it.
                rows[a:b] = rows[a:b][np.lexsort((near, owner))]
                ends = (a + np.cumsum(np.bincount(owner))).tolist()
                nodes += zip([a, *ends[:-1]], ends)
            children.append((first, len(nodes)))
            k += 1
        self.begin, self.end = np.array(nodes, np.int64).T
        self.radius, self.children = np.array(radius), np.array(children, np.int64)
        self.centre = points[rows[self.begin], :-1]
        self.ids, self.labels, self.vectors = ids[rows], labels[rows], vectors[rows]
        self.floats = self.vectors.astype(np.float64)

    def _scores(self, asks: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.rint(asks.astype(np.float64) @ self.floats[rows].T).astype(np.int64)
        whole = asks.astype(object) @ self.vectors[rows].astype(object).T
        return np.clip(whole, -HIGH + 1, HIGH - 1).astype(np.int64)

    def _leaves(self, asks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The leaves that some anchor can't pass by, whether each anchor needs them, and upper bounds."""
        nodes, alive = np.zeros(1, np.int64), np.ones((len(asks), 1), bool)
        found, norms = [], np.sqrt((asks * asks).sum(1))[:, None]
        while len(nodes):
            if self.exact:
                middle, reach = asks @ self.centre[nodes].T, norms * (self.radius[nodes] + self.slack) + self.slack
                above, below = middle + reach, middle - reach
                alive = alive & meets(below, above, lo, hi)
            else:
                above = np.full((len(asks), len(nodes)), np.inf)
            used = np.flatnonzero(alive.any(0))
            first, last = self.children[nodes[used]].T
            leaf = used[first == last]
            found.append((nodes[leaf], alive[:, leaf], above[:, leaf]))
            used, first, last = used[first < last], first[first < last], last[first < last]
            alive = np.repeat(alive[:, used], last - first, axis=1)
            nodes = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(used) else used
        return np.concatenate([f[0] for f in found]), np.hstack([f[1] for f in found]), np.hstack([f[2] for f in found])

    def search(self, ids, labels, vectors, lo, hi, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(anchor's number, window's number, candidate's id, score) of the first ``k`` in each anchor's windows [lo, hi]."""
        windows = lo.shape[1]
        nodes, alive, above = self._leaves(vectors.astype(np.float64), lo, hi)
        order = np.argsort(-above.max(0, initial=-np.inf, where=alive), kind="stable")
        size, at, step = (self.end - self.begin)[nodes[order]], 0, 64
        best = np.zeros((0, 3), np.int64)  # slot, score, id
        floor = lo.copy()
        while at < len(order):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), step)) + at)
            part, at, step = order[at:upto], upto, min(2 * step, 1024)
            need = alive[:, part] & (above[:, part] >= floor.min(1)[:, None])
            part, need = part[need.any(0)], need[:, need.any(0)]
            if not len(part):
                continue
            count = (self.end - self.begin)[nodes[part]]
            rows = np.repeat(self.begin[nodes[part]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            score = self._scores(vectors, rows)
            fits = np.repeat(need, count, axis=1) & ((labels[:, None] == self.labels[rows]) == same) & (ids[:, None] != self.ids[rows])
            new = [best]
            for w in range(windows):
                a, c = np.nonzero(fits & (score >= floor[:, w : w + 1]) & (score <= hi[:, w : w + 1]))
                new.append(np.column_stack([a * windows + w, score[a, c], self.ids[rows[c]]]))
            if sum(map(len, new)) > len(best):
                best = np.concatenate(new)
                best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
                begin = np.flatnonzero(np.append(True, best[1:, 0] != best[:-1, 0]))
                place = np.arange(len(best)) - np.repeat(begin, np.diff(np.append(begin, len(best))))
                full = place == k - 1
                floor.ravel()[best[full, 0]] = best[full, 1]
                best = best[place < k]
        return best[:, 0] // windows, best[:, 0] % windows, best[:, 2], best[:, 1]


def meets(below: np.ndarray, above: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each anchor (row) and node (column), whether the node's bounds meet one of the anchor's windows."""
    out = np.zeros(below.shape, bool)
    for w in range(lo.shape[1]):
        out |= (above >= lo[:, w : w + 1]) & (below <= hi[:, w : w + 1]) & (lo[:, w] <= hi[:, w])[:, None]
    return out


def matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.int64).reshape(-1, dim)


def padded(lists: pd.Series, fill: int) -> np.ndarray:
    """Lists as rows of a table, filled up at the end."""
    width = max(map(len, lists), default=0)
    return np.array([[*x, *[fill] * (width - len(x))] for x in lists], np.int64).reshape(len(lists), width)


class Forest:
    """All candidates, in cells and blocks, ready to be searched."""

    def __init__(self, rows: DataFrame):
        """``rows`` has id, label, vec (array of longs) and asks. Of no rows only their number is there."""
        self.spark = rows.sparkSession
        square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim"), F.max(square).alias("top"), F.count_if("asks").alias("asks")).first()
        self.n, self.dim, self.top = facts["n"], max(facts["dim"] or 0, 1), facts["top"] or 0.0
        self.parts = max(1, -(-facts["asks"] // ANCHORS))
        if not self.n:
            return
        dim, top = self.dim, self.top
        sample = rows.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))).collect()
        points = lifted(padded(pd.Series([r["vec"] for r in sample]), 0), top)
        points = np.hstack([points[:, :-1], np.zeros((len(points), dim + 1 - points.shape[1])), points[:, -1:]])
        chosen = farthest_first(points, min(CELLS, -(-self.n // BLOCK)), top)[0]
        self.pivots = pivots = points[chosen]

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.zeros((len(b), dim), np.int64)
                for k, v in enumerate(b["vec"]):
                    x[k, : len(v)] = v
                d = distances(lifted(x, top), pivots, top)
                out = b[["id", "label", "asks"]].assign(cell=d.argmin(1).astype(np.int32), reach=d.min(1), vec=[v.tobytes() for v in x])
                yield out[["cell", "reach", "id", "label", "asks", "vec"]]

        self.placed = materialize(rows.mapInPandas(tidy(place), "cell int, reach double, id long, label long, asks boolean, vec binary"))
        # A row for each pivot.
        cells = {r["cell"]: r for r in self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()}
        self.reach = np.array([cells[c]["reach"] if c in cells else -np.inf for c in range(len(pivots))])
        self.blocks = [-(-cells[c]["n"] // BLOCK) if c in cells else 0 for c in range(len(pivots))]

    def anchors(self) -> DataFrame:
        """All anchors with one window, over all scores."""
        one = lambda x: F.array(F.lit(x).cast("long"))
        return self.placed.filter("asks").select("id", "label", "vec", one(0).alias("tag"), one(0).alias("base"), one(-HIGH).alias("lo"), one(HIGH).alias("hi"))

    def routed(self, asks: DataFrame, home: bool | None) -> DataFrame:
        """A row for each cell that an anchor's windows meet: its own only, all others, or (None) any."""
        dim, top, pivots, reach = self.dim, self.top, self.pivots, self.reach

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = matrix(b["vec"], dim)
                own = distances(lifted(x, top), pivots, top).argmin(1)
                middle, slack = x @ pivots[:, :-1].T, 1e-6 * (1 + np.sqrt(top))
                width = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * (reach + slack) + slack
                go = meets(middle - width, middle + width, padded(b["lo"], HIGH), padded(b["hi"], -HIGH)) if top < EXACT else np.ones((len(b), len(pivots)), bool)
                if home is not None:
                    go &= (np.arange(len(pivots)) == own[:, None]) == home
                a, c = np.nonzero(go & np.isfinite(reach))
                yield b.iloc[a].assign(cell=c.astype(np.int32))

        return asks.mapInPandas(tidy(route), f"{ROW}, cell int")

    def search(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, tag, base, rank, other, score): of routed anchors, the first ``k`` candidates in each window, of their label or of others."""
        blocks = F.element_at(F.array(*[F.lit(max(1, n)) for n in self.blocks]), F.col("cell") + 1)
        empty = [F.lit(None).cast("array<long>").alias(c) for c in ("tag", "base", "lo", "hi")]
        there = self.placed.select(
            "cell", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"), F.lit(False).alias("asks"), "id", "label", "vec", *empty
        )
        asks = asks.select(
            "cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias("part"), F.lit(True).alias("asks"), "id", "label", "vec", "tag", "base", "lo", "hi"
        )
        group = ["cell", "block", "part"]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = there.unionByName(asks).repartition(n, *group).sortWithinPartitions(*group, "asks")
        dim, top = self.dim, self.top

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, held, tree = None, [], None
            for b in batches:
                for own, part in b.groupby(group, sort=False):
                    if own != key:
                        key, held, tree = own, [], None
                    if not part["asks"].all():
                        held.append(part[~part["asks"]])
                    part = part[part["asks"]]
                    if len(part) and tree is None and held:
                        there = pd.concat(held)
                        tree, held = CoverTree(there["id"].to_numpy(), there["label"].to_numpy(), matrix(there["vec"], dim), top), []
                    for s in range(0, len(part) if tree else 0, TOGETHER):
                        q = part.iloc[s : s + TOGETHER]
                        lo, hi, tag, base = (padded(q[c], x) for c, x in (("lo", HIGH), ("hi", -HIGH), ("tag", 0), ("base", 0)))
                        ids = q["id"].to_numpy()
                        a, w, other, score = tree.search(ids, q["label"].to_numpy(), matrix(q["vec"], dim), lo, hi, same, k)
                        yield pd.DataFrame({"id": ids[a], "tag": tag[a, w], "base": base[a, w], "other": other, "score": score})

        found = rows.mapInPandas(tidy(run), "id long, tag long, base long, other long, score long")
        rank = F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.desc("score"), "other"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    df: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """Hard negatives of the rows where ``anchors`` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of vectors of whole numbers. An anchor's positives are the first ``positives`` other rows of
    its label; for each, the negatives are the first ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` hundredths of the positive's. Higher scores come first, ties by smaller id. Results are exact.

    Rows whose id, label or vector is null, or whose vector has a null, take no part. Ids are longs. Rows that share an
    id are one: that of the least label, then vector. A vector shorter than the longest counts as filled up with zeros;
    scores beyond 2**62 are cut to that. A null ``anchors`` is false. Without anchors, positives or negatives there are
    no rows; other columns are not read.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    rows = materialize(rows.groupBy("id").agg(F.min(F.struct("label", "vec", "asks")).alias("r")).select("id", "r.*"))
    forest = Forest(rows)
    if not forest.n:
        return df.sparkSession.createDataFrame([], SCHEMA)
    asks = forest.anchors()
    near = materialize(forest.search(forest.routed(asks, True), True, positives))
    bound = near.filter(F.col("rank") == positives).select("id", F.col("score").alias("bound"))
    asks = materialize(asks.join(bound, "id", "left").withColumn("lo", F.array(F.coalesce("bound", F.lit(-HIGH)))).drop("bound"))
    far = forest.search(forest.routed(asks, False), True, positives)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    found = near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    # The windows of an anchor's positives, in whole numbers; a negative score's is empty.
    exact = F.col("score").cast("decimal(20,0)")
    found = found.withColumn("lo", F.ceil(exact * low / 100).cast("long")).withColumn("hi", F.floor(exact * high / 100).cast("long")).filter("lo <= hi")
    windows = found.groupBy("id").agg(F.collect_list(F.struct("other", "score", "lo", "hi")).alias("w"))  # one for each positive
    windows = windows.select("id", F.col("w.other").alias("tag"), F.col("w.score").alias("base"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    asks = materialize(asks.select("id", "label", "vec").join(windows, "id"))
    out = forest.search(forest.routed(asks.select("id", "label", "vec", "tag", "base", "lo", "hi"), None), False, negatives)
    return out.select(
        F.col("id").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("base").alias("positive_score"), F.col("score").alias("negative_score")
    )


#: What the query gives, in DuckDB SQL over ``embeddings``.
SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
