import math
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import ctw


class Brute:
    """The model straight from its definition: one dict of binary counts by (context, node)."""

    def __init__(self, docs, depth):
        self.n, self.depth, self.memo = Counter(), depth, {}
        self.children = {}
        for doc in docs:
            for node, ctx, bit in self.steps(doc):
                for d in range(depth + 1):
                    c = ctx[len(ctx) - d :]
                    self.n[node, c, bit] += 1
                    if d:
                        self.children.setdefault((node, c[1:]), set()).add(c)

    def steps(self, doc):
        data = ctw.END * self.depth + doc
        for t in range(self.depth, len(data)):
            for j in range(8):
                yield (1 << j) | data[t] >> (8 - j), data[t - self.depth : t], data[t] >> (7 - j) & 1

    def own(self, node, c):
        a, b = self.n[node, c, 0], self.n[node, c, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(self, node, c):
        if (node, c) not in self.memo:
            own = self.own(node, c)
            self.memo[node, c] = own if len(c) == self.depth else np.logaddexp(own, self.below(node, c)) - math.log(2)
        return self.memo[node, c]

    def below(self, node, c):
        return sum(self.weighted(node, x) for x in self.children.get((node, c), ()))

    def p(self, node, ctx, bit, d=0):
        c = ctx[len(ctx) - d :]
        n = self.n[node, c, 0] + self.n[node, c, 1]
        own = (self.n[node, c, bit] + 0.5) / (n + 1)
        if d == self.depth or not n:
            return own
        deeper = ctx[len(ctx) - d - 1 :]
        if not self.n[node, deeper, 0] + self.n[node, deeper, 1]:
            return own
        trust = 1 / (1 + math.exp(self.own(node, c) - self.below(node, c)))
        return own + trust * (self.p(node, ctx, bit, d + 1) - own)

    def score(self, doc):
        return sum(math.log10(self.p(node, ctx, bit)) for node, ctx, bit in self.steps(doc))


def brute(rows, depth):
    line = lambda t: b" ".join(ctw.tokens(t)[:-1]) + ctw.END
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    model = Brute([line(t) for i, t in rows if not held(i)], depth)
    c = Counter(w for i, t in rows if not held(i) for w in ctw.tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = ctw.tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = model.score(line(t))
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, base, score, -score / math.log10(2) / len(line(t))))
    return sorted(out, key=str)


def check(df, depth):
    got = sorted((tuple(r) for r in ctw.score(df, depth=depth).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], depth)
    key = lambda r: (str(r[0]), r[2], r[6])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-9)


def test_against_brute_force(documents):
    check(documents.filter("doc_id < 40 and n_chars < 1500"), 3)


def test_other_trees_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(ctw, "TOP", 2)
    check(documents.filter("doc_id < 30 and n_chars < 1000"), 3)
    monkeypatch.setattr(ctw, "TOP", 4)
    check(documents.filter("doc_id < 20 and n_chars < 1000"), 5)


def test_odd_rows(odd, empty):
    check(odd.filter("length(text) < 1000 or text is null"), 3)
    assert ctw.score(odd).count() == odd.count()
    assert ctw.score(empty).count() == 0


def test_blocks_do_not_matter(documents, monkeypatch):
    some = documents.filter("doc_id < 60")
    one = {r.doc_id: r.score for r in ctw.score(some, depth=4).collect()}
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(ctw, "FAN_IN", 2)
    many = {r.doc_id: r.score for r in ctw.score(some.repartition(3), depth=4).collect()}
    assert many == pytest.approx(one)
    seen, real = [], ctw.hot_buckets
    monkeypatch.setattr(ctw, "PART_BYTES", 300)  # of most buckets several parts
    monkeypatch.setattr(ctw, "hot_buckets", lambda rows: seen.append(real(rows)) or seen[-1])
    assert {r.doc_id: r.score for r in ctw.score(some.repartition(3), depth=4).collect()} == pytest.approx(one)
    assert seen[0].count() > 64
    monkeypatch.undo()
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 20_000)
    for top in (2, 4):  # trees below two and four bytes
        monkeypatch.setattr(ctw, "TOP", top)
        assert {r.doc_id: r.score for r in ctw.score(some.repartition(3), depth=4).collect()} == pytest.approx(one)


def test_probabilities_sum_to_one():
    docs = [b"abab ab\n", b"abc\n", b"ba\n"]
    model = Brute(docs, 2)
    for ctx in (b"ab", b"\n\n", b"zz"):
        assert sum(10 ** sum(math.log10(model.p((1 << j) | y >> (8 - j), ctx, y >> (7 - j) & 1)) for j in range(8)) for y in range(256)) == pytest.approx(1)


def test_counts_of_any_size():
    x = np.array([0.5, 1.0, 3.0, 70_000.5, 1e9])
    assert ctw._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-7)
    assert ctw._kt(np.array([70_000.0, 2]), np.array([3.0, 0])) == pytest.approx(ctw._lgamma(np.array([70_000.5, 2.5])) + ctw._lgamma(np.array([3.5, 0.5])) - 2 * math.lgamma(0.5) - ctw._lgamma(np.array([70_004.0, 3])))
