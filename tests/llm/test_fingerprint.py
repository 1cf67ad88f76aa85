import hashlib

import numpy as np
import pytest

from siltstone.llm import fingerprint as fp


def parsed(s):
    return {s[k : k + 12]: int(s[k + 12 : k + 14], 16) for k in range(0, len(s), 14)}


def likeness(a, b):
    a, b = parsed(a), parsed(b)
    return sum(n for k, n in a.items() if k in b) / sum(a.values()) if a else float(not b)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, follow = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + follow[:cut]
        one, two, three = (fp.printed(fp.chunk_set(x)) for x in (t, edited, follow))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), one, two, likeness(one, two), likeness(one, three)))
    return out


def test_against_brute_force(documents):
    rows = {r[0]: tuple(r) for r in fp.neighbour_fingerprints(documents).collect()}
    want = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert len(rows) == len(want)
    for w in want:
        assert rows[w[0]][:5] == w[:5] and rows[w[0]][5:] == pytest.approx(w[5:])
    long = [w for w in want if w[1] > 400]
    assert np.mean([w[5] for w in long]) > 0.65 and np.mean([w[6] for w in long]) < 0.1


def test_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in fp.neighbour_fingerprints(odd).collect()), key=str)
    assert got == sorted(brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]), key=str)
    assert fp.neighbour_fingerprints(empty).count() == 0
    one = fp.neighbour_fingerprints(odd.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_chunks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    ends = fp.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= fp.SMALLEST and sizes.max() <= fp.LARGEST
    moved = np.concatenate([rng.integers(97, 123, 7).astype(np.uint8), data])
    shared = {e + 7 for e in ends} & set(fp.chunk_ends(moved))
    assert len(shared) > 0.95 * len(ends)
    text = "é" * 3000 + "日本語" * 500
    raw = text.encode()
    assert sum(c & 0xC0 == 0x80 for c in (raw[e] for e in fp.chunk_ends(np.frombuffer(raw, np.uint8))[:-1])) < 200
