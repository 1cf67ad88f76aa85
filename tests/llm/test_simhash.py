import numpy as np
import xxhash

from siltstone.llm import simhash


def brute(rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {t: fp(t) for t in {t for _, t in rows}}
    fps = sorted(set(prints.values()))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    low = {}
    for i, t in rows:
        r = find(prints[t])
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, prints[t], low.get(find(prints[t]))) for i, t in rows), key=str)


def got(df):
    return sorted(((r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_duplicates(df).collect()), key=str)


def test_against_brute_force(documents):
    assert got(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd, empty):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_and_salted_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 1500)] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    fp = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    i, j = simhash.trie_pairs(fp, [0], [len(fp)], [0], [len(fp)])
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1)))))
    monkeypatch.setattr(simhash, "GROUP", 16)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    nodes = {r.node: r.root for r in simhash.connected(simhash.linked(df)).collect()}
    label = simhash.forest(len(fp), *np.nonzero(close))
    classes = {}
    for k, x in enumerate(fp.view(np.int64).tolist()):
        classes.setdefault(nodes.get(x, x), set()).add(label[k])
    assert all(len(v) == 1 for v in classes.values()) and len(classes) == len(set(label.tolist()))


def shingle_sets(rows):
    words = {i: (t or "").lower().split() for i, t in rows}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}


def test_wide_fingerprints():
    words = [f"w{k * k % 1009}" for k in range(70_000)]
    text = " ".join(words)
    one, two = simhash.wide_fingerprint(text, (5, 2))
    assert (one == simhash.wide_fingerprint("\n".join(words).upper(), (5,))[0]).all() and (one != two).any()
    for a, b in ((None, ""), (" \t", ""), ("A b", "a  b")):
        assert (simhash.wide_fingerprint(a, (5,))[0] == simhash.wide_fingerprint(b, (5,))[0]).all()
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5001, dtype=np.uint64)
    bits = np.unpackbits(np.stack([simhash.mix64(hashes + np.uint64(w)) for w in range(simhash.WIDE)], axis=1).view(np.uint8), axis=1)
    assert (np.unpackbits(simhash.wide_bits(hashes).view(np.uint8)) == (bits.sum(0, dtype=int) * 2 > 5001)).all()


def test_wide_trie():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (60, simhash.WIDE), dtype=np.uint64)
    fp = base[rng.integers(0, 60, 900)] ^ (rng.integers(0, 1 << 63, (900, simhash.WIDE), dtype=np.uint64) & rng.integers(0, 1 << 63, (900, simhash.WIDE), dtype=np.uint64) & rng.integers(0, 1 << 63, (900, simhash.WIDE), dtype=np.uint64))
    fp = fp[np.lexsort(fp.T[::-1])]
    i, j = simhash.trie_pairs(fp, [0], [900], [0], [900], simhash.WIDE_DISTANCE)
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]).sum(2, dtype=int) <= simhash.WIDE_DISTANCE
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1)))))


def test_near_texts_against_shingle_sets(spark, documents, monkeypatch):
    rng, rows = np.random.default_rng(5), [(r.doc_id, r.text) for r in documents.collect()]
    whole = [t for _, t in rows if t and len(t.split()) >= 100][:80]
    for k, t in enumerate(whole):  # one word in 60 replaced
        rows.append((10_000_000 + k, " ".join(f"new{n}" if rng.random() < 1 / 60 else w for n, w in enumerate(t.split()))))
    monkeypatch.setattr(simhash, "GROUP", 4)
    got = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == {i for i, _ in rows}
    sets, ids = shingle_sets(rows), [i for i, _ in rows]
    found, missed = 0, 0
    for x, a in enumerate(ids):
        assert got[a] <= a and got[got[a]] == got[a]
        for b in ids[x + 1 :]:
            if not sets[a].isdisjoint(sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                found, missed = found + (got[a] == got[b]), missed + (got[a] != got[b])
    assert found > 60 and missed <= 0.05 * found
    prints = {i: simhash.wide_fingerprint(t, (5,))[0] for i, t in rows}
    for a in ids:
        assert got[a] == a or any(int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= simhash.WIDE_DISTANCE for b in ids if b != a and got[b] == got[a])


def test_near_texts_odd_rows(odd, empty):
    rows = simhash.near_texts(odd).collect()
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    got = sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None)
    assert got == [(1, 1), (1, 1), (2, 2), (3, 2), (5, 5), (6, 5), (7, 2), (8, 8), (9, 9), (10, 1)]
    assert simhash.near_texts(empty).count() == 0


def test_one_of_each(spark, odd, empty):
    rows = simhash.one_of_each(odd)
    assert rows.columns == odd.columns
    assert sorted((r.doc_id for r in rows.collect()), key=str) == [1, 2, 5, 8, 9, None]
    assert simhash.one_of_each(empty).count() == 0
    texts = [("b", "one two three"), ("b", "four five six"), ("a", "One  two three"), (None, "four five six"), (None, "seven eight"), (None, "seven eight")]
    got = simhash.one_of_each(spark.createDataFrame(texts, "k string, t string"), "k", "t").collect()
    assert sorted(map(tuple, got), key=str) == [("a", "One  two three"), ("b", "four five six"), (None, "seven eight")]


def test_near_texts_edited_in_blocks(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    word = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    for k in range(240):
        w, kind = word(300), k % 4
        # replaced, cut off, appended: similarities of 0.80 to 0.82; the last is replaced down to 0.72
        other = (w[:120] + word(28) + w[148:], w[:244], w + word(70), w[:120] + word(44) + w[164:])[kind]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, other))
        similarity = len(a & b) / len(a | b)
        assert 0.8 <= similarity < 0.83 if kind < 3 else 0.7 < similarity < 0.75
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        one, two = (simhash.wide_fingerprint(t, (5,))[0] for _, t in rows[-2:])
        near = similarity >= 0.8 and int(np.bitwise_count(one ^ two).sum()) <= simhash.WIDE_DISTANCE
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (not near)}
    got = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert sum(want[2 * k + 1] == 2 * k for k in range(240)) == 180


def test_repeats_of_a_line_lose_no_link(spark):
    """Sets decide, not how often a shingle is there: a line repeated 200 times, and texts edited at random."""
    rng, rows = np.random.default_rng(12), []
    word = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    for k in range(40):
        w, line = word(300), word(9)
        times = int(rng.integers(1, 400))
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(w[:150] + line * times + w[150:]))]
        rows.append((3 * k + 2, " ".join(x if rng.random() > 0.012 else word(1)[0] for x in w)))
    got = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = shingle_sets(rows)
    links = 0
    for k in range(0, 120, 3):
        for a, b in ((k, k + 1), (k, k + 2), (k + 1, k + 2)):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links += 1
                assert got[a] == got[b], (a, b)
    assert links > 60
    words = [f"w{k}" for k in range(300)]
    a, b = (simhash.shingle_hashes(" ".join(w), (5,))[0] for w in (words, words + words[:8] * 200))
    assert simhash.similar([a, b], 0.8).tolist() == [0, 0]


def test_keys_grow_with_the_count():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**9, 10**12, 10**15)] == [6, 6, 7, 8, 10]
    assert simhash.blocks_for(10**6, 2) == 4


def test_links_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fp = base[rng.integers(0, 60, 400)]
    for _ in range(4):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 63, 400, dtype=np.uint64))
    fp = np.unique(np.concatenate([base, fp]))
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = len(set(simhash.forest(len(fp), *np.nonzero(close)).tolist()))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for blocks in ((6, 6), (9, 9)):
        monkeypatch.setattr(simhash, "BLOCKS", blocks)
        nodes = {r.node: r.root for r in simhash.connected(simhash.linked(df)).collect()}
        assert len({nodes.get(int(x), int(x)) for x in fp.view(np.int64)}) == want
