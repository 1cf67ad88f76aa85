import hashlib
import random
import zlib

from siltstone.llm import periodic, queries


def brute(words, least=6, times=4):
    """All runs, period by period, each with no smaller period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = words[i : j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    for k in range(3000):
        letters = "ab" if k % 3 == 0 else "abcdefgh" if k % 3 == 1 else "abc"
        words = rng.choices(letters, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            unit = rng.choices(letters, k=rng.randint(1, 9))
            words[len(words) // 2 : len(words) // 2] = (unit * rng.randint(1, 8))[: rng.randint(1, 50)]
        words = [w.encode() for w in words]
        for least, times in ((6, 4), (3, 3), (1, 5)):
            runs = periodic.find_runs(words, least, times)
            assert [tuple(r) for r in runs.tolist()] == brute(words, least, times)
        assert [w for w, x in zip(words, periodic.repeated(runs, len(words))) if not x] == kept(words, brute(words, 1, 5))


def test_periods_that_end_in_each_other():
    words = b"a a b a a b a a b a a b a a b".split() + b"x".split() * 9 + b"y z y z y z y z y".split()
    assert periodic.find_runs(words).tolist() == [[0, 15, 3], [15, 9, 1], [24, 9, 2]]
    long = [f"w{k}".encode() for k in range(5000)] * 4
    assert periodic.find_runs(long).tolist() == [[0, 20000, 5000]]
    assert periodic.find_runs(long[:-1]).tolist() == []
    assert periodic.find_runs([b"w"] * 100_000).tolist() == [[0, 100_000, 1]]


def test_odd_rows(spark, odd, empty):
    rows = {(r.doc_id, r.n_words): r for r in periodic.periodic_runs(odd).collect()}
    assert rows[2, 0].collapsed == rows[3, 0].collapsed == rows[7, 0].collapsed == "" and rows[2, 0].runs == []
    assert rows[None, 7].collapsed == "a text without id but with words"
    (run,) = rows[5, 30_000].runs
    assert run == (0, 30_000, 977) and len(rows[5, 30_000].collapsed.split()) == 977
    assert len(periodic.periodic_runs(odd).collect()) == odd.count() and periodic.periodic_runs(empty).count() == 0


def test_query_is_brute_force(spark):
    """The query's digests over the smallest tables, from the contract's own words."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    edited = 0
    for r in queries.docs(spark, sf).collect():
        words, h = (r.text or "").encode().split(), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, edited = words[:a] + [words[a + (i - a) % p] for i in range(a, n)], edited + 1
        if n > 1500:
            continue
        runs = brute(words)
        row = got[r.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period, row.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()
    assert edited > 5 and len(got) == queries.docs(spark, sf).count()


def test_query_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and all(r.runs_sha256 and r.collapsed_sha256 for r in rows)
    assert [r.doc_id for r in rows].count(None) == 1
