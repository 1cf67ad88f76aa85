import random

from siltstone.llm import queries, substring_dedup


def brute(docs, window=20):
    """Kept words of each (order, text), windows counted one by one."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        words = text.split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out[key] = [w for k, w in enumerate(words) if k not in gone]
    return out


def planted(seed, count, vocabulary):
    rng = random.Random(seed)
    pool = [rng.choices(vocabulary, k=rng.randint(15, 60)) for _ in range(12)]
    docs = []
    for k in range(count):
        text = rng.choices(vocabulary, k=rng.randint(0, 50))
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(pool))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            if rng.random() < 0.3:
                part = part[rng.randint(0, 8) :]
            at = rng.randint(0, len(text))
            text[at:at] = part + rng.choices(vocabulary, k=rng.randint(0, 5))
        docs.append((k, " ".join(text)))
    return docs


def test_kept_words_are_those_of_brute_force(spark):
    for seed, vocabulary in ((1, [f"w{k}" for k in range(300)]), (2, list("abc")), (3, ["x"]), (4, list("ab"))):
        docs = planted(seed, 150, vocabulary)
        docs += [(1000 + k, docs[k % 7][1]) for k in range(60)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        want = brute(docs)
        got = substring_dedup.dedup_substrings(df).collect()
        assert len(got) == len(docs)
        for r in got:
            assert r.text.split() == want[r.doc_id], r.doc_id
            assert r.n_words - r.n_removed == len(want[r.doc_id]) and r.n_removed == sum(e - b for b, e in r.repeats)
            assert all(e - b >= 20 for b, e in r.repeats)


def test_repeats_are_maximal(spark):
    passage = " ".join(f"p{k}" for k in range(70))
    docs = [(1, f"a b c {passage} d"), (2, f"e {passage} f g"), (3, passage), (4, f"{passage} {passage}"), (5, " ".join(passage.split()[:19]))]
    rows = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1].repeats == [] and rows[2].repeats == [(1, 71)] and rows[2].text == "e f g"
    # where one copy meets the next, the windows across are new, but each of their words is in one that is not
    assert rows[3].repeats == [(0, 70)] and rows[4].repeats == [(0, 140)] and rows[5].repeats == []


def test_odd_rows(spark, odd, empty):
    out = substring_dedup.dedup_substrings(odd)
    assert out.columns == [*odd.columns, "n_words", "n_removed", "repeats"]
    rows = out.collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[2, 0].text is None and by[3, 0].text == "" and by[7, 0].text == "" and by[None, 7].n_removed == 0
    long = odd.filter("doc_id = 5").first().text.split()
    assert by[5, 30_000].text.split() == brute([(5, " ".join(long))])[5] and by[6, 30_001].n_removed == 30_000
    clash = odd.withColumnsRenamed({"_b": "n_words", "_h": "repeats", "fp": "key", "id": "spans"})
    assert substring_dedup.dedup_substrings(clash).count() == len(rows)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_ids_that_repeat_or_lack(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(None, f"{passage} a"), (None, f"{passage} a"), (1, f"{passage} b"), (1, f"{passage} b"), (2, f"c {passage}")]
    rows = sorted((str(r.doc_id), r.text, r.n_removed) for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert rows == sorted([("None", f"{passage} a", 0)] * 2 + [("1", "b", 30)] * 2 + [("2", "c", 30)])


def test_query_is_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    out = queries.op13_substring_dedup(spark, sf)
    assert sorted(map(tuple, out.collect())) == sorted(c.sql(queries.ORACLES["op13_substring_dedup"]).fetchall())
