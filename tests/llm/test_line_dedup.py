import duckdb
from pyspark.sql import functions as F

from siltstone.llm import line_dedup


def test_against_sql(documents):
    duck = duckdb.connect()
    duck.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = {r[0]: r[1:4] for r in duck.sql(line_dedup.SQL).fetchall()}
    rows = line_dedup.dedup_lines(documents).collect()
    assert {r.doc_id: (r.lines_total, r.lines_cut, len(r.text)) for r in rows} == want
    assert sum(r.lines_cut for r in rows) > 100


def test_chunks_join_to_the_text(odd):
    rows = odd.select("text", line_dedup.chunks(odd.text).alias("c")).collect()
    for r in rows:
        assert r.text is None and r.c is None or "\n".join(x.chunk for x in r.c) == r.text


def test_passages_keep_their_first_place(spark):
    passage = "\n".join(f"line {k} of a passage that several documents share" for k in range(12))
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"own start {k}\n{passage}\nown end {k}\n{long}") for k in range(5)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0].lines_cut == 0
    for k in range(1, 5):
        assert out[k].lines_cut > 1 and long not in out[k].text
        assert out[k].text.startswith(f"own start {k}") and f"own end {k}" in out[k].text


def test_short_lines_go_to_the_edges(spark):
    """Repeated passages of 50 words and more in lines of any length, by brute force on where they stand."""
    rows, kept = [], {}
    for each in (3, 5, 8, 15, 19):
        for n in range(-(-52 // each), -(-52 // each) + 4):
            lines = [" ".join(f"w{each}x{n}x{j}x{k}" for k in range(each)) for j in range(n)]
            for copy in range(3):
                own = [f"own {each} {n} {copy}", f"end {each} {n} {copy}"]
                kept[len(rows)] = "\n".join(own if copy else [own[0], *lines, own[1]])
                rows.append((len(rows), "\n".join([own[0], *lines, own[1]])))
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == kept


def test_short_repeats_stay_but_for_chunks(spark):
    """A pair of short lines under PASSAGE words goes only as a chunk; scripts without spaces have words too."""
    han = ["".join(chr(0x4E00 + 31 * j + k) for k in range(30)) for j in range(6)]
    rows = [(k, f"own{k}\n" + "\n".join(han) + f"\nend{k}") for k in range(2)] + [(k, f"begin{k}\n\n}}\nlast{k}") for k in (2, 3)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == "own1\nend1" and out[0].lines_cut == 0
    assert out[3].lines_cut in (0, 2)


def test_no_chunk_that_can_go_is_left_twice(documents):
    out = line_dedup.dedup_lines(documents)
    whole = out.filter("lines_cut = 0").select(F.explode(line_dedup.chunks(F.col("text"))).alias("c")).filter("c.can_go")
    assert whole.groupBy("c.chunk").count().filter("count > 1").count() == 0


def test_clashing_names(odd):
    names = {"_b": "_gone", "_h": "_key", "fp": "_rest", "id": "lines_cut"}
    out = line_dedup.dedup_lines(odd.withColumnsRenamed(names))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_gone", "_key", "_rest", "lines_total", "lines_cut"]
    assert {(r._gone, r._key, r._rest) for r in out.collect()} == {("b", "h", "f")}


def test_odd_rows(odd, empty):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == {*odd.columns, "lines_total", "lines_cut"}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].text is None and by_id[2].lines_total == 0
    assert by_id[3].text == "" and by_id[3].lines_total == 1
    assert [r.lines_cut for r in rows if r.doc_id == 1] == [0, 0]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_a_run_goes_only_as_far_as_one_earlier_place_holds_it(spark):
    """Seven lines whose neighbours all stood side by side before, but never all together, stay; what one document has goes."""
    lines = [f"line {c} of six words here" for c in "ABCDEFG"]
    rows = [(k, f"{lines[k]}\n{lines[k + 1]}") for k in range(6)] + [(6, "\n".join(lines))]
    rows += [(7, "\n".join(["begin", *lines[1:7], "end"]))]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[6] == rows[6][1]
    assert out[7] == "begin\nend"


def test_stretches_against_brute_force(spark):
    """Which lines go for stretches of PASSAGE words, by counting every stretch of every text."""
    import random

    rng = random.Random(3)
    pool = ["", " "] + [" ".join(f"w{k}{j}" for j in range(rng.randint(1, 14))) for k in range(14)]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(0, 40)))) for k in range(60)]
    rows += [(100 + k, rows[k][1] + "\nlast") for k in range(0, 60, 7)]
    got = {}
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.explode(line_dedup.units(F.col("text"))).alias("u")).filter("u.stretch")
    for r in frame.collect():
        got.setdefault(r.doc_id, set()).add((r.u.place, r.u.place + r.u.lines - 1, r.u.chunk))
    for k, text in rows:
        lines = text.split("\n")
        words = [len(x.split()) for x in lines]
        want = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines)):
                enough = lambda x, y: sum(words[x : y + 1]) >= line_dedup.PASSAGE
                tight = not enough(a, b - 1) or not enough(a + 1, b)
                if words[a] and words[b] and enough(a, b) and tight:
                    want.add((a, b, "\n".join(lines[a : b + 1])))
        # from a line on the fewest lines, and up to a line the fewest
        want = {w for w in want if not any(v[0] == w[0] and v[1] < w[1] for v in want) or not any(v[1] == w[1] and v[0] > w[0] for v in want)}
        assert got.get(k, set()) == want, k
