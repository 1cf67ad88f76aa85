"""Removal of passages that repeat across documents, by content-defined chunks of lines.

A chunk ends after a line where a rolling hash over the hashes of this line and the one before it is a multiple of
``DIVISOR``, so the chunks of a passage are the same wherever it stands. A line of weight ``LONG_LINE`` or more is a
chunk by itself. Chunks of several lines, and long lines, that occur more than once anywhere are compared byte by byte;
all but the first occurrence, by document and place, are cut.

What boundaries leave of a passage is found by stretches of lines of just ``PASSAGE`` words or more, one from each line on
and one up to each line, compared in the same way: all but the first occurrence of each are cut. So a repeated passage of
that many words goes up to its edges, however short its lines are, and no line goes for occurring before only beside other
lines than here. Each line that goes has a copy earlier on; the first copy of a line never goes. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_join

DIVISOR = 3
LONG_LINE = 20
PASSAGE = 30


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def weight(line: Column) -> Column:
    """The gaps between a line's words; an eighth of the further bytes of its characters stands for them in scripts without."""
    bare = F.ltrim(line, F.lit(" "))
    gaps = F.length(bare) - F.length(F.translate(bare, " \t", ""))
    return gaps + F.floor((F.octet_length(line) - F.length(line)) / 8).cast("int")


def _marks(lines: Column) -> Column:
    """Of each line its hash, words, and whether it is long."""

    def mark(x: Column, w: Column) -> Column:
        words = F.when(F.trim(x, F.lit(" ")) == "", 0).otherwise(w + 1)
        return F.struct(F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long").alias("h"), words.alias("words"), (w >= LONG_LINE).alias("long"))

    return F.transform(lines, lambda x: bind(weight(x), lambda w: mark(x, w)))


def _unit(place: Column, lines: Column, stretch: bool, text: Column, can_go: Column) -> Column:
    fields = {"place": place, "lines": lines, "stretch": F.lit(stretch), "chunk": text, "can_go": can_go}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _chunks(lines: Column, m: Column) -> Column:
    def is_end(_: Column, i: Column) -> Column:
        # get() gives null beyond either end
        here, rolled = F.get(m, i), F.coalesce(F.get(m, i - 1)["h"], F.lit(0)) * 31 + F.get(m, i)["h"]
        return (rolled % DIVISOR == 0) | here["long"] | F.coalesce(F.get(m, i + 1)["long"], F.lit(True))

    def piece(begin: Column, end: Column) -> Column:
        chunk = F.array_join(F.slice(lines, begin + 1, end - begin + 1), "\n")
        can_go = lambda c: ((end > begin) | F.get(m, begin)["long"]) & (F.trim(c) != "")
        return bind(chunk, lambda c: _unit(begin, end - begin + 1, False, c, can_go(c)))

    ends = F.transform(F.filter(F.transform(m, lambda x, i: F.struct(i.alias("i"), is_end(x, i).alias("e"))), lambda x: x["e"]), lambda x: x["i"])
    return bind(ends, lambda e: F.transform(e, lambda end, k: piece(F.coalesce(F.get(e, k - 1) + 1, F.lit(0)), end)))


def _stretches(lines: Column, m: Column) -> Column:
    """From each line that is not blank, and up to each, the fewest lines of PASSAGE words; none of one line or of long lines only."""
    full = F.filter(F.transform(m, lambda x, i: F.struct(i.alias("i"), x["words"].alias("words"), x["long"].alias("long"))), lambda x: x["words"] > 0)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("last"), F.lit(True).alias("long"))

    def add(s: Column, x: Column) -> Column:
        more = F.struct((s["sum"] + x["words"]).alias("sum"), (s["n"] + 1).alias("n"), x["words"].alias("last"), (s["long"] & x["long"]).alias("long"))
        return F.when(s["sum"] >= PASSAGE, s).otherwise(more)

    def text(begin: Column, end: Column) -> Column:
        return F.array_join(F.slice(lines, begin + 1, end - begin + 1), "\n")

    def unit(good: Column, begin: Column, end: Column) -> Column:
        return F.when(good, _unit(begin, end - begin + 1, True, text(begin, end), F.lit(True)))

    def ahead(b: Column, x: Column, k: Column) -> Column:
        enough = lambda s: (s["sum"] >= PASSAGE) & (s["n"] > 1) & ~s["long"]
        return bind(F.aggregate(F.slice(b, k + 1, F.lit(PASSAGE)), start, add), lambda s: unit(enough(s), x["i"], F.get(b, k + s["n"] - 1)["i"]))

    def back(b: Column, x: Column, k: Column) -> Column:
        # One that has enough words without its last line is not the one from its first line on.
        enough = lambda s: (s["sum"] - x["words"] >= PASSAGE) & (s["n"] > 1) & ~s["long"]
        part = F.reverse(F.slice(b, F.greatest(k - PASSAGE + 2, F.lit(1)), F.least(k + 1, F.lit(PASSAGE))))
        return bind(F.aggregate(part, start, add), lambda s: unit(enough(s), F.get(b, k - s["n"] + 1)["i"], x["i"]))

    both = lambda b: F.concat(F.transform(b, lambda x, k: ahead(b, x, k)), F.transform(b, lambda x, k: back(b, x, k)))
    return F.filter(bind(full, both), lambda u: u.isNotNull())


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks(text: Column) -> Column:
    """An array of structs whose chunks, joined by line feeds, are the text; can_go where a repeated one is cut."""
    return bind(_split(text), lambda lines: bind(_marks(lines), lambda m: _chunks(lines, m)))


def units(text: Column) -> Column:
    """The chunks, and the stretches behind them."""
    return bind(_split(text), lambda lines: bind(_marks(lines), lambda m: F.concat(_chunks(lines, m), _stretches(lines, m))))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated chunks cut from its texts, and lines_total and lines_cut.

    The first occurrence, by id, a hash of the whole text, and place, stays. A null text stays null, with no lines;
    an empty one is one empty line. A null id comes before others. Rows that repeat both id and text count as one
    document and keep or lose the same chunks. Columns of ``df`` stay, but for any named lines_total or lines_cut,
    which are replaced. An empty table gives no rows.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t")).alias("_key")
    keyed = df.select(key, F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    parts = keyed.select("_key", F.explode(units(F.col("_text"))).alias("_c")).filter("_c.can_go")
    parts = parts.select("_key", *[F.col(f"_c.{c}").alias(f"_{c}") for c in ("place", "lines", "stretch", "chunk")])
    parts = parts.withColumn("_hash", F.xxhash64("_chunk", "_stretch")).withColumn("_size", F.octet_length("_chunk"))
    often = materialize(parts.groupBy("_hash", "_size").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    maybe = materialize(sized_join(parts, often, ["_hash", "_size"], "left_semi", 24))
    same = maybe.groupBy("_hash", "_stretch", "_chunk").agg(F.min(F.struct("_key", "_place")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Written first: the aggregate's partitions would bind the join to them, and a chunk of very many places to one task.
    later = maybe.join(materialize(same), ["_hash", "_stretch", "_chunk"]).filter(F.struct("_key", "_place") != F.col("_first"))
    gone = materialize(later.groupBy("_key").agg(F.collect_set(F.struct("_place", "_lines")).alias("_gone")))
    # Columns of our own by names that none of the table's has.
    fields = [c for c in df.columns if c not in ("lines_total", "lines_cut")]
    mark, away, left = (f"_{c}" + "_" * max(map(len, df.columns)) for c in ("key", "gone", "rest"))
    gone = gone.toDF(mark, away)
    out = sized_join(df.withColumn(mark, key), gone, mark, "left", F.size(away) * 16 + 96)
    lost = F.flatten(F.transform(away, lambda s: F.sequence(s["_place"], s["_place"] + s["_lines"] - 1)))

    def rest(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        return bind(places, lambda p: F.struct(
            F.array_join(F.transform(p, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(p)).alias("cut")
        ))

    text = F.col(text_col)
    out = out.withColumn(left, F.when(F.col(away).isNotNull(), bind(_split(text), rest)))
    total = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    kept = [F.coalesce(F.col(f"{left}.text"), text).alias(c) if c == text_col else F.col(c) for c in fields]
    return out.select(*kept, total.cast("long").alias("lines_total"), F.coalesce(F.col(f"{left}.cut"), F.lit(0)).cast("long").alias("lines_cut"))


#: The same in DuckDB SQL, over ``documents``.
SQL = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
weighed AS (SELECT *, length(ltrim(line, ' ')) - length(translate(ltrim(line, ' '), ' ' || chr(9), ''))
            + (strlen(line) - length(line)) // 8 AS weight FROM lines),
marks AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h, weight >= 20 AS long,
          CASE WHEN trim(line, ' ') = '' THEN 0 ELSE weight + 1 END AS words FROM weighed),
ends AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 31 + h) % 3 = 0 OR long OR coalesce(lead(long) OVER w, true) AS e
         FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ends),
chunked AS (SELECT doc_id, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n, bool_or(long) AS long FROM placed GROUP BY doc_id, c),
chunks_gone AS (SELECT doc_id, i AS a, i + n - 1 AS b FROM chunked WHERE (n > 1 OR long) AND trim(chunk) <> ''
                QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, i) > 1),
filled AS (SELECT doc_id, i, words, sum(words) OVER w AS upto, sum((NOT long)::INT) OVER w AS short, (NOT long)::INT AS own
           FROM marks WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
from_line AS (SELECT doc_id, i, upto, short, own, upto - words + 30 AS least, upto - words AS before, upto - 30 AS most FROM filled),
stretches AS (SELECT a.doc_id, a.i AS a, b.i AS b, b.short - a.short + a.own AS short FROM from_line a ASOF JOIN from_line b ON a.doc_id = b.doc_id AND a.least <= b.upto
              UNION SELECT a.doc_id, b.i, a.i, a.short - b.short + b.own FROM from_line a ASOF JOIN from_line b ON a.doc_id = b.doc_id AND a.most >= b.before),
stretches_gone AS (SELECT doc_id, a, b FROM (SELECT s.doc_id, a, b, array_to_string(ls[a + 1 : b + 1], chr(10)) AS t FROM stretches s JOIN split USING (doc_id) WHERE b > a AND short > 0)
                   QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM (SELECT * FROM chunks_gone UNION ALL SELECT * FROM stretches_gone)),
kept AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text,
         count(*) AS lines_total, count(g.i) AS lines_cut FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.lines_total, 0) AS lines_total, coalesce(k.lines_cut, 0) AS lines_cut,
       length(k.text)::BIGINT AS kept_chars, md5(k.text) AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
