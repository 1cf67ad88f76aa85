"""Removal of passages that occurred before, by seed and extend over winnowed anchors.

Of every ``WINDOW`` consecutive words, the ``SEED`` words with the least hash are an anchor, so any two equal windows
share one, at the same place in them. Documents meet on the hashes of anchors that occur twice. Each anchor is extended
both ways as far as a window around it can reach; places where the whole extension is equal are grouped, and all but the
first hold nothing but windows that occurred before. Only the first places of an anchor with several different extensions
are left to look at word by word: the windows around them are hashed, and grouped in the same way. The windows found in
a document overlap into its maximal repeats.

So no pairs are made: a group keeps its first place, with which each of its others is compared, and a passage of very
many copies costs a row for every anchor of a copy. Sequences are compared by two hashes of 64 bits, that of the anchor
and that of what surrounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import materialize, mix64, range_hashes, sequence_hashes, sized_join, small_batches, tidy, word_spans

WINDOW, SEED = 20, 8
_WORD_BYTE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


class Words:
    """The words of several texts in a row, as hashes; ``doc`` has the number of each word's text."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])[: len(parts)]
        starts, ends = word_spans(data, _WORD_BYTE)
        self.hashes = range_hashes(data, starts, ends)
        self.doc = np.searchsorted(begins, starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(parts)))
        self.end = np.searchsorted(self.doc, np.arange(len(parts)), "right")

    def anchors(self, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of ``seed`` words from each place; the places where a window begins; and the anchor of each window."""
        n, reach = len(self.hashes), window - seed
        if n < window:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none
        at = np.arange(n - seed + 1)
        seeds = sequence_hashes(self.hashes, at, at + seed)
        count = n - window + 1
        least, chosen = seeds[:count].copy(), np.zeros(count, np.int64)
        for k in range(1, reach + 1):
            here = seeds[k : k + count]
            less = here < least
            np.copyto(least, here, where=less)
            chosen[less] = k
        whole = np.flatnonzero(self.doc[:count] == self.doc[window - 1 :])
        return seeds, whole, whole + chosen[whole]

    def extended(self, anchor: np.ndarray, window: int, seed: int) -> np.ndarray:
        """Hashes of all words that a window with the anchor can hold, and of how many stand before it."""
        begin = np.maximum(anchor - (window - seed), self.first[self.doc[anchor]])
        end = np.minimum(anchor + window, self.end[self.doc[anchor]])
        return mix64(sequence_hashes(self.hashes, begin, end) + (anchor - begin).astype(np.uint64))


#: What orders places; a document's key is the first two.
PLACE = ("id", "t", "pos")


def _key() -> Column:
    return F.struct("id", "t").alias("key")


def _firsts(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first place of each group, and the number of places."""
    return rows.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n"))


def _later(rows: DataFrame, firsts: DataFrame, by: list[str]) -> DataFrame:
    """The places that are not the first of their group."""
    # Written first: the aggregate's partitions would bind the join to them, and a group of very many places to one task.
    again = materialize(firsts.filter("n > 1").select(*by, "first"))
    return rows.join(again, by).filter(F.struct(*PLACE) != F.col("first"))


def repeats(keyed: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(key, pos, end): stretches of words, of ``window`` or more, that consist of windows which occurred before.

    ``keyed`` has id and t, by which documents come in order, and text; documents that share both have one text.
    Stretches overlap or touch inside a maximal repeat, and may go beyond the document's end.
    """
    small_batches(keyed.sparkSession)
    kind = keyed.schema["id"].dataType.simpleString()

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b["text"].to_pylist())
            hashes, _, anchor = words.anchors(window, seed)
            anchor = np.unique(anchor)
            doc = words.doc[anchor]
            yield pa.RecordBatch.from_arrays(
                [
                    b["id"].take(pa.array(doc)),
                    b["t"].take(pa.array(doc)),
                    pa.array((anchor - words.first[doc]).astype(np.int32)),
                    pa.array(hashes[anchor].view(np.int64)),
                    pa.array(words.extended(anchor, window, seed).view(np.int64)),
                ],
                names=["id", "t", "pos", "anchor", "around"],
            )

    # The wide joins are shuffles whatever the size: what meets here grows with the input.
    fields = f"id {kind}, t long, pos int, anchor long, around long"
    places = materialize(keyed.mapInArrow(tidy(seeds), fields))
    often = materialize(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    met = materialize(places.join(often, "anchor", "left_semi"))
    groups = materialize(_firsts(met, ["anchor", "around"]))
    reach = window - seed
    whole = _later(met, groups, ["anchor", "around"]).select(
        _key(), F.greatest(F.col("pos") - reach, F.lit(0)).alias("pos"), (F.col("pos") + window).alias("end")
    )
    # Anchors whose surroundings differ: the first place of each kind is looked at word by word.
    forks = materialize(groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    heads = groups.join(forks, "anchor", "left_semi").select("first.*")
    heads = materialize(heads.groupBy(_key()).agg(F.collect_list("pos").alias("at")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b["text"].to_pylist())
            hashes, start, anchor = words.anchors(window, seed)
            at = b["at"]
            marked = np.zeros(len(words.hashes) + 1, bool)
            marked[at.flatten().to_numpy() + np.repeat(words.first, np.diff(at.offsets.to_numpy()))] = True
            start, anchor = start[marked[anchor]], anchor[marked[anchor]]
            doc = words.doc[start]
            yield pa.RecordBatch.from_arrays(
                [
                    b["id"].take(pa.array(doc)),
                    b["t"].take(pa.array(doc)),
                    pa.array((start - words.first[doc]).astype(np.int32)),
                    pa.array(hashes[anchor].view(np.int64)),
                    pa.array(sequence_hashes(words.hashes, start, start + window).view(np.int64)),
                ],
                names=["id", "t", "pos", "anchor", "around"],
            )

    texts = sized_join(keyed.withColumn("key", _key()), heads, "key", "inner", F.size("at") * 4 + 96)
    windows = materialize(texts.select("id", "t", "text", "at").mapInArrow(tidy(look), fields))
    single = _later(windows, _firsts(windows, ["anchor", "around"]), ["anchor", "around"])
    return whole.unionByName(single.select(_key(), "pos", (F.col("pos") + window).alias("end")))


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``df`` without the words of windows that occurred before, with n_words, n_removed and repeats.

    A window is ``window`` consecutive words of a document; it occurred before if its words in the same order begin
    earlier: in a document of smaller id, or earlier in the same one. The first occurrence stays. Windows are judged on
    the input. ``repeats`` has the maximal removed stretches as begin and end (word numbers). The text becomes its kept
    words joined by single spaces; a null text stays null and has no words, like an empty or blank one. A null id comes
    before others; rows that share an id come in the order of a hash of their texts, and rows that repeat both are one
    document and keep the same words. Columns of ``df`` stay, but for any named n_words, n_removed or repeats, which are
    replaced. An empty table gives no rows.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"))
    keyed = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    spans = repeats(keyed, window, seed).groupBy("key").agg(F.collect_set(F.struct("pos", "end")).alias("spans"))
    spans = materialize(spans.select("key", F.col("spans.pos").alias("a"), F.col("spans.end").alias("b")))
    fields = [c for c in df.columns if c not in ("n_words", "n_removed", "repeats")]
    mark, begin, end = (f"_{c}" + "_" * max(map(len, df.columns)) for c in ("key", "begin", "end"))
    rows = df.select(*fields, key.alias(mark)).join(spans.toDF(mark, begin, end), mark, "left").drop(mark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, count, gone, found = [], [], [], []
            for text, starts, ends in zip(b[text_col].to_pylist(), b[begin], b[end]):
                words = (text or "").encode("utf-8", "replace").split()
                n, runs = len(words), np.zeros((0, 2), np.int64)
                if starts.is_valid:
                    edges = np.zeros(n + 2, np.int64)
                    np.add.at(edges, starts.values.to_numpy() + 1, 1)
                    np.add.at(edges, np.minimum(ends.values.to_numpy(), n) + 1, -1)
                    inside = np.cumsum(edges) > 0
                    runs = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
                    words = [words[k] for k in np.flatnonzero(~inside[1:-1])]
                texts.append(None if text is None else b" ".join(words).decode())
                count.append(n)
                gone.append(n - len(words))
                found.append([{"begin": x, "end": y} for x, y in runs.tolist()])
            out = [pa.array(texts, pa.string()) if c == text_col else b[c] for c in fields]
            spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            out += [pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(found, spans_type)]
            yield pa.RecordBatch.from_arrays(out, names=[*fields, "n_words", "n_removed", "repeats"])

    span = StructType().add("begin", "long").add("end", "long")
    schema = StructType([*df.select(*fields).schema]).add("n_words", "long").add("n_removed", "long").add("repeats", ArrayType(span))
    return rows.mapInArrow(tidy(cut), schema)


#: What the query gives, in DuckDB SQL over ``documents``.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS h FROM starts)
          QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT p.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS text
         FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
