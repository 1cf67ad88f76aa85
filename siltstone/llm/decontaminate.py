"""Benchmark decontamination by spaced seeds.

Each mask selects some of a few consecutive words and ignores the others, so a hash of the selected ones survives
substitutions at the ignored places. Training texts keep the hashes that pass a Bloom filter of fixed size built from
the test hashes; these are joined with the test hashes, and around each hit the two token sequences are laid side by
side: a stretch counts if at least ``SIMILARITY`` of its words are equal. The masks fit somewhere in every stretch of 8
words or more that counts; shorter passages have masks of their own, which leave out each word that may differ.

Surroundings of hits that are alike, word for word, are one class: a class is compared with a passage once, however many
documents hold it. A hash that many classes and passages share is split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_key, from_key, materialize, mix64, range_hashes, salted_join, sized_join, small_batches, tidy, word_spans

#: 1 for the words that are compared; five each.
MASKS = ("111011", "1101011", "11001101", "101100101")
#: Words of a stretch that decides, or all of a shorter passage, and the share of equal words in it.
STRETCH, SIMILARITY = 13, 0.8
#: Passages of fewer words have masks of their own.
SHORT = 8
#: The Bloom filter has two tables of 2**bits bits: eight bits or more for each test hash, within these bounds. Beyond the
#: upper one more hashes pass it, and the join sorts them out.
FILTER_BITS = (20, 28)
_WORD_BYTE = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased runs of letters, digits and other characters beyond ASCII."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    return range_hashes(data, *word_spans(data, _WORD_BYTE))


def short_masks(n: int) -> list[str]:
    """Masks for passages of ``n`` words, of which 1 - SIMILARITY may differ: all words, or all but one."""
    whole = "1" * n
    return [whole] if n - 1 < SIMILARITY * n else [whole[:k] + "0" + whole[k + 1 :] for k in range(n)]


def seeds(tokens: np.ndarray, masks: list[str] | tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """For each mask, the hash at each position where it fits."""
    out = []
    for mask in masks:
        n = len(tokens) - len(mask) + 1
        total = np.full(max(n, 0), np.uint64(int(mask, 2) << 8 | len(mask)))
        for at in np.flatnonzero([c == "1" for c in mask]):
            if n > 0:
                total = total * np.uint64(0xD6E8FEB86659FD93) + tokens[at : at + n]
        out.append(mix64(total))
    return out


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return (hashes & low).astype(np.int64), (hashes >> np.uint64(32) & low).astype(np.int64)


def _filter(hashes: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """Packed bits, lowest first, at the slots that occur; made in tables of 32,768 bits by the executors."""
    rows = hashes.groupBy(F.shiftright(slot, 15).alias("k")).agg(F.bitmap_construct_agg(slot.bitwiseAND(0x7FFF)).alias("b")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[4096 * r["k"] : 4096 * (r["k"] + 1)] = np.frombuffer(r["b"], np.uint8)
    return out


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Equal words, start and end in ``doc`` of the qualifying stretches with doc[j] beside item[j - shift]."""
    begin, end = max(0, shift), min(len(doc), shift + len(item))
    n = min(STRETCH, len(item))
    if end - begin < n:
        return None
    same = doc[begin:end] == item[begin - shift : end - shift]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[n:] - sums[:-n] >= SIMILARITY * n)
    if not len(good):
        return None
    inside = np.zeros(end - begin, bool)
    for g in good:
        inside[g : g + n] = True
    return int((same & inside).sum()), begin + int(good[0]), begin + int(good[-1]) + n


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per pair of a document and a benchmark passage that overlap: id, item, equal_words, item_words, first_word, end_word.

    A stretch of 13 words, or a whole shorter passage, overlaps where at least SIMILARITY of its words are equal: one word
    of five to nine may differ, two of ten to thirteen, none of fewer. Word positions are those of the best overlap in the
    document. Null and empty texts overlap nothing. Passages that share an id, or have none, are compared each and give
    one row an id. Repeated rows of one id give one row a passage; rows with a null id give one row a passage with a null
    id. Empty tables give no rows; other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["item"], b["t"]):
                tokens = token_hashes(text)
                masks = MASKS if len(tokens) >= SHORT else short_masks(len(tokens)) if len(tokens) else []
                for mask, hashes in enumerate(seeds(tokens, masks)):
                    out += [(item, int(h), p, None if mask or p else tokens.tobytes(), len(tokens)) for p, h in enumerate(hashes.view(np.int64))]
            yield pd.DataFrame(out, columns=["item", "h", "p", "item_tokens", "words"])

    # A passage is known by its id and text, so that ids may repeat or be null.
    item = F.concat(as_key(F.col(item_col)), F.lit("|"), F.md5(F.encode(F.coalesce(F.col(item_text_col), F.lit("")), "UTF-8")))
    items = benchmark.select(item.alias("item"), F.col(item_text_col).alias("t")).distinct()
    tests = materialize(items.mapInPandas(index, "item string, h long, p int, item_tokens binary, words int"))
    short = sorted(r["words"] for r in tests.filter(F.col("words") < SHORT).select("words").distinct().collect())  # at most SHORT - 1
    masks = [*MASKS, *(m for n in short for m in short_masks(n))]
    bits = min(max(FILTER_BITS[0], int(8 * tests.count()).bit_length()), FILTER_BITS[1])
    low = F.lit((1 << bits) - 1)
    filters = [_filter(tests, slot.cast("long"), bits) for slot in (F.col("h").bitwiseAND(low), F.shiftright("h", 32).bitwiseAND(low))]
    filters = spark.sparkContext.broadcast(filters)  # at most 2 * 2**28 bits

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = filters.value
        there = lambda table, at: table[at >> 3] >> (at & 7).astype(np.uint8) & 1
        longest = max(map(len, masks))
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["t"]):
                tokens = token_hashes(text)
                hits = []
                for hashes in seeds(tokens, masks):
                    a, c = _slots(hashes, bits)
                    at = np.flatnonzero(there(one, a))
                    at = at[there(two, c[at]) > 0]
                    hits += zip(at.tolist(), hashes[at].view(np.int64).tolist())
                hits.sort()
                group: list = []
                for h in [*hits, (1 << 60, 0)]:
                    if group and h[0] > group[-1][0] + longest:
                        begin = max(0, group[0][0] - STRETCH)
                        upto = group[-1][0] + longest + STRETCH
                        around, at = tokens[begin:upto].tobytes(), [g[0] - begin for g in group]
                        alike = hashlib.blake2b(len(around).to_bytes(8, "little") + around + np.array(at, np.int64).tobytes(), digest_size=16)
                        out.append((alike.digest(), key, begin, around, at, [g[1] for g in group]))
                        group = []
                    group.append(h)
            yield pd.DataFrame(out, columns=["class", "id", "begin", "tokens", "at", "h"])

    texts = df.select(as_key(F.col(id_col)).alias("id"), F.col(text_col).alias("t"))
    runs = materialize(texts.mapInPandas(tidy(find), "class binary, id string, begin long, tokens binary, at array<long>, h array<long>"))
    hits = runs.select("class", F.explode(F.arrays_zip("at", "h")).alias("x")).select("class", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    hits = materialize(sized_join(hits, tests.select("h").distinct(), "h", "left_semi", 16).distinct())
    pairs = salted_join(hits, tests.select("h", "p", "item"), "h", F.octet_length("item") + 40)
    pairs = materialize(pairs.select("class", "item", (F.col("at") - F.col("p")).alias("shift")).distinct())
    classes = sized_join(runs.select("class", "tokens"), pairs.select("class").distinct(), "class", "left_semi", 48).dropDuplicates(["class"])
    pairs = sized_join(pairs, tests.groupBy("item").agg(F.max("item_tokens").alias("item_tokens")), "item", "inner", F.octet_length("item_tokens") + 64)
    pairs = pairs.join(classes, "class")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for alike, item, shift, doc, passage in zip(b["class"], b["item"], b["shift"], b["tokens"], b["item_tokens"]):
                passage = np.frombuffer(passage, np.uint64)
                if found := overlap(np.frombuffer(doc, np.uint64), passage, shift):
                    out.append((alike, item, found[0], len(passage), found[1], found[2]))
            yield pd.DataFrame(out, columns=["class", "item", "equal_words", "item_words", "first_word", "end_word"])

    fields = "class binary, item string, equal_words long, item_words long, first_word long, end_word long"
    found = pairs.select("class", "item", "shift", "tokens", "item_tokens").mapInPandas(tidy(verify), fields)
    best = F.max(F.struct("equal_words", "item_words", (-F.col("first_word")).alias("f"), "end_word")).alias("b")
    found = materialize(found.withColumn("item", F.regexp_replace("item", r"\|[0-9a-f]{32}$", "")).groupBy("class", "item").agg(best).select("class", "item", "b.*"))
    members = salted_join(runs.select("class", "id", "begin"), found, "class", F.octet_length("item") + 80)
    members = members.withColumns({"first_word": F.col("begin") - F.col("f"), "end_word": F.col("begin") + F.col("end_word")})
    found = members.groupBy("id", "item").agg(best)
    return found.select(
        from_key(F.col("id"), kind).alias(id_col), from_key(F.col("item"), item_kind).alias(item_col), "b.equal_words", "b.item_words", (-F.col("b.f")).alias("first_word"), "b.end_word"
    )
