"""Periodic runs of words: stretches that repeat with a period, such as text that a generator or a scraper looped.

A text's words are named by the dictionary of basic factors: factors of one word get numbers, and those of twice the
length get numbers from the pairs of their halves, a power of two after the other, until no factor occurs twice. At each
length the next occurrence of a factor within the length itself (so that both lie in a window of twice the length)
proposes the distance as a period; neighbouring places that propose the same one are an arithmetic progression of
occurrences, and together span a run.

For a period of q words the length between q and 2q is the one that counts: there a factor recurs after q words exactly,
since it holds a whole period, which equals none of its rotations. So the progression begins and ends where the run does,
and no run of three periods or more is missed. Longer factors propose the same run again, which is taken once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_key, from_key, small_batches, tidy

#: A run has so many words at least, and so many of its periods.
LEAST_WORDS, LEAST_TIMES = 6, 4


def split_words(text: str | None) -> list[bytes]:
    """The words between the six ASCII spaces."""
    return (text or "").encode("utf-8", "replace").split()


def find_runs(words: list[bytes], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of ``least`` words and ``times`` (3 or more) periods, in order."""
    n, span, found = len(words), 1, []
    codes: dict[bytes, int] = {}
    key = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    at = np.arange(n)
    # Factors of up to twice the longest period that a run can have.
    while len(at) and times * span < 2 * n:
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        same = key[1:] == key[:-1]
        if not same.any():
            break
        gap = np.zeros(n + 1, np.int64)
        gap[place[:-1][same]] = (place[1:] - place[:-1])[same]
        gap[gap > span] = 0
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        begin = np.concatenate([[0], edge])
        begin, end = begin[:-1], begin[1:]
        period = gap[begin]
        length = end - begin - 1 + period + span
        good = (period > 0) & (length >= np.maximum(least, times * period))
        found.append(np.stack([begin[good], length[good], period[good]], axis=1))
        # Only factors that occur twice can be halves of such.
        shared = np.append(same, False) | np.append(False, same)
        name = np.full(n, -1)
        name[place[shared]] = np.append(0, np.cumsum(~same))[shared]
        at = np.flatnonzero((name[: max(n - span, 0)] >= 0) & (name[span:] >= 0))
        key = name[at] * n + name[at + span]
        span *= 2
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Of n words, which lie in a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:n] > 0


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """One row per row of ``df``: id, n_words, runs (an array of start, length and period, by start and then period) and
    collapsed, the text with each run cut to its first period and its words joined by single spaces.

    A run is a maximal stretch of words with a smallest period q and of ``least`` words and ``times`` * q or more. Null,
    empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows give a row each; a null id
    stays null. An empty table gives no rows; other columns are not read. A text is worked on whole, in memory that
    grows with its words.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text in zip(b["_id"], b["_t"]):
                words = split_words(text)
                n, runs = len(words), find_runs(words, least, times)
                if len(runs):
                    words = [words[k] for k in np.flatnonzero(~repeated(runs, n))]
                out.append((key, n, *runs.T, b" ".join(words).decode()))
            yield pd.DataFrame(out, columns=["id", "n_words", "start", "length", "period", "collapsed"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(as_key(F.col(id_col)).alias("_id"), F.col(text_col).alias("_t"))
    fields = "id string, n_words long, start array<long>, length array<long>, period array<long>, collapsed string"
    out = rows.mapInPandas(tidy(run), fields)
    return out.select(from_key(F.col("id"), kind).alias(id_col), "n_words", F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")
