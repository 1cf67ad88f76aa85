"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document's whole windows are cut off first. What remains goes, as it arrives, to the fill level for which the sum
of squared counts of partially filled windows becomes least: the counts per level are an array, and all levels are
weighed at once. When a packer's rows end, its emptiest open windows are cut to fill the gaps of the fullest, so at
most one window of a packer is padded. Every partition of the input is a packer of its own; it holds open windows
only, and its output depends on its rows and their order alone, so a lost task is simply run again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, as_key, from_key, small_batches, tidy

WINDOW = 2048
END_ID = 1
#: Words whose ids a Python worker remembers, and the bytes that they take there, texts, ids and table slots together; others
#: are encoded again. It bounds memory, not results.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 160 << 20
#: What an entry takes besides its letters and ids: the heads of two objects and its share of the table.
ENTRY_BYTES = 176
#: A word is remembered when it is met in a second batch; one byte for each of so many hash values tells.
SEEN_SLOTS = 1 << 22
#: Texts are encoded together up to so many characters; longer ones are cut between ASCII words.
ENCODE_CHARS = 1 << 20
#: More than any count of windows.
EMPTY = 1 << 60
#: A control character that is a token by itself.
MARK = "\x01"
_TOKENIZERS: dict[str, WordTokenizer] = {}
KEPT["packing"] = _TOKENIZERS.clear
#: Long stretches of a text that end between two ASCII letters or digits with a space between them, or at its end.
_STRETCH = re.compile(rf"(?s).{{{ENCODE_CHARS - 1}}}.*?(?:(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])|\Z)|.+\Z")


class WordTokenizer:
    """Token ids of whole texts as the tokenizer gives them, encoded word by word with a bounded cache.

    It holds for lower-casing tokenizers that squeeze white space and part letters from punctuation, as those with
    word-end marks do. What is not safe to take apart is encoded as it is: texts with the beginning of a special
    token, and the words with other than ASCII characters whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Words met lately and, of the generation before, those to be met again: words in use stay, others go.
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.seen = bytearray(SEEN_SLOTS)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out, held, size = [], [], 0
        for t in texts:
            t = t or ""
            if any(x in t for x in self.specials):
                out += [*self._words(held), np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
                held, size = [], 0
                continue
            parts = [t]
            if len(t) > ENCODE_CHARS:
                parts = [m[0] for m in _STRETCH.finditer(t)]
            if len(parts) > 1 or size + len(t) > ENCODE_CHARS:
                out += self._words(held)
                held, size = [], 0
            if len(parts) > 1:
                out.append(b"".join(self._words([p])[0] for p in parts))
            else:
                held.append(t)
                size += len(t)
        return out + self._words(held)

    def _words(self, texts: list[str]) -> list[bytes]:
        cache = self.cache
        texts = [_lower(t).replace("\n", " ").split(" ") for t in texts]
        parts = [list(map(cache.get, words)) for words in texts]
        lacking = [k for k, ids in enumerate(parts) if None in ids]
        fresh = {w for k in lacking for w, ids in zip(texts[k], parts[k]) if ids is None}
        if fresh and self.older:
            again = {w: ids for w in fresh if (ids := self.older.get(w)) is not None}
            cache.update(again)
            self.size += sum(ENTRY_BYTES + len(w) + len(ids) for w, ids in again.items())
            if self.size > CACHE_BYTES // 2:
                self._turn()
            fresh -= again.keys()
            for k in lacking:
                parts[k] = [again.get(w) if ids is None else ids for w, ids in zip(texts[k], parts[k])]
            lacking = [k for k in lacking if None in parts[k]]
        if fresh:
            marked = {w for w in fresh if len(w) > 1 and w[-1] in ".," and w[-2].isalpha() and w.isascii()}
            bare = {w[:-1] for w in marked} | {".", ","}
            found = self._encoded([*(fresh - marked), *(w for w in bare - fresh if w not in cache)])
            for w in marked:
                a, b = w[:-1], w[-1]
                found[w] = (found.get(a) or cache[a]) + (found.get(b) or cache[b])
            for k in lacking:
                parts[k] = [found[w] if ids is None else ids for w, ids in zip(texts[k], parts[k])]
            keep, size, seen = {}, 0, self.seen
            for w, ids in found.items():
                slot = hash(w) & SEEN_SLOTS - 1
                if not seen[slot]:
                    seen[slot] = 1
                elif len(w) <= 64 and len(keep) < CACHE_WORDS // 2 and size < CACHE_BYTES // 2:
                    keep[w] = ids
                    size += ENTRY_BYTES + len(w) + len(ids)
            if len(cache) + len(keep) > CACHE_WORDS // 2 or self.size + size > CACHE_BYTES // 2:
                self._turn()
            self.cache.update(keep)
            self.size += size
        return [b"".join(ids) for ids in parts]

    def _turn(self) -> None:
        """What was met lately becomes what goes unless it is met again."""
        self.older, self.cache, self.size, self.seen = self.cache, {"": b""}, 0, bytearray(SEEN_SLOTS)

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids by word, many in one call with a mark between them that no word has."""
        plain, out = [w for w in words if MARK not in w], {}
        cuts = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        done = self.tokenizer.encode_batch_fast([f" {MARK} ".join(part) for part in cuts], add_special_tokens=False)
        for part, encoding in zip(cuts, done):
            ids = np.array(encoding.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                out[w] = raw[4 * at : 4 * end]
                at = end + 1
        for w in words:
            if MARK in w:
                out[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return out


def _lower(text: str) -> str:
    """In lower case where that changes no id: characters up to 255 have no composed forms or context rules. It only lets
    more words be found in the cache; the tokenizer lower-cases by itself."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class SumOfSquares:
    """Open windows by fill level; ``count[level]`` windows hold ``level`` tokens."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.less = np.full(window + 1, EMPTY)  # -count, and EMPTY where there is no window to take
        self.open: dict[int, list[list[tuple]]] = {}

    def _add(self, level: int, n: int) -> None:
        self.count[level] += n
        self.less[level] = -self.count[level] or EMPTY

    def place(self, length: int, piece: tuple) -> list[tuple] | None:
        """Put a piece of 1 to window-1 tokens; the window's pieces if it is now full."""
        top = self.window - length
        # Half the change of the sum of squares, less 1, if a window of each level between takes the piece.
        change = self.count[length + 1 : self.window] + self.less[1:top]
        # Level 0 opens a window; the top level fills one. Of equals the fullest is taken.
        choice = [(2 * int(self.count[length]) + 1, 0)]
        if top > 1:
            at = top - 2 - int(change[::-1].argmin())
            choice.append((2 * int(change[at]) + 2, -1 - at))
        if self.count[top]:
            choice.append((1 - 2 * int(self.count[top]), -top))
        level = -min(choice)[1]
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self._add(level, -1)
        pieces.append((*piece, length, level))
        if level + length == self.window:
            return pieces
        self.open.setdefault(level + length, []).append(pieces)
        self._add(level + length, 1)
        return None

    def close(self) -> Iterator[list[tuple]]:
        """Empty all open windows, cutting pieces of the emptiest into the gaps of the fullest."""
        left = [p for level in sorted(self.open) for p in self.open[level]]
        self.open, low, high = {}, 0, len(left) - 1
        self.count[:], self.less[:] = 0, EMPTY
        while low <= high:
            window = left[high]
            fill = window[-1][-1] + window[-1][-2]
            high -= 1
            while fill < self.window and low <= high:
                key, start, length, _ = left[low].pop()
                take = min(length, self.window - fill)
                window.append((key, start + length - take, take, fill))
                fill += take
                if take < length:
                    left[low].append((key, start, length - take, _))
                elif not left[low]:
                    low += 1
            yield window


def pack(
    df: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset.

    A document is its text's ids and then ``end_id``; a null or empty text is the end mark alone. Pieces of repeated
    rows are theirs each. Within a sequence offsets have no gaps. An empty table gives no rows; other columns are not
    read. ``sequence_id`` is the packer's number times 2**32 plus the window's number there.
    """
    small_batches(df.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, packer = WordTokenizer.get(tokenizer_path), SumOfSquares(window)
        base, made, row = TaskContext.get().partitionId() << 32, 0, 0
        tails: dict[int, list] = {}  # row: id, where its tail starts, the tail's ids, all tokens, tokens not yet given out
        columns = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def emit(windows: list[list[tuple]]) -> list[tuple]:
            nonlocal made
            out = []
            for w in windows:
                for key, start, length, offset in w:
                    tail = tails[key]
                    at = start - tail[1]
                    out.append((tail[0], start, length, tail[2][4 * at : 4 * (at + length)], tail[3], base + made, offset))
                    tail[4] -= length
                    if not tail[4]:
                        del tails[key]
                made += 1
            return out

        for b in batches:
            out = []
            for k, ids in zip(b["_id"], words.encode(b["_t"].tolist())):
                ids += end
                n, row = len(ids) // 4, row + 1
                whole = n - n % window
                for s in range(0, whole, window):
                    out.append((k, s, window, ids[4 * s : 4 * (s + window)], n, base + made, 0))
                    made += 1
                if n > whole:
                    tails[row] = [k, whole, ids[4 * whole :], n, n - whole]
                    if done := packer.place(n - whole, (row, whole)):
                        out += emit([done])
            if out:
                yield pd.DataFrame(out, columns=columns)
        if rest := list(packer.close()):
            for k in range(0, len(rest), 256):
                yield pd.DataFrame(emit(rest[k : k + 256]), columns=columns)

    kind = df.schema[id_col].dataType.simpleString()
    pieces = df.select(as_key(F.col(id_col)).alias("_id"), F.col(text_col).alias("_t")).mapInPandas(
        tidy(run, "packing"), "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumn("id", from_key(F.col("id"), kind)).withColumnRenamed("id", id_col)


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
