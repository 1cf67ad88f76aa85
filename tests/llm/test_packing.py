import re
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(df, padding):
    whole = Tokenizer.from_file(PATH)
    want = sorted([(r.doc_id or -1, tuple(whole.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in df.select("doc_id", "text").collect()])
    rows = packing.pack(df, PATH).collect()
    pieces, windows = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id or -1, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    full = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
        full += at
    assert full == sum(len(t) for _, t in want)
    assert 2048 * len(windows) - full <= padding * 2048
    copies = {}
    for k, t in want:
        copies.setdefault(k, []).append(t)
    for k, texts in copies.items():
        if len(texts) == 1:
            assert tuple(sum((ids for _, ids, _ in sorted(pieces[k])), [])) == texts[0]
            assert {n for *_, n in pieces[k]} == {len(texts[0])}


def test_pieces_and_padding(documents):
    check(documents.repartition(3, "doc_id"), 3)


def test_odd_rows(odd, empty):
    check(odd.coalesce(1), 1)
    assert packing.pack(empty, PATH).count() == 0


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    assert p.place(4, ("a", 0)) is None and p.count[4] == 1
    assert p.place(4, ("b", 0)) is None  # level 8 (sum 1) rather than two at level 4 (sum 4)
    assert p.count[4] == 0 and p.count[8] == 1
    assert p.place(2, ("c", 0)) == [("a", 0, 4, 0), ("b", 0, 4, 4), ("c", 0, 2, 8)]
    assert list(p.close()) == []
    rng = np.random.default_rng(0)
    p, squares = packing.SumOfSquares(64), []
    for k, n in enumerate(rng.integers(1, 64, 500).tolist()):
        best = min(
            sum(c * c for c in after(p, level, n))
            for level in range(0, 64 - n + 1)
            if level == 0 or p.count[level]
        )
        p.place(n, (k, 0))
        assert int((p.count[1:64] ** 2).sum()) == best


def after(p, level, n):
    count = p.count[:64].tolist()
    if level:
        count[level] -= 1
    if level + n < 64:
        count[level + n] += 1
    return count[1:]


TEXTS = ["Don't STOP, it's 4.0. É È é, é. Σίσυφος ΣΑΣ\n x\x01y \x01 ...!! a,. I'll. <|endoftext|> " + "z" * 300, "\tA\r\nB\x0bc  d.", ".", ",", "", None,
         "hello <|endoftext|> world", "<|ENDOFTEXT|>, a<|startoftext|>b.", "İ. ß. é. ", "x İ, Ǆ. ﬁ. ÅA\u030a. \u0301a \u00a0\u3000b"]


def whole_ids(texts):
    whole = Tokenizer.from_file(PATH)
    return [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def ids_of(words, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)]


def test_ids_are_the_tokenizers(monkeypatch):
    words = packing.WordTokenizer(PATH)
    for _ in range(2):
        assert ids_of(words, TEXTS) == whole_ids(TEXTS)
    monkeypatch.setattr(packing, "CACHE_WORDS", 4)
    assert ids_of(packing.WordTokenizer(PATH), TEXTS) == whole_ids(TEXTS)


ODD_PIECES = st.sampled_from(["İ", ".", ",", " ", "\n", "é", "e\u0301", "\u0301", "<|endoftext|>", "<|", "'s", "Σ", "\x01", "a", "Z", "9", "\u00a0", "ﬁ", "日本", "\u1e9e", "\x85", "Ⅷ", "\u0345"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), ODD_PIECES), max_size=25).map("".join))
def test_ids_of_any_unicode(text):
    words = packing.WordTokenizer.get(PATH)
    assert ids_of(words, [text]) == whole_ids_cached([text])


@cache
def plain():
    return Tokenizer.from_file(PATH)


def whole_ids_cached(texts):
    return [plain().encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"word{k}, é{k} {k}" for k in range(4000)) + "x" * 3000
    stretch = re.compile(packing._STRETCH.pattern.replace(str(packing.ENCODE_CHARS - 1), "500"))
    monkeypatch.setattr(packing, "ENCODE_CHARS", 501)
    monkeypatch.setattr(packing, "_STRETCH", stretch)
    assert len(stretch.findall(text)) > 50 and "".join(stretch.findall(text)) == text
    assert ids_of(packing.WordTokenizer(PATH), [text, "a b", text]) == whole_ids([text, "a b", text])


def test_the_cache_is_bound_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 64 << 10)
    words = packing.WordTokenizer(PATH)
    texts = [" ".join(f"some{k * j % 997} other{k % 50}" for k in range(400)) for j in range(1, 40)]
    for _ in range(2):
        for k in range(0, len(texts), 3):
            assert ids_of(words, texts[k : k + 3]) == whole_ids_cached(texts[k : k + 3])
            size = sum(packing.ENTRY_BYTES + len(w) + len(ids) for c in (words.cache, words.older) for w, ids in c.items())
            assert words.size <= (32 << 10) + 512 and size <= (64 << 10) + 1024
    assert words.older
