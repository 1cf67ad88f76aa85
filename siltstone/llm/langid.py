"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text from both ends, labels every position with language probabilities, and a document
pools those of all its positions. It is trained in numpy by backpropagation through time on windows drawn from all
places of a bounded sample of labelled rows. Long texts are read in windows; each is read with some bytes before and
behind it, which warm up the states of both directions and are labelled by their own windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: The bound on what is learned from: so many labelled rows, whole, with so many bytes together. Rows of over an eighth
#: of these bytes are not drawn.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20
HIDDEN, STEPS, BATCH, SPAN, RATE = 12, 500, 192, 40, 0.02
#: Bytes that a window labels, and those before and behind it that it reads too.
WINDOW, AROUND = 512, 24
#: Windows read together, and bytes of text cut into windows at once.
BLOCK, BLOCK_BYTES = 512, 2 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts of ``sizes`` bytes, laid end to end: text, first byte read, first and last labelled, end of what is read."""
    n = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), n)
    begin = np.cumsum(sizes) - sizes
    start = begin[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    stop = np.minimum(start + WINDOW, (begin + sizes)[text])
    return text, np.maximum(start - AROUND, begin[text]), start, stop, np.minimum(stop + AROUND, (begin + sizes)[text])


@dataclass
class Network:
    """Weights of both directions, (input, hidden) for the update, reset and candidate gates, and of the labels."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        rng, w = np.random.default_rng(seed), {}
        for way in "fb":
            w[f"x{way}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            w[f"h{way}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        w["o"] = rng.normal(0, hidden**-0.5, (2 * hidden, len(languages))).astype(np.float32)
        w["c"] = np.zeros(len(languages), np.float32)
        return cls(languages, w)

    def _run(self, x: np.ndarray, way: str, keep: list | None = None, live: np.ndarray | None = None) -> np.ndarray:
        """States (time, row, hidden) of one direction over bytes (time, row); only the first live[t] rows are as long as t."""
        wx, wh = self.weights[f"x{way}"], self.weights[f"h{way}"]
        n, (size, rows) = len(wh), x.shape
        h, states = np.zeros((rows, n), wx.dtype), np.zeros((size, rows, n), wx.dtype)
        for t in range(size) if way == "f" else range(size - 1, -1, -1):
            m = rows if live is None else live[t]
            gx, gh, old = wx.take(x[t, :m], axis=0), h[:m] @ wh, h[:m]
            gates = gx[:, : 2 * n] + gh[:, : 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)  # the logistic function of x is (1 + tanh(x / 2)) / 2
            gates += 1
            gates *= 0.5
            z, r = gates[:, :n], gates[:, n:]
            c = r * gh[:, 2 * n :]
            c += gx[:, 2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, old.copy(), z, r, c, gh[:, 2 * n :]))
            new = old - c
            new *= z
            new += c
            h[:m] = new
            states[t, :m] = new
        return states

    def labels(self, x: np.ndarray, keep: dict | None = None, live: np.ndarray | None = None) -> np.ndarray:
        """Language probabilities (time, row, language) of every position of bytes (time, row); see ``_run`` for ``live``."""
        kept = {way: [] if keep is not None else None for way in "fb"}
        states, o, n = [self._run(x, way, kept[way], live) for way in "fb"], self.weights["o"], len(self.weights["hf"])
        p = states[0] @ o[:n]
        p += states[1] @ o[n:]
        p += self.weights["c"]
        np.exp(np.clip(p, -60, 60, out=p), out=p)
        p /= p @ np.ones((p.shape[2], 1), p.dtype)
        if keep is not None:
            keep |= kept | {"states": np.concatenate(states, axis=2)}
        return p

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted cross-entropy over all positions of bytes (time, row), and its gradient by backpropagation through time."""
        keep: dict = {}
        p = self.labels(x, keep)
        rows, scale = np.arange(x.shape[1]), (weight / p.shape[0] / weight.sum()).astype(p.dtype)
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * scale).sum())
        d = p.copy()
        d[:, rows, y] -= 1
        d *= scale[None, :, None]
        grad = {"o": np.einsum("tbh,tbk->hk", keep["states"], d), "c": d.sum((0, 1))}
        dstates = d @ self.weights["o"].T
        for k, way in enumerate("fb"):
            wh = self.weights[f"h{way}"]
            n = len(wh)
            gx, gh = np.zeros_like(self.weights[f"x{way}"]), np.zeros_like(wh)
            dh, firsts = np.zeros((x.shape[1], n), p.dtype), []
            for t, h, z, r, c, hc in reversed(keep[way]):
                dh = dh + dstates[t][:, k * n : (k + 1) * n]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                firsts.append((t, np.concatenate([dz, dr, dc], axis=1)))
                back = np.concatenate([dz, dr, dc * r], axis=1)
                gh += h.T @ back
                dh = dh * z + back @ wh.T
            # The sums by byte as one product with a table of which position has which byte
            at, d_in = np.concatenate([x[t] for t, _ in firsts]), np.concatenate([g for _, g in firsts])
            order = np.argsort(at, kind="stable")
            seen, first = np.unique(at[order], return_index=True)
            gx[seen] = np.add.reduceat(d_in[order], first, axis=0)
            grad |= {f"x{way}": gx, f"h{way}": gh}
        return loss, grad

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The sums of language probabilities over the positions of each text."""
        out = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        text, low, start, stop, high = windows(np.fromiter(map(len, texts), np.int64, len(texts)))
        order = np.argsort(low - high, kind="stable")  # the longest first
        for k in range(0, len(order), BLOCK):
            some = order[k : k + BLOCK]
            size = (high - low)[some]
            steps = np.arange(size[0])[:, None]
            x = data[np.minimum(low[some] + steps, len(data) - 1)]
            p = self.labels(x, live=np.searchsorted(-size, -steps[:, 0], side="left"))
            p *= ((steps >= (start - low)[some]) & (steps < (stop - low)[some]))[:, :, None]
            np.add.at(out, text[some], p.sum(0))
        return out


def train(texts: list[bytes], target: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 5) -> Network:
    """Adam on batches of windows; languages are drawn alike, and all places of a language's texts."""
    net, rng = Network.fresh(languages, seed=seed), np.random.default_rng(seed)
    pools = [np.frombuffer(b"\n".join([t for t, y in zip(texts, target) if y == k]), np.uint8) for k in range(len(languages))]
    pools = [np.resize(p, max(len(p), SPAN)) for p in pools]
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    y = np.arange(BATCH) % len(languages)
    for step in range(1, steps + 1):
        at = [rng.integers(0, len(pools[k]) - SPAN + 1) for k in y]
        x = np.stack([pools[k][a : a + SPAN] for k, a in zip(y, at)], axis=1)
        _, grad = net.gradient(x, y, np.ones(BATCH))
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.weights[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Network | None:
    """A network trained on at most ``rows`` labelled rows, the first by a hash, whole and of SAMPLE_BYTES together.

    Repeated rows count once; rows with a null or empty text or a null language, and those of over an eighth of
    SAMPLE_BYTES, teach nothing. None if nothing can be learned.
    """
    some = labelled.filter((F.col(text_col) != "") & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES // 8))
    some = some.select(F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_l"), F.xxhash64(id_col, text_col, lang_col).alias("_h"))
    # The hash of the last row of the sample is found first, so that no texts are sorted or sent around.
    first = some.select("_h", F.octet_length("_t").alias("_n")).distinct().orderBy("_h").limit(rows).collect()
    fits = np.searchsorted(np.cumsum([r["_n"] for r in first]), SAMPLE_BYTES, side="right") if first else 0
    if not fits:
        return None
    found = some.filter(F.col("_h") <= first[fits - 1]["_h"]).dropDuplicates(["_h"]).toPandas().sort_values("_h")
    languages = sorted(found["_l"].unique())
    texts = [t.encode("utf-8", "replace") for t in found["_t"]]
    return train(texts, found["_l"].map({k: i for i, k in enumerate(languages)}).to_numpy(), languages)


def held_out(id_col: str = "doc_id", of: int = 3, rest: int = 1) -> Column:
    """Whether the CRC-32 of the id as text leaves ``rest``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == rest


def identify(df: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score, the pooled probability of that language over all positions of the text.

    A null text, one without letters, or any text if there is no network, is ``und`` with score 0. Other columns stay;
    columns named lang_pred or score are replaced. Repeated rows stay as they are; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    fields = [c for c in df.columns if c not in ("lang_pred", "score")]

    def label(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score, held, size = [UNKNOWN] * len(texts), np.zeros(len(texts)), [], 0

        def judge() -> None:
            if held:
                sums = net.pooled([t for _, t in held])
                p = sums / sums.sum(1, keepdims=True)
                score[[k for k, _ in held]] = p.max(1)
                for (k, _), best in zip(held, p.argmax(1)):
                    names[k] = net.languages[best]
                held.clear()

        for k, t in enumerate(texts):
            if t and net and _LETTER.search(t):
                held.append((k, t.encode("utf-8", "replace")))
                size += len(held[-1][1])
                if size >= BLOCK_BYTES:
                    judge()
                    size = 0
        judge()
        return names, score

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, score = label(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": score})

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(read)(batches)

    # One struct column beside those of ``df``, by a name that none of them has.
    name = "_label" + "_" * max(map(len, df.columns))
    return df.withColumn(name, run(text_col)).select(*fields, f"{name}.lang_pred", f"{name}.score")
