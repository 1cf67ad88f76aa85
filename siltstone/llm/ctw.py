"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary choices; each choice has a tree of contexts, the one to ``DEPTH`` bytes before it. Every node
keeps a Krichevsky-Trofimov estimate of its choice, and a node's weighted probability is the even mixture of its own
and the product of its children's; the share of the latter is how far a prediction trusts longer contexts. Counts are
gathered from all training texts and then stand still, so every text is scored by one model. A context without
training counts adds nothing: the mixture ends at the longest one seen.

Texts are cut into blocks. A block's distinct context strings, and its words, are dealt into buckets and packed, one row
for each block and bucket; these rows meet the bucket's part of the model once, and come back to the block with its
values. There are as many buckets as blocks, so what a task holds of either does not grow with the corpus, and a bucket
has the trees of contexts that agree in their nearest three bytes. The packed
bytes of a frequent context, which all blocks have, are dealt to parts: they are summed in rounds, and each part meets the
bucket's model. The nodes above a bucket's trees are summed over all buckets by key and joined to the trees' roots. No model is held whole
anywhere. The only tables that reach the driver are those of contexts of at most one byte: 257 times 255 nodes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_key, from_key, materialize, mix64, range_hashes, sized_join, small_batches
from .langid import held_out

DEPTH = 5
#: Bytes of text in a block.
BLOCK_BYTES = 24 << 20
#: The end of a document, and what stands before one; words have no line feed.
END = b"\n"
#: Fewest buckets of context strings and of words, and the nearest bytes that the trees of a bucket have in common.
BUCKETS, TOP = 64, 3
#: Packed rows whose counts are summed at once.
FAN_IN = 32
#: Bytes of text whose context strings are sorted at once.
CHUNK_BYTES = 2 << 20
#: Packed bytes of a bucket that meet its part of the model in one task.
PART_BYTES = 64 << 20
PACKED = "block long, kind int, bucket int, keys binary, n binary"


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def grams(docs: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the documents: context, nearest byte highest, and the byte itself lowest; and the lengths."""
    data = np.frombuffer(END * depth + (END * depth).join(docs), np.uint8)
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.cumsum(lengths + depth) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out = data[at].astype(np.uint64)
    for d in range(1, depth + 1):
        out |= data[at - d].astype(np.uint64) << np.uint64(8 * (depth + 1 - d))
    return out, lengths


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probabilities of counts."""
    top = int(max(zeros.max(initial=0), ones.max(initial=0)))
    if top < 1 << 16:
        half = np.concatenate([[0.0], np.cumsum(np.log(np.arange(top) + 0.5))])
        low = half[zeros.astype(np.int64)] + half[ones.astype(np.int64)]
    else:
        low = _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - 2 * math.lgamma(0.5)
    return low - _lgamma(zeros + ones + 1.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after three steps up."""
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


class Subtree:
    """All nodes of contexts that begin with the same ``top`` bytes, from their context strings and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        order = np.argsort(keys)
        self.keys, self.depth, self.top = keys[order], depth, top
        rows, n = self.keys, counts[order].astype(np.float64)
        self.level: dict[int, dict] = {}
        up = np.arange(len(rows))  # from the deepest rows to those of the level
        for d in range(depth, top - 1, -1):
            if d < depth:
                short = (rows >> np.uint64(16) << np.uint64(8)) | (rows & np.uint64(255))
                rows, back = np.unique(short, return_inverse=True)
                n, up = np.bincount(back, n, len(rows)), back[up]
            else:
                back = None
            bits = []
            for j in range(8):
                node = rows >> np.uint64(8 - j)
                first = np.concatenate([[True], node[1:] != node[:-1]])
                of = np.cumsum(first) - 1
                one = (rows >> np.uint64(7 - j) & np.uint64(1)).astype(np.float64)
                ones = np.bincount(of, n * one)
                zeros = np.bincount(of, n) - ones
                bits.append({"of": of, "first": np.flatnonzero(first), "zeros": zeros, "ones": ones, "own": _kt(zeros, ones)})
            self.level[d] = {"rows": rows, "bits": bits, "up": up, "back": back}
        for d in range(depth, top - 1, -1):
            for j in range(8):
                b = self.level[d]["bits"][j]
                if d == depth:
                    b["weighted"], b["trust"] = b["own"], np.zeros(len(b["own"]))
                    continue
                child = self.level[d + 1]["bits"][j]
                parent = b["of"][self.level[d]["back"][child["first"]]]
                below = np.bincount(parent, child["weighted"], len(b["own"]))
                b["weighted"] = np.logaddexp(b["own"], below) - math.log(2)
                b["trust"] = 1 / (1 + np.exp(np.clip(b["own"] - below, -700, 700)))

    def roots(self) -> pd.DataFrame:
        """The nodes of the shortest contexts, by bit: near (its bytes), node (1 to 255), zeros, ones, weighted."""
        level, out = self.level[self.top], []
        for j, b in enumerate(level["bits"]):
            rows = level["rows"][b["first"]]
            node = (1 << j) | (rows >> np.uint64(8 - j) & np.uint64((1 << j) - 1)).astype(np.int64)
            near = (rows >> np.uint64(8)).astype(np.int64)
            out.append(pd.DataFrame({"near": near, "node": node} | {k: b[k] for k in ("zeros", "ones", "weighted")}))
        return pd.concat(out)

    def log10(self, above: Top, between: list[pd.DataFrame] = ()) -> np.ndarray:
        """The log10 probability of the last byte of each key after the others; ``between`` has zeros, ones and trust of the nodes
        above each of ``roots``, for each length of context between those and ``above``."""
        total = np.zeros(len(self.keys))
        symbol = (self.keys & np.uint64(255)).astype(np.int64)
        near = (self.keys >> np.uint64(8 * self.depth) & np.uint64(255)).astype(np.int64)
        between, passed = [[r[c].to_numpy() for c in ("zeros", "ones", "trust")] for r in between], 0
        for j in range(8):
            one = (symbol >> (7 - j) & 1).astype(bool)
            p, seen = None, None
            for d in range(self.depth, self.top - 1, -1):
                level, b = self.level[d], self.level[d]["bits"][j]
                at = b["of"][level["up"]]
                p, seen = _mixed(b["zeros"][at], b["ones"][at], b["trust"][at], one, p, seen)
            at = at + passed
            for zeros, ones, trust in between:
                p, seen = _mixed(zeros[at], ones[at], trust[at], one, p, seen)
            passed += len(b["zeros"])
            p = above.mixed(near, (1 << j) | (symbol >> (8 - j)), one, p, seen)
            total += np.log10(p)
        return total


def _mixed(zeros, ones, trust, one, p, seen):
    """The mixture at a node and whether it has counts, from that of its child."""
    n = zeros + ones
    own = (np.where(one, ones, zeros) + 0.5) / (n + 1)
    if p is not None:
        own = np.where(seen, own + trust * (p - own), own)
    return own, n > 0


def folded(nodes: pd.DataFrame) -> pd.DataFrame:
    """``nodes`` with trust and their own weighted probability, from zeros, ones and below, the sum of their children's."""
    own = _kt(nodes["zeros"].to_numpy(), nodes["ones"].to_numpy())
    below = nodes["below"].to_numpy()
    weighted = np.logaddexp(own, below) - math.log(2)
    weighted[(nodes["zeros"] + nodes["ones"]).to_numpy() == 0] = 0
    return nodes.assign(trust=1 / (1 + np.exp(np.clip(own - below, -700, 700))), weighted=weighted)


class Top:
    """The nodes of contexts of one byte and of none."""

    def __init__(self, rows: pd.DataFrame):
        """rows: near (the context byte), node, zeros, ones, weighted: sums over the contexts of two bytes."""
        shape = (256, 256)
        self.one = {k: np.zeros(shape) for k in ("zeros", "ones", "below")}
        at = rows["near"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
        for k, c in (("zeros", "zeros"), ("ones", "ones"), ("below", "weighted")):
            self.one[k][at] = rows[c]
        done = folded(pd.DataFrame({k: v.ravel() for k, v in self.one.items()}))
        self.one["trust"], weighted = (done[k].to_numpy().reshape(shape) for k in ("trust", "weighted"))
        self.none = {"zeros": self.one["zeros"].sum(0), "ones": self.one["ones"].sum(0)}
        own = _kt(self.none["zeros"], self.none["ones"])
        self.none["trust"] = 1 / (1 + np.exp(np.clip(own - weighted.sum(0), -700, 700)))

    def mixed(self, near, node, one, p, seen):
        t = self.one
        p, seen = _mixed(t["zeros"][near, node], t["ones"][near, node], t["trust"][near, node], one, p, seen)
        t = self.none
        return _mixed(t["zeros"][node], t["ones"][node], t["trust"][node], one, p, seen)[0]


class Lookup:
    """Values by key; most keys are found by one look into a table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(10, int(4 * len(keys)).bit_length()))
        self.at = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.at[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.at[self._slot(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return self.values[at]


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes by place value, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def expand(z: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(z), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def rising(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def risen(z: bytes) -> np.ndarray:
    return np.cumsum(expand(z, "u8"), dtype=np.uint64)


def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    out, back = np.unique(np.concatenate(keys), return_inverse=True)
    return out, np.bincount(back, np.concatenate(n), len(out)).astype(np.int64)


def merged_words(words: list[list[bytes]], n: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    total: dict[bytes, int] = {}
    for some, counts in zip(words, n):
        for w, c in zip(some, counts.tolist()):
            total[w] = total.get(w, 0) + c
    return list(total), np.fromiter(total.values(), np.int64, len(total))


def pack_words(words: list[bytes]) -> bytes:
    """Words, none of which has a line feed but the end mark, which is written as an empty one."""
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join([b"" if w == END else w for w in words]))


def unpack_words(z: bytes) -> list[bytes]:
    return [w or END for w in zstandard.decompress(z).split(b"\n")]


def block_grams(docs: list[bytes], held: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct context strings of a block, and how often each is in its training texts."""
    keys, n, part, size = [], [], {False: [], True: []}, 0

    def count() -> None:
        for h, some in part.items():
            if some:
                k, c = np.unique(grams(some, depth)[0], return_counts=True)
                keys.append(k)
                n.append(np.zeros(len(k), np.int64) if h else c)
                some.clear()

    for doc, h in zip(docs, held):
        part[bool(h)].append(doc)
        size += len(doc)
        if size >= CHUNK_BYTES:
            count()
            size = 0
            if len(keys) >= 16:
                keys, n = ([x] for x in merged(keys, n))
    count()
    return merged(keys, n)


def _of_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with its positions in order."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(buckets[at[0]]), at


def packed_block(docs: list[bytes], held: list[bool], depth: int, buckets: int, top: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(kind, bucket, keys, counts) of a block: kind 0 for context strings, 1 for words."""
    keys, n = block_grams(docs, held, depth)
    near = mix64(keys >> np.uint64(8 * (depth + 1 - top))) % np.uint64(buckets)
    for bucket, at in _of_bucket(near.astype(np.int64)):
        yield 0, bucket, rising(keys[at]), squeeze(n[at])
    counts: dict[bytes, int] = Counter()
    seen: set[bytes] = set()
    for doc, h in zip(docs, held):
        (seen if h else counts).update(_words(doc))
    words = [*counts, *(w for w in seen if w not in counts)]
    n = np.array([counts.get(w, 0) for w in words], np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    hashes = range_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    for bucket, at in _of_bucket((hashes % np.uint64(buckets)).astype(np.int64)):
        yield 1, bucket, pack_words([words[k] for k in at]), squeeze(n[at])


def _packed_sum(rows: pd.DataFrame) -> tuple[bytes, bytes]:
    """Of packed rows of one kind, FAN_IN at a time."""
    words, parts = rows["kind"].iloc[0] == 1, []
    for k in range(0, len(rows), FAN_IN):
        some = rows.iloc[k : k + FAN_IN]
        parts.append(([unpack_words(z) if words else risen(z) for z in some["keys"]], [expand(z, "i8") for z in some["n"]]))
        keys, n = parts.pop()
        if parts:
            keys, n = [parts[0][0], *keys], [parts[0][1], *n]
        parts = [(merged_words if words else merged)(keys, n)]
    keys, n = parts[0]
    return (pack_words(keys) if words else rising(keys)), squeeze(n)


def _unpacked(row) -> list[bytes]:
    data, out, at = zstandard.decompress(row["z"]), [], 0
    for n in row["sizes"]:
        out.append(data[at : at + n])
        at += n
    return out


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All texts, as their tokens joined by spaces, in compressed blocks: block, ids, held, sizes, z."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, held, docs, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def block() -> pd.DataFrame:
            z = zstandard.ZstdCompressor(level=3).compress(b"".join(docs))
            return pd.DataFrame({"block": [number], "ids": [list(ids)], "held": [list(held)], "sizes": [list(map(len, docs))], "z": [z]})

        for b in batches:
            for key, h, t in zip(b["id"], b["held"], b["t"]):
                ids.append(key)
                held.append(bool(h))
                docs.append(b" ".join(tokens(t)[:-1]) + END)
                size += len(docs[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    number, ids, held, docs, size = number + 1, [], [], [], 0
        if docs:
            yield block()

    rows = df.select(as_key(F.col(id_col)).alias("id"), held_out(id_col, 7, 2).alias("held"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, "block long, ids array<string>, held array<boolean>, sizes array<int>, z binary")


def hot_buckets(rows: DataFrame) -> DataFrame:
    """(kind, bucket, parts) of the buckets of over PART_BYTES in several ``rows``; at least two rows a part."""
    sizes = rows.groupBy("kind", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    parts = F.least(F.ceil(F.col("size") / PART_BYTES), F.ceil(F.col("rows") / 2))
    return materialize(sizes.filter((F.col("size") > PART_BYTES) & (F.col("rows") > 1)).select("kind", "bucket", parts.alias("parts")))


def in_parts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Packed rows with their ``part``, by block."""
    parts = F.coalesce(F.col("parts"), F.lit(1))
    return sized_join(rows, hot, ["kind", "bucket"], "left", 24).withColumn("part", F.pmod(F.xxhash64("block"), parts)).drop("parts")


def _words(doc: bytes) -> list[bytes]:
    return [*doc[:-1].split(b" "), END] if len(doc) > 1 else [END]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows whose CRC-32 of the id as text leaves 2 when divided by 7 are held out; the others train. score is the model's log10 probability of the tokens, words joined by spaces and an end mark;
    bits_per_byte the code length that this is for each byte of the words, the spaces between them and the end; base_score
    that of add-one word counts. A null text is an empty one, which is the end mark alone. Repeated rows
    train and are scored each. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    stored = materialize(blocks(df, id_col, text_col))
    count = stored.count()
    buckets = max(BUCKETS, 1 << (count - 1).bit_length()) if count else BUCKETS
    top = min(depth, TOP)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                rows = packed_block(_unpacked(row), row["held"], depth, buckets, top)
                yield pd.DataFrame([(row["block"], *r) for r in rows], columns=["block", "kind", "bucket", "keys", "n"])

    found = materialize(stored.select("block", "held", "sizes", "z").mapInPandas(counted, PACKED).withColumn("size", F.octet_length("keys") + F.octet_length("n")))

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        keys, n = _packed_sum(rows)
        return pd.DataFrame({"block": rows["part"].iloc[:1], "kind": rows["kind"].iloc[:1], "bucket": rows["bucket"].iloc[:1], "keys": [keys], "n": [n], "size": [len(keys) + len(n)]})

    hot = hot_buckets(found)
    whole, many = found, hot
    while True:
        whole = materialize(in_parts(whole, many).groupBy("kind", "bucket", "part").applyInPandas(summed, f"{PACKED}, size long"))
        if many.isEmpty():
            break
        many = hot_buckets(whole)
    whole = whole.drop("block", "size")

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bucket, keys, n in zip(b["bucket"], b["keys"], b["n"]):
                yield Subtree(risen(keys), expand(n, "i8"), depth, top).roots().assign(bucket=bucket)

    nodes = "near long, node long, zeros double, ones double"
    tops = whole.filter("kind = 0").select("bucket", "keys", "n").mapInPandas(roots, f"bucket int, {nodes}, weighted double")
    if top > 2:
        tops = materialize(tops)  # read for each level and for the trees

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield folded(b)

    level, between, ups = tops, [], tops.select("bucket", "near", "node")
    for d in range(top - 1, 1, -1):
        level = level.groupBy(F.shiftright("near", 8).alias("near"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        level = materialize(level.mapInPandas(fold, f"{nodes}, below double, trust double, weighted double"))
        names = [f"{c}{d}" for c in ("zeros", "ones", "trust")]
        ups = ups.withColumn("_near", F.shiftright("near", 8 * (top - d))).join(level.select(F.col("near").alias("_near"), "node", *[F.col(c[:-1]).alias(c) for c in names]), ["_near", "node"]).drop("_near")
        between.append(names)
    sums = level.groupBy(F.shiftright("near", 8).alias("near"), "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
    above = Top(sums.toPandas())  # at most 256 * 255 rows

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [expand(z, "i8") for z in b["n"]]
            yield pd.DataFrame({"train": [int(x.sum()) for x in n], "kinds": [int((x > 0).sum()) for x in n]})

    train, kinds = whole.filter("kind = 1").select("n").mapInPandas(totals, "train long, kinds long").agg(F.sum("train"), F.sum("kinds")).first()
    train, kinds = int(train or 0), int(kinds or 0)

    def modelled(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        """The values of a bucket's keys: log10 probabilities of context strings."""
        tree = Subtree(risen(rows["keys"].iloc[0]), expand(rows["n"].iloc[0], "i8"), depth, top)
        order = tree.roots()[["near", "node"]].merge(up, "left", ["near", "node"]) if between else None
        value = tree.log10(above, [order[names].set_axis(["zeros", "ones", "trust"], axis=1) for names in between])
        return rows[["kind", "bucket", "keys"]].assign(n=[squeeze(value.astype("f4"))])

    model = whole.filter("kind = 0")
    fields = "kind int, bucket int, keys binary, n binary"
    if between:
        model = model.groupBy("bucket").cogroup(ups.groupBy("bucket")).applyInPandas(modelled, fields)
    else:

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k in range(len(b)):
                    yield modelled(b.iloc[k : k + 1], None)

        model = model.mapInPandas(each, fields)
    model = model.union(whole.filter("kind = 1"))

    def answer(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        """The model's values for the rows of a part of a bucket's blocks."""
        if rows["kind"].iloc[0] == 0:
            known, values = risen(part["keys"].iloc[0]), expand(part["n"].iloc[0], "f4")
            got = [squeeze(values[np.searchsorted(known, risen(z))]) for z in rows["keys"]]
        else:
            table = dict(zip(unpack_words(part["keys"].iloc[0]), expand(part["n"].iloc[0], "i8").tolist()))
            got = [squeeze(np.array([table[w] for w in unpack_words(z)], np.int64)) for z in rows["keys"]]
        return rows[["block", "kind", "keys"]].assign(value=got)

    by = ["kind", "bucket", "part"]
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    model = sized_join(model, hot, ["kind", "bucket"], "left", 24).withColumn("part", F.explode(copies)).drop("parts")
    back = in_parts(found.drop("n"), hot).drop("size").groupBy(*by).cogroup(model.groupBy(*by)).applyInPandas(answer, "block long, kind int, keys binary, value binary")

    def scores(block: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        docs, out, known = _unpacked(block.iloc[0]), [], {}
        for z, v in zip(rows["keys"][rows["kind"] == 1], rows["value"][rows["kind"] == 1]):
            known.update(zip(unpack_words(z), expand(v, "i8").tolist()))
        near = rows[rows["kind"] == 0]
        model = Lookup(np.concatenate([risen(z) for z in near["keys"]]), np.concatenate([expand(z, "f4") for z in near["value"]]))
        for k in range(0, len(docs), 256):
            part = docs[k : k + 256]
            keys, lengths = grams(part, depth)
            total = np.add.reduceat(model[keys].astype("f8"), np.cumsum(lengths) - lengths)
            for doc, x in zip(part, total.tolist()):
                c = np.fromiter([known[w] for w in _words(doc)], np.float64)
                out.append((len(c), int((c > 0).sum()), float(np.log10((c + 1) / (train + kinds + 1)).sum()), x, -x / math.log10(2) / len(doc)))
        out = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score", "bits_per_byte"])
        return out.assign(id=list(block["ids"].iloc[0]), held_out=list(block["held"].iloc[0]), train_tokens=train)

    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    out = stored.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(scores, schema)
    return out.withColumn("id", from_key(F.col("id"), kind)).withColumnRenamed("id", id_col)
