"""SimHash fingerprints and their near-duplicate classes by a binary-trie self-join.

Fingerprints within ``distance`` bits are linked. The 64 bits are cut into blocks, so that two linked fingerprints
agree in all but ``distance`` of them: for every choice of so many blocks, these blocks are the top of a trie walked with
equal steps, which is the shuffle key. The more fingerprints there are, the more blocks, and the longer the key. Below it, tasks walk pairs of trie nodes together, add up
differing bits and drop a pair of nodes once the budget is passed. A key with very many fingerprints is cut into
salted blocks and every pair of blocks is joined, so no task holds an unbounded group. Tasks return a spanning
forest of the links they find, never all pairs; large-star/small-star rounds join the forests.

``near_texts`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates share a band of
minimum hashes, which depends on the similarity only and not on where a text was edited or on how often a shingle repeats; the
candidates' components are then compared by their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_key, discard, from_key, materialize, mix64, range_hashes, sized_join, small_batches, tidy, word_spans

DISTANCE = 4
#: Fewest and most blocks: keys of 64 * (1 - DISTANCE / blocks) bits, 21 to 38 of them.
BLOCKS = (6, 10)
#: Fingerprints of one trie in a task; a key with more is salted.
GROUP = 1024
#: Node pairs with no more leaf pairs than this are compared outright.
LEAF_PAIRS = 64
#: Leaf pairs compared at once: some 30 MB for wide fingerprints.
COMPARE = 1 << 18
#: Words of 64 bits in a wide fingerprint.
WIDE = 4
#: Differing bits of 256 at a Jaccard similarity of 0.8 have a mean of 39 and a deviation of 6 where shingles don't repeat. Wide
#: fingerprints count repeats, so this is a limit for those who ask for one, and by itself none that keeps all pairs of 0.8.
WIDE_DISTANCE = 72
#: Bands of minimum hashes, and hashes in each: two texts of similarity 0.8 share one with probability 0.9998.
BANDS, BAND_ROWS = 36, 7
#: Bytes of text of a component in a task; one with more is salted.
GROUP_BYTES = 8 << 20
#: Words hashed at once, so that a very long text takes no more memory than its bytes.
SLICE = 1 << 16
_WORD_BYTE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, at = xxhash.xxh64_digest, zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in at]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096], axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) of every row; a null, empty or blank text has fingerprint 0."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([text_fingerprint(t, shingle) for t in b["_t"]], np.uint64)
            yield pd.DataFrame({"id": b["_id"], "fp": fp.view(np.int64)})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(as_key(F.col(id_col)).alias("_id"), F.col(text_col).alias("_t")).mapInPandas(tidy(run), "id string, fp long")
    return rows.select(from_key(F.col("id"), kind).alias("id"), "fp")


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """Of each of the 64 * WIDE bits, derived from 64-bit shingle hashes, whether it is set in over half of them."""
    ones = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(hashes), 4080):
        part = hashes[k : k + 4080]
        h = np.zeros((-(-len(part) // 255) * 255, WIDE), np.uint64)
        for w in range(WIDE):
            h[: len(part), w] = mix64(part + np.uint64(w))
        # 255 bits add up to no more than a byte holds
        ones += np.unpackbits(h.view(np.uint8), axis=1).reshape(-1, 255, 64 * WIDE).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).view(np.uint64)


def shingle_hashes(text: str | None, shingles: tuple[int, ...]) -> list[np.ndarray]:
    """64-bit hashes of the shingles of a text, in order, for each number of words in a shingle; none without words."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    starts, ends = word_spans(data, _WORD_BYTE)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in shingles]
    words = []
    for k in range(0, len(starts), SLICE):
        a, b = starts[k : k + SLICE], ends[k : k + SLICE]
        words.append(range_hashes(data[a[0] : b[-1]], a - a[0], b - a[0]))
    words, out = np.concatenate(words), []
    for n in shingles:
        n = min(n, len(words))
        h = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            h = mix64(h) + words[k : k + len(h)]
        out.append(mix64(h))
    return out


def wide_fingerprint(text: str | None, shingles: tuple[int, ...]) -> list[np.ndarray]:
    """A wide fingerprint of a text for each number of words in a shingle; all zero without words."""
    return [wide_bits(h) if len(h) else np.zeros(WIDE, np.uint64) for h in shingle_hashes(text, shingles)]


def trie_pairs(fp: np.ndarray, a0, a1, b0, b1, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``distance`` bits between ranges [a0, a1) and [b0, b1) of ``fp``, each range sorted.

    ``fp`` has a row of one or more uint64 each. Equal ranges stand for a self-join; other ranges must not overlap.
    """
    fp = fp.reshape(len(fp), -1)
    last = 64 * fp.shape[1] - 1
    a0, a1, b0, b1 = (np.asarray(x, np.int64) for x in (a0, a1, b0, b1))
    spent, found = np.zeros(len(a0), np.int64), []
    for bit in range(last + 1):
        size = (a1 - a0) * (b1 - b0)
        leaf = (size <= LEAF_PAIRS) | (bit == last)
        found.append(_leaves(fp, a0[leaf], a1[leaf], b0[leaf], b1[leaf], distance))
        a0, a1, b0, b1, spent = (x[~leaf] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((fp[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [
            (a0, am, b0, bm, spent, None),
            (am, a1, bm, b1, spent, None),
            (a0, am, bm, b1, spent + 1, None),
            (am, a1, b0, bm, spent + 1, ~same),
        ]
        kept = []
        for x in parts:
            keep = (x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= distance)
            if x[5] is not None:
                keep &= x[5]
            kept.append([y[keep] for y in x[:5]])
        a0, a1, b0, b1, spent = (np.concatenate(y) for y in zip(*kept))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _leaves(fp, a0, a1, b0, b1, distance):
    size = (a1 - a0) * (b1 - b0)
    out, begin = [], 0
    ends = np.cumsum(size)
    while begin < len(size):
        upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COMPARE)))
        n = size[begin:upto]
        which = np.repeat(np.arange(begin, upto), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        wide = (b1 - b0)[which]
        i, j = a0[which] + at // wide, b0[which] + at % wide
        near = (np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= distance) & ((i < j) | (a0[which] != b0[which]) | (a1[which] != b1[which]))
        out.append((i[near], j[near]))
        begin = upto
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_groups(rows: pd.DataFrame, prints: list[str], node: str, distance: int) -> pd.DataFrame:
    """Links between nodes of whole groups; rows are sorted by key, lo, hi, side and the columns of the fingerprint."""
    fp = np.ascontiguousarray(rows[prints].to_numpy(np.int64)).view(np.uint64)
    nodes = rows[node].to_numpy(np.int64)
    group = rows[["key", "lo", "hi"]].to_numpy(np.int64)
    cuts = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
    side, lo, hi = (rows[c].to_numpy(np.int64) for c in ("side", "lo", "hi"))
    low_side = np.concatenate([[0], np.cumsum(side == lo)])
    mid = begin + low_side[end] - low_side[begin]
    own = lo[begin] == hi[begin]
    a0, a1 = begin, np.where(own, end, mid)
    b0, b1 = np.where(own, begin, mid), end
    real = np.where(own, end - begin > 1, (mid > begin) & (end > mid))
    label = np.arange(len(rows))
    which = np.flatnonzero(real)
    size = np.cumsum(((a1 - a0) * (b1 - b0))[which])
    for chunk in np.split(which, np.searchsorted(size, np.arange(1 << 23, int(size[-1]) if len(size) else 0, 1 << 23))):
        if len(chunk):
            i, j = trie_pairs(fp, a0[chunk], a1[chunk], b0[chunk], b1[chunk], distance)
            first, last = begin[chunk[0]], end[chunk[-1]]
            label[first:last] = forest(last - first, i - first, j - first) + first
    apart = nodes != nodes[label]
    return pd.DataFrame({"u": nodes[apart], "v": nodes[label[apart]]})


def blocks_for(count: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose keys part ``count`` even fingerprints into tries well below GROUP; all of them part more than any table has."""
    fewest, most = (b + distance - DISTANCE for b in BLOCKS)
    return next((b for b in range(fewest, most) if count <= GROUP // 4 << 64 * (b - distance) // b), most)


def linked(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``distance`` bits; ``fps`` has distinct ``fp``."""
    small_batches(fps.sparkSession)
    n_blocks = blocks_for(fps.count(), distance)
    edges = np.linspace(0, 64, n_blocks + 1).round().astype(int).tolist()
    blocks = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(n_blocks), n_blocks - distance)):
        # The choice's number and its blocks: at most 8 and 39 bits.
        key = F.lit(k).cast("long")
        for c in chosen:
            key = F.shiftleft(key, edges[c + 1] - edges[c]).bitwiseOR(blocks[c])
        keys.append(key)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return _join_tries(rows.join(sizes.filter("n > 1"), "key"), ["fp"], "fp", distance)


def _join_tries(rows: DataFrame, prints: list[str], node: str, distance: int) -> DataFrame:
    """Self-join of the tries below each ``key``, with ``n`` rows, of fingerprints in the columns ``prints``."""
    rows = rows.withColumn("m", F.ceil(F.col("n") / GROUP).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64(*prints), F.col("m")).cast("int"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    columns = list(dict.fromkeys([*prints, node]))
    rows = rows.select("key", F.least("side", "t").alias("lo"), F.greatest("side", "t").alias("hi"), "side", *columns)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unsigned = [x for c in prints for x in (F.col(c) < 0, F.col(c))]
    rows = rows.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", *unsigned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return whole_groups(batches, ["key", "lo", "hi"], lambda rows: _link_groups(rows, prints, node, distance))

    return rows.mapInPandas(tidy(run), "u long, v long").distinct()


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str], link: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``link`` of frames of whole groups, from batches sorted by the columns ``by``."""
    held: list[pd.DataFrame] = []
    for b in batches:
        last = b[by].iloc[-1] if len(b) else None
        if last is None:
            continue
        cut = len(b) - int((b[by] == last).all(axis=1).sum())
        if cut == 0 and held:
            first = held[-1][by].iloc[-1]
            if (first != last).any():
                yield link(pd.concat(held))
                held = []
            held.append(b)
            continue
        if cut:
            held.append(b.iloc[:cut])
            yield link(pd.concat(held))
        held = [b.iloc[cut:]]
    if held:
        yield link(pd.concat(held))


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (u, v) reaches, by large-star and small-star rounds.

    The rounds needed grow with the square of the logarithm of a component's longest path at most, and in practice with
    the logarithm; 60 are far beyond any table, and more is an error rather than a wrong result.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, old = materialize(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()), edges
        discard(old)
        was, mark = mark, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if was == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``df``: id, fp (the fingerprint's bits as a long) and component_id, the smallest id reachable.

    Equal fingerprints and those at most ``distance`` bits apart are linked. Texts without words have fingerprint 0
    and are linked like any other. Repeated rows keep one row each; rows with a null id take part, and a class of such
    rows only has a null component_id. An empty table gives no rows; other columns are not read.
    """
    docs = materialize(fingerprints(df, id_col, text_col, shingle))
    fps = docs.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected(linked(fps.select("fp"), distance))
    fps = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = fps.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = fps.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return docs.join(classes, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


@cache
def _factors() -> np.ndarray:
    rng = np.random.default_rng(0)
    return rng.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; one value of its own without words."""
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the minimum hashes of a set."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[k : k + 256, None] * _factors()).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mix64(key) + mix64(least[k::BAND_ROWS])
    return mix64(key)


def similar(hashes: list[np.ndarray], similarity: float, distance: int | None = None) -> np.ndarray:
    """For the shingle hashes of each text, the first index reached over pairs that are similar and, if asked for, within ``distance`` bits."""
    sets = [distinct(h) for h in hashes]
    fp = None if distance is None else np.stack([wide_bits(h) if len(h) else np.zeros(WIDE, np.uint64) for h in hashes])
    size = np.array([len(x) for x in sets], np.int64)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = codes.astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    label, mark = np.full(len(sets), -1, np.int64), np.zeros(len(names), np.int32)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], queue = first, [first]
        while queue and (label < 0).any():
            x = queue.pop()
            own = codes[begin[x] : begin[x] + size[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[codes], begin)
            mark[own] = 0
            near = (label < 0) & (both >= similarity * (size[x] + size - both) - 1e-9)
            if fp is not None:
                near &= np.bitwise_count(fp ^ fp[x]).sum(1, dtype=np.int64) <= distance
            near = np.flatnonzero(near)
            label[near] = first
            queue += near.tolist()
    return label


def verified(members: DataFrame, shingle: int, similarity: float, distance: int | None) -> DataFrame:
    """Links (u, v) that connect all nodes of a ``root`` whose texts are similar; ``members`` has root, node and text."""
    members = members.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("bytes") / GROUP_BYTES, F.lit(1.0))).cast("int").alias("m"))
    rows = members.join(sizes, "root").withColumn("side", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("root", F.least("side", "t").alias("lo"), F.greatest("side", "t").alias("hi"), "node", "text")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, texts, label = rows["node"].to_numpy(), rows["text"].tolist(), np.arange(len(rows))
        group = rows[["root", "lo", "hi"]].ne(rows[["root", "lo", "hi"]].shift()).any(axis=1).to_numpy()
        cuts = [*np.flatnonzero(group).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                label[a:b] = a + similar([shingle_hashes(t, (shingle,))[0] for t in texts[a:b]], similarity, distance)
        apart = label != np.arange(len(rows))
        return pd.DataFrame({"u": nodes[apart], "v": nodes[label[apart]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return whole_groups(batches, ["root", "lo", "hi"], link)

    return rows.mapInPandas(tidy(run), "u string, v string").distinct()


def fingerprint_links(docs: DataFrame) -> DataFrame:
    """Links (u, v) between the digests of ``docs`` (digest, fp) whose fingerprints are equal or at most DISTANCE bits apart, by the
    trie join; they connect them all."""
    prints = materialize(docs.groupBy("fp").agg(F.min("digest").alias("low")))
    roots = connected(linked(prints.select("fp"))).withColumnRenamed("node", "fp")
    prints = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = prints.groupBy("root").agg(F.min("low").alias("v"))
    return docs.select("digest", "fp").distinct().join(prints.select("fp", "root"), "fp").join(lows, "root").select(F.col("digest").alias("u"), "v").filter("u <> v").distinct()


def near_classes(df: DataFrame, id_col: str, text_col: str, shingle: int, distance: int | None, similarity: float, prints: bool = False) -> DataFrame:
    """(key, hash, digest, class): for each row of ``df``, its id as a key, its text's hash, that of its set of shingles, and the
    smallest digest of the class that it belongs to. With ``prints`` texts are also linked by their fingerprints."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [distinct(shingle_hashes(t, (shingle,))[0]) for t in b["text"]]
            out = pd.DataFrame({"key": b["key"], "hash": b["hash"], "digest": [xxhash.xxh128_hexdigest(x.tobytes()) for x in sets]})
            out["bands"] = [band_keys(x).view(np.int64) for x in sets]
            out["fp"] = np.array([text_fingerprint(t) if prints else 0 for t in b["text"]], np.uint64).view(np.int64)
            yield out

    text = F.col(text_col)
    rows = df.select(as_key(F.col(id_col)).alias("key"), F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("-")).alias("hash"), text.alias("text"))
    docs = materialize(rows.mapInPandas(tidy(run), "key string, hash string, digest string, bands array<long>, fp long"))
    first = F.min(F.struct("key", "hash")).alias("first")
    nodes = materialize(docs.groupBy("digest").agg(first, F.any_value("bands").alias("bands")).select("digest", "first.*", "bands"))
    keys = nodes.select(F.col("digest").alias("node"), F.explode("bands").alias("band"))
    shared = materialize(keys.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).filter("n > 1").select("band", "low"))
    met = materialize(sized_join(keys, shared, "band", "inner", 48).filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct())
    maybe = connected(met)
    maybe = maybe.union(maybe.select(F.col("root").alias("node"), "root").distinct())
    # One row for each node, with its text: written once, as the rows are then read for the sizes and for the sets.
    maybe = materialize(nodes.select(F.col("digest").alias("node"), "key", "hash").join(maybe, "node"))
    members = sized_join(rows, maybe, ["key", "hash"], "inner", 160).select("node", "root", "text").dropDuplicates(["node"])
    links = verified(materialize(members), shingle, similarity, distance)
    roots = materialize(connected(links.union(fingerprint_links(docs)) if prints else links))
    roots = roots.select(F.col("node").alias("digest"), F.col("root").alias("class"))
    return sized_join(docs.drop("bands", "fp"), roots, "digest", "left", 80).withColumn("class", F.coalesce("class", "digest"))


def near_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int | None = None, similarity: float = 0.8
) -> DataFrame:
    """One row per row of ``df``: id and component_id, the smallest id reachable over links.

    Texts are linked where their sets of shingles of ``shingle`` words have a Jaccard similarity of ``similarity`` or
    more, counted on the whole sets; with a ``distance``, only where their wide fingerprints differ in no more bits. Such a pair is
    missed only if no chain of shared bands leads from one to the other. Texts without words are linked with each other,
    and texts of fewer words are one shingle. Repeated rows keep a row each; rows with a null id take part, and a class
    of such rows only has a null component_id. An empty table gives no rows; other columns are not read.
    """
    docs = materialize(near_classes(df, id_col, text_col, shingle, distance, similarity))
    kind = df.schema[id_col].dataType
    docs = docs.select(from_key(F.col("key"), kind.simpleString()).alias(id_col), "class")
    lows = materialize(docs.groupBy("class").agg(F.min(id_col).alias("component_id")))
    return docs.join(lows, "class").select(id_col, "component_id")


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int | None = None, similarity: float = 0.8
) -> DataFrame:
    """``df`` with one row of each near-duplicate class: that of the smallest id, null ids last, and then of the least text hash.

    Texts are linked where their fingerprints are, as in ``near_duplicates``, by the trie join; and where ``near_texts`` links them, so
    that edits that turn more bits lose none. A class is a component of both kinds of links: where a text is like a second and that like a
    third, one of the three stays even if the first and the third are not alike. Of rows that repeat both id and text one stays. A row alone in its class stays whatever its id or text. Columns of
    ``df`` stay as they are. An empty table gives no rows.
    """
    docs = materialize(near_classes(df, id_col, text_col, shingle, distance, similarity, prints=True))
    kind = df.schema[id_col].dataType.simpleString()
    place = F.struct(F.col("key") == "-", from_key(F.col("key"), kind).alias("id"), "hash")
    stay = docs.groupBy("class").agg(F.min(place).alias("stay"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = docs.withColumn("place", place)
    # Classes of one row need no look; of the others all rows but the first go, and repeats of the first are told apart below.
    many = materialize(sized_join(rows, materialize(stay), "class", "inner", 160).select("key", "hash", (F.col("place") == F.col("stay")).alias("first")))
    gone = materialize(many.filter("not first").select("key", "hash").distinct())
    twice = materialize(many.filter("first").groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hash"))
    marks = [f"_{c}" + "_" * max(map(len, df.columns)) for c in ("key", "hash")]
    text_hash = F.coalesce(F.md5(F.encode(F.col(text_col), "UTF-8")), F.lit("-"))
    marked = df.withColumn(marks[0], as_key(F.col(id_col))).withColumn(marks[1], text_hash)
    out = sized_join(marked, gone.toDF(*marks), marks, "left_anti", 80)
    if not twice.isEmpty():
        twice = twice.toDF(*marks)
        out = sized_join(out, twice, marks, "left_anti", 80).unionByName(sized_join(out, twice, marks, "left_semi", 80).dropDuplicates(marks))
    return out.select(*df.columns)
