"""Exact Jaccard self-join of documents on word n-grams, by signature trees.

1. A pass over the texts gives each document's set of hashed shingles as a bitmap signature, its size, a
   class key of the whole set (equal sets are one class from here on) and the prefix of its hashes, rare
   ones first: a pass before it counts all shingles in a table of fixed size, whose classes and then the
   hashes themselves are the order. Two sets of the asked similarity share a hash within their prefixes, so these deal the
   classes out to blocks. Only hashes that a table of bits may hold, made of those in two prefixes or more, are dealt.
   Two sets of like size share many hashes within their prefixes, not only one: a member leaves a small block if no
   other there has a fitting size and both have as many hashes in blocks as the pair would have to share. Blocks of
   two go if too few hashes follow the shared one. Blocks with the same members are one; hot blocks are cut into size
   bands and a grid of cells in which every two members still meet.
2. In a block, signature trees (one per signature length) hold in each node the OR of its members'
   bitmaps, the range of their sizes and their largest slack (hashes less bits). A dual traversal drops
   pairs of nodes whose largest possible overlap is below what their sizes ask for.
   A pair that meets in several blocks is given by the first of them: every member carries its smallest
   block keys, and a block holds back a pair whose lists share a smaller key than the block's own.
3. Candidate pairs are verified on the full sets. A first round takes only the pairs that a block's members
   form with leaders, which joins large groups of near copies by about one pair a member. The second round
   traverses the blocks that still hold several components, skips nodes that lie within one component, and
   verifies every pair that is left: no link between different components can be lost.

Hashes are 64 bits wide; nothing else is approximate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, discard, lean, materialise, partitions, release, small_batches, table

_U = np.uint64
_WORD = re.compile(rb"[^ \t-\r]+").findall
_MUL = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LOWEST = -(1 << 63)
#: So many of its smallest block keys a member carries; more would hold back a few more repeated pairs.
CARRIED = 8
#: Blocks of at most so many members are traversed whole in the first round and not again in the second.
SMALL = 2
#: In blocks of at most so many members each is compared with each other by size and number of hashes.
FEW = 256
#: The partners of a leader are verified in so many parts, each of which gets the leader's set.
SALTS = 16
#: So many partners of a document go with one copy of its text.
TOGETHER = 64


class Shingler:
    def __init__(self, width: int, remembered: int = 200_000):
        self.width, self.words, self.remembered = width, {}, remembered

    def __call__(self, text: str) -> np.ndarray:
        """Ascending distinct hashes of the text's shingles."""
        return np.unique(self.hashes(text))

    def hashes(self, text: str) -> np.ndarray:
        """Hashes of the text's shingles, one for each place."""
        words = _WORD(text.encode().translate(_LOWER))
        known = self.words
        if len(known) > self.remembered:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], _U)
        n = min(self.width, len(words))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, _U)
        for i in range(n):
            x = (h[i : len(h) - n + 1 + i] ^ out) * _MUL[i % len(_MUL)]
            out = x ^ x >> _U(32)
        out *= _U(0xFF51AFD7ED558CCD)
        return out ^ out >> _U(29)


#: Shingles are counted in so many buckets by their hash, sent in chunks; counts only order the hashes.
BUCKETS, CHUNK = 1 << 20, 1 << 12
_BUCKET = _U(BUCKETS - 1)


def frequency_classes(rows: DataFrame, width: int) -> np.ndarray:
    """For each bucket a class that rises with the number of shingles in it, over all texts: quarters of a power
    of two above the mean. The table has a fixed size; task counts are added in two steps, as streams."""
    parts = partitions(rows.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = Shingler(width), np.zeros(BUCKETS, np.int64)
        for b in batches:
            held, size = [], 0
            for t in b["text"]:
                h = own.hashes(t)
                held.append(h)
                size += len(h)
                if size > 1 << 20:
                    seen += np.bincount((np.concatenate(held) & _BUCKET).astype(np.int64), minlength=BUCKETS)
                    held, size = [], 0
            if size:
                seen += np.bincount((np.concatenate(held) & _BUCKET).astype(np.int64), minlength=BUCKETS)
        salt = TaskContext.get().partitionId() % 8
        yield pd.DataFrame([(i // CHUNK, salt, seen[i : i + CHUNK].tobytes()) for i in range(0, BUCKETS, CHUNK) if seen[i : i + CHUNK].any()], columns=["chunk", "salt", "n"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for b in batches:
            for chunk, salt, n in zip(b["chunk"], b["salt"], b["n"]):
                if at != (chunk, salt):
                    if at is not None:
                        yield pd.DataFrame([(*at, total.tobytes())], columns=["chunk", "salt", "n"])
                    at, total = (chunk, salt), np.zeros(CHUNK, np.int64)
                total += np.frombuffer(n, np.int64)
        if at is not None:
            yield pd.DataFrame([(*at, total.tobytes())], columns=["chunk", "salt", "n"])

    form = "chunk int, salt int, n binary"
    sums = rows.select("text").mapInPandas(lean(count), form)
    for salt in (F.col("salt"), F.lit(0)):
        sums = sums.withColumn("salt", salt).repartition(parts, "chunk", "salt").sortWithinPartitions("chunk", "salt").mapInPandas(lean(add), form)
    seen = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():  # BUCKETS / CHUNK rows
        seen[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.n, np.int64)
    return (4 * np.log2(np.maximum(seen / max(1.0, seen.mean()), 1))).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    """So many hashes of a set: two sets that link share one of them."""
    return n - -(-percent * n // 100) + 1


def least_shared(a: Column, b: Column, percent: int) -> Column:
    """So many hashes are in the prefixes of both of two sets of these sizes, if they link. The prefix that ends first
    holds all that it shares with the other set within the other's prefix, and lacks what the sets do not share."""
    whole = F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))
    return whole - F.ceil(F.lit(percent) * F.greatest(a, b) / F.lit(100)) + 1


#: Bits of the largest table of shared hashes, in chunks.
MOST_BITS, BITS_CHUNK = 1 << 28, 1 << 15


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bytes of a table in which the bit of each key is set: 16 to 32 bits a key, MOST_BITS at most; the keys are
    hashes already. The executors gather the bits of each chunk."""
    size = min(MOST_BITS, max(BITS_CHUNK, 1 << (16 * max(1, keys.count()) - 1).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(size - 1))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for chunk, bits in zip(b["chunk"], b["bits"]):
                own = np.zeros(BITS_CHUNK, np.uint8)
                own[np.asarray(bits, np.int64)] = 1
                out.append((chunk, np.packbits(own, bitorder="little").tobytes()))
            yield pd.DataFrame(out, columns=["chunk", "bits"])

    bits = keys.select(F.shiftright(at, BITS_CHUNK.bit_length() - 1).cast("int").alias("chunk"), at.bitwiseAND(F.lit(BITS_CHUNK - 1)).cast("int").alias("bit"))
    table = np.zeros(size // 8, np.uint8)
    for r in bits.groupBy("chunk").agg(F.collect_list("bit").alias("bits")).mapInPandas(gather, "chunk int, bits binary").toLocalIterator():
        table[r.chunk * BITS_CHUNK // 8 : (r.chunk + 1) * BITS_CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return table


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """4 to 8 bits for each hash; shorter signatures are folded longer ones."""
    m = 64 << max(0, (4 * len(hashes) - 1).bit_length() - 6)
    bits = np.zeros(m, np.uint8)
    bits[(hashes & _U(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(_U)


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1).astype(np.int64)


class Tree:
    """Levels of nodes from the leaves (single members, in packing order) up to one root."""

    FAN = 8

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray, lows: np.ndarray):
        band = (np.log(np.maximum(sizes, 1)) / 0.1).astype(np.int64)
        self.order = np.lexsort((lows, band, comps))
        b, s, c = bits[self.order], sizes[self.order], comps[self.order]
        self.levels = [(b, s, s, s - ones(b), c, c)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), self.FAN)
            b, lo, hi, slack, c0, c1 = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def may_link(x, i: np.ndarray, y, j: np.ndarray, percent: int, leaf: bool) -> np.ndarray:
    """Whether members of node pairs can link, by the largest possible overlap."""
    out = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // max(1, x[0].shape[1]))
    for a in range(0, len(i), step):
        p, q = i[a : a + step], j[a : a + step]
        ok = (100 * x[2][p] >= percent * y[1][q]) & (100 * y[2][q] >= percent * x[1][p])
        ok &= ~((x[4][p] == x[5][p]) & (y[4][q] == y[5][q]) & (x[4][p] == y[4][q]))
        p, q = p[ok], q[ok]
        most = ones(x[0][p] & y[0][q]) + np.minimum(x[3][p], y[3][q])
        ok[ok] = (100 + percent) * most >= percent * (x[1][p] + y[1][q])
        out[a : a + step] = ok
    return out


def dual(x: Tree, y: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may link; a tree with itself gives each pair once."""
    top = max(len(x.levels), len(y.levels)) - 1

    def down(k: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ok = may_link(x.level(k), i, y.level(k), j, percent, k == 0)
        i, j = i[ok], j[ok]
        if k == 0:
            if x is y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield x.order[i], y.order[j]
            return
        for a in range(0, len(i), 20_000):  # some nodes at a time
            p, q = [], []
            for t, n, r in ((x, i[a : a + 20_000], p), (y, j[a : a + 20_000], q)):
                split = k < len(t.levels)  # a lower tree waits at its root
                r.append(n[:, None] * Tree.FAN + np.arange(Tree.FAN) if split else n[:, None])
                r.append(len(t.level(k - 1)[0]))
            c = np.repeat(p[0], q[0].shape[1], axis=1).ravel()
            d = np.tile(q[0], (1, p[0].shape[1])).ravel()
            fit = (c < p[1]) & (d < q[1])
            if x is y:
                fit &= c <= d
            if fit.any():
                yield from down(k - 1, c[fit], d[fit])

    yield from down(top, np.zeros(1, np.int64), np.zeros(1, np.int64))


def not_earlier(key: int, keys: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of members share no carried key below the block's own. Pairs are told apart by a matrix of
    the distinct smaller keys, some pairs at a time."""
    below = [k[k < key] for k in keys]
    used, code = np.unique(np.concatenate(below), return_inverse=True)
    if not len(used):
        return np.ones(len(i), bool)
    wide = max(map(len, below))
    of = np.full((len(below), wide), -1, np.int64)
    at = 0
    for r, k in enumerate(below):
        of[r, : len(k)] = code[at : at + len(k)]
        at += len(k)
    out = np.ones(len(i), bool)
    step = max(1, (1 << 22) // (wide * wide))
    for a in range(0, len(i), step):
        x, y = of[i[a : a + step]], of[j[a : a + step]]
        out[a : a + step] = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any(axis=(1, 2))
    return out


def block_pairs(nodes: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], lows: np.ndarray, comps: np.ndarray | None, percent: int, key: int = LOWEST, keys: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a block's members, as row numbers. Without components (first round) leaders are
    tried first: while they gather many, what they gather takes part in no other pair."""

    def first(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ok = not_earlier(key, keys, i, j) if keys is not None else np.ones(len(i), bool)
        if ok.any():
            yield i[ok], j[ok]

    length = np.array([len(m) for m in maps])
    apart = comps if comps is not None else np.arange(len(nodes))
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        bits = np.stack([maps[i] for i in own])
        if comps is None:
            idle = 0
            while len(own) > SMALL and idle < 4:
                k = int(np.argmin(nodes[own]))
                leaf = (bits, sizes[own], sizes[own], sizes[own] - ones(bits), own, own)
                hit = may_link(leaf, np.full(len(own), k), leaf, np.arange(len(own)), percent, True)
                hit[k] = False
                if hit.any():
                    yield np.full(hit.sum(), own[k]), own[hit]
                idle = 0 if hit.sum() * 20 > len(own) else idle + 1
                if hit.any():
                    hit[k] = False  # the leader stays for other leaders to find
                    keep = ~hit
                    keep[k] = False
                    own, bits = own[keep], bits[keep]
                elif idle < 4:
                    keep = np.arange(len(own)) != k
                    rest = own[keep]
                    # a leader that gathers nothing has met everyone
                    own, bits = rest, bits[keep]
            if len(own) < 2:
                continue
        t = Tree(bits, sizes[own], apart[own], lows[own])
        for i, j in dual(t, t, percent):
            yield from first(own[i], own[j])
    for n in np.unique(length):
        a, b = np.flatnonzero(length == n), np.flatnonzero(length == 2 * n)
        if len(b):
            small = Tree(np.stack([maps[i] for i in a]), sizes[a], apart[a], lows[a])
            large = Tree(np.stack([maps[i][:n] | maps[i][n:] for i in b]), sizes[b], apart[b], lows[b])
            for i, j in dual(small, large, percent):
                yield from first(a[i], b[j])


def components(links: DataFrame) -> DataFrame:
    """(node, comp): smallest node of each connected component, by alternating large and small stars. Nodes
    without links are absent."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    # a link between two nodes that have the same least neighbour adds nothing to theirs
    nearest = edges.groupBy("u").agg(F.min("v").alias("m"))
    edges = edges.join(nearest, "u").join(nearest.select(F.col("u").alias("v"), F.col("m").alias("k")), "v", "left")
    edges = materialise(edges.where("v = m or k is null or k != m").select("u", "v"), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        done, edges = edges, materialise(small.where("u != v").distinct(), "stars")
        discard(done)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = now


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", hot: int = 4000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs of other than ASCII white space; fewer than ``width`` words are one
    shingle; no words (or null text): 0 shingles, linked with nothing. component_id is the smallest doc_id
    that can be reached by links (null if none there has an id). Repeated rows fall in one class; rows that
    repeat an id with another text are told apart by their sets. An empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sets(b: pd.DataFrame, own: Shingler):
        for i, t in zip(b["id"], b["text"]):
            h = own(t)
            yield i, h, int.from_bytes(hashlib.md5(h.tobytes()).digest()[:8], "little", signed=True) if len(h) else 0

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(width)

        def prefix(h: np.ndarray) -> np.ndarray:
            order = np.argsort(classes[(h & _BUCKET).astype(np.int64)], kind="stable")
            return h[order[: prefix_length(len(h), percent)]].view(np.int64)

        for b in batches:
            for at in range(0, len(b), 500):
                out = [(i, len(h), node, prefix(h) if len(h) else None, bitmap(h).tobytes() if len(h) else None) for i, h, node in sets(b.iloc[at : at + 500], own)]
                yield pd.DataFrame(out, columns=["id", "n", "node", "prefix", "bits"])

    classes = frequency_classes(rows, width)
    signed = materialise(rows.mapInPandas(lean(sign), "id long, n int, node long, prefix array<long>, bits binary"), "signatures")
    # Python reads each text once here; equal sets go on as one node, with the smallest id that has them
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min(F.when(F.col("id") != LOWEST, F.col("id"))).alias("least"))
    nodes = materialise(nodes, "nodes")
    light = materialise(signed.select("id", "n", "node"), "sizes")
    # rows whose set another row has, too, with a smaller id
    repeated = light.where("n > 0").join(nodes.select("node", F.col("id").alias("least_id")), "node").where("id != least_id").select("node", "id").distinct()
    repeated = materialise(repeated, "repeated")
    one = signed.where("n > 0").join(bounded(repeated), ["node", "id"], "left_anti")
    if light.where("n > 0").groupBy("node", "id").count().where("count > 1").limit(1).count():
        one = one.dropDuplicates(["node"])  # rows that repeat id and text
    one = materialise(one.select("node", "n", "prefix", "bits"), "classes")
    discard(signed)
    discard(repeated)
    release(spark)

    # most hashes are in one prefix alone: these are told from a count, and go no further
    shared = materialise(one.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    table_ = spark.sparkContext.broadcast(bit_table(shared))
    most = min(FEW, hot)
    large = materialise(shared.where(F.col("members") > most), "large")
    discard(shared)
    release(spark)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of the hashes in the table; ``t``: how many the set has."""
        bits = table_.value
        for b in batches:
            for begin in range(0, len(b), 500):
                some = b.iloc[begin : begin + 500]
                n, node = some["n"].to_numpy(np.int64), some["node"].to_numpy()
                sizes = np.array([len(x) for x in some["prefix"]], np.int64)
                key = np.concatenate(some["prefix"].tolist()).astype(np.int64)
                pos = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = key & (len(bits) * 8 - 1)
                keep = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                row = np.repeat(np.arange(len(some)), sizes)[keep]
                yield pd.DataFrame({"key": key[keep], "node": node[row], "n": n[row], "rest": n[row] - pos[keep], "t": np.bincount(row, minlength=len(some))[row]})

    entries = materialise(one.select("node", "n", "prefix").mapInPandas(lean(dealt), "key long, node long, n int, rest int, t int"), "dealt")
    table_.destroy()

    def fitting(rows: DataFrame) -> DataFrame:
        """Keys of two members or more. Of two, their sizes must fit, and so must the overlap that is left from
        this key on: a pair that links passes at the first key that both share."""
        told = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("both"), F.min("rest").alias("rest"))
        fits = (100 * F.col("lo") >= percent * F.col("hi")) & ((100 + percent) * F.col("rest") >= percent * F.col("both"))
        return told.where((F.col("members") > 2) | ((F.col("members") == 2) & fits)).select("key", "members", "who")

    # a member whose size fits no other's leaves the block; it must differ from its neighbours in order of size too
    by_size = Window.partitionBy("key").orderBy("n")
    below, above = F.lag("n").over(by_size), F.lead("n").over(by_size)
    met = entries.join(bounded(large), "key")
    near = met.where(F.col("members") <= hot).withColumn("fits", (100 * below >= percent * F.col("n")) | (100 * F.col("n") >= percent * above)).where("fits").drop("fits")
    pair = lambda x, y: (x["node"] != y["node"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & (least_shared(x["n"], y["n"], percent) <= F.least(x["t"], y["t"]))
    few = entries.join(bounded(large), "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("node", "n", "rest", "t")).alias("all")).where(F.size("all") > 1)
    few = few.select("key", F.inline(F.filter("all", lambda x: F.exists("all", lambda y: pair(x, y)))))
    near = materialise(near.unionByName(met.where(F.col("members") > hot)).drop("members").unionByName(few).drop("t"), "near")
    discard(large)
    discard(entries)
    release(spark)
    # blocks of the same members are one
    blocks = fitting(near).groupBy("members", "who").agg(F.min("key").alias("key")).select("key", "members")
    blocks = materialise(blocks, "blocks")
    release(spark)
    member = entries_of = materialise(near.select("key", "node", "n").join(bounded(blocks), "key"), "entries")
    discard(blocks)
    discard(near)
    release(spark)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("key"))
    carried = member.withColumn("r", rank).where(F.col("r") <= CARRIED).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    carried = materialise(one.select("node", "n", F.col("prefix")[0].alias("low"), "bits").join(bounded(materialise(carried, "carried")), "node"), "carried")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(percent / 100)) * 1.0001))
    grid = F.ceil(F.col("members") / F.lit(hot)).cast("int")
    part = F.pmod(F.xxhash64("node"), grid).cast("int")
    cells = F.transform(F.sequence(F.lit(0), grid - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("band"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))).alias("cells")))
    cut = F.transform(F.array(band, band + 1), lambda x: F.struct(x.alias("band"), cells.alias("cells")))
    member = member.withColumn("bands", F.when(F.col("members") > hot, cut).otherwise(whole))
    member = member.select("key", "node", F.explode("bands").alias("x")).select("key", "node", "x.band", F.explode("x.cells").alias("c")).select(F.xxhash64("key", "band", "c.i", "c.j").alias("block"), "node", "key")
    member = materialise(member, "members")
    discard(entries_of)
    discard(one)
    release(spark)

    def candidates(comps: DataFrame | None) -> DataFrame:
        mine, known = member, comps is not None
        if comps is not None:
            mine = member.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            open_ = mine.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("members")).where((F.col("x") != F.col("y")) & (F.col("members") > SMALL)).select("block")
            mine = mine.join(open_, "block")
        else:
            mine = mine.withColumn("comp", F.lit(0).cast("long"))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []

            def run(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
                block = b["block"].to_numpy()
                node, n, low, comp, bits = b["node"].to_numpy(), b["n"].to_numpy(np.int64), b["low"].to_numpy(), b["comp"].to_numpy(), b["bits"].tolist()
                key, keys = b["key"].to_numpy(), b["keys"].tolist()
                edge = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(b)]])
                out: list[np.ndarray] = []
                for s, e in zip(edge[:-1], edge[1:]):
                    if e - s < 2:
                        continue
                    maps = [np.frombuffer(x, _U) for x in bits[s:e]]
                    for i, j in block_pairs(node[s:e], n[s:e], maps, low[s:e], comp[s:e] if known else None, percent, int(key[s]), keys[s:e]):
                        out.append(np.stack([node[s:e][i], node[s:e][j]], axis=1))
                    if sum(map(len, out)) > 50_000:
                        p = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
                        yield pd.DataFrame(p, columns=["a", "b"])
                        out = []
                if out:
                    yield pd.DataFrame(np.unique(np.sort(np.concatenate(out), axis=1), axis=0), columns=["a", "b"])

            for b in batches:
                if b.empty:
                    continue
                k = b["block"].to_numpy()
                last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
                if held and (last or held[-1]["block"].iloc[-1] != k[-1]):
                    first = int(np.flatnonzero(k != k[0])[0]) if last else len(k)
                    if held[-1]["block"].iloc[-1] == k[0]:
                        yield from run(pd.concat([*held, b.iloc[:first]]))
                        if first < last:
                            yield from run(b.iloc[first:last])
                    else:
                        yield from run(pd.concat(held))
                        if last:
                            yield from run(b.iloc[:last])
                    held = []
                elif last:
                    yield from run(b.iloc[:last])
                held.append(b.iloc[last:])
            if held:
                yield from run(pd.concat(held))

        full = mine.join(carried, "node")
        # dealt by a hash of the block: a plain repartition by block is optimised away above a join on block, and
        # adaptive plans may then deal a block's rows to several tasks
        return full.repartition(parts, F.xxhash64("block")).sortWithinPartitions("block", "node").mapInPandas(lean(search), "a long, b long").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link. The set of a pair's first goes, once for many, to where its partners' sets go;
        no task holds more than two sets at a time."""
        part = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")
        role = pairs.select(F.col("b").alias("node"), F.col("a").alias("g"), part).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("g"), part).distinct())
        turn = F.floor((F.row_number().over(Window.partitionBy("node").orderBy("g", "salt")) - 1) / TOGETHER)
        role = role.withColumn("turn", turn).groupBy("node", "turn").agg(F.collect_list(F.struct("g", "salt")).alias("at"))
        role = materialise(role.join(nodes.select("node", "id"), "node").select("id", "node", "at"), "roles")
        texts = rows.join(bounded(role), "id")

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Shingler(width)
            for b in batches:
                for at in range(0, len(b), 200):
                    some = b.iloc[at : at + 200]
                    out = []
                    for (_, h, node), want, places in zip(sets(some, own), some["node"], some["at"]):
                        if node == want:
                            out += [(x["g"], x["salt"], x["g"] != node, node, h.tobytes()) for x in places]
                        if len(out) > 2_000:
                            yield pd.DataFrame(out, columns=["g", "salt", "partner", "node", "hashes"])
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=["g", "salt", "partner", "node", "hashes"])

        met = texts.mapInPandas(lean(again), "g long, salt int, partner boolean, node long, hashes binary")
        met = met.repartition(parts, "g", "salt").sortWithinPartitions("g", "salt", "partner", "node")

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lead, x, last = None, None, None
            for b in batches:
                keep = []
                for g, salt, partner, node, hashes in zip(b["g"], b["salt"], b["partner"], b["node"], b["hashes"]):
                    if not partner:
                        lead, x, last = (g, salt), np.frombuffer(hashes, _U), None
                    elif lead == (g, salt) and node != last:  # rows that repeat id and text come more than once
                        last, y = node, np.frombuffer(hashes, _U)
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * common >= percent * (len(x) + len(y) - common):
                            keep.append((g, node))
                if keep:
                    yield pd.DataFrame(keep, columns=["a", "b"])

        out = materialise(met.mapInPandas(lean(check), "a long, b long"), "links")
        discard(role)
        release(spark)
        return out

    first = materialise(candidates(None), "pairs")
    release(spark)
    links = verified(first)
    comps = materialise(components(links), "components")
    release(spark)
    second = materialise(candidates(comps).join(first, ["a", "b"], "left_anti"), "pairs")
    discard(member)
    discard(carried)
    discard(first)
    release(spark)
    if second.limit(1).count():
        more = verified(second)
        comps = materialise(components(links.unionByName(more)), "components")
        discard(more)
    discard(second)
    discard(links)
    out = nodes.select("node", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = out.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = materialise(out.join(least, "comp").select("node", "component_id"), "components")
    discard(comps)
    own = F.when(F.col("id") != LOWEST, F.col("id"))
    return (
        light.where("n > 0").join(of, "node").select(own.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
        .unionByName(light.where("n = 0").select(own.alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), own.alias("component_id")))
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
, r AS (
  WITH RECURSIVE reach(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.doc_id)
  SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
"""
