"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for one text, the running polynomial hash modulo two primes. The hash of any span then
takes constant time, spans compare without their characters, and the longest common extension of two
places is found by binary search. A fingerprint is a bottom-k sketch: the ``KEPT`` smallest mixed hashes
among those of all spans of ``SPAN`` code points. Equal texts have equal fingerprints, and the share of the
smallest hashes of the union that both have estimates the share of spans in common. Next to this estimate stands
an exact figure from extension queries: spans that both texts have are extended both ways as far as the texts
agree, and the code points so reached are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1299709177)
SPAN, KEPT = 16, 128
_U = np.uint64


class _Powers:
    """Powers of the bases and of their inverses, grown on demand."""

    def __init__(self):
        self.up = [np.ones(1, _U), np.ones(1, _U)]
        self.down = [np.ones(1, _U), np.ones(1, _U)]

    def get(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = _U(PRIMES[which])
        for rows, base in ((self.up, BASES[which]), (self.down, pow(BASES[which], -1, PRIMES[which]))):
            while len(rows[which]) < n:
                have = rows[which]
                step = _U(pow(base, len(have), PRIMES[which]))
                rows[which] = np.concatenate([have, have * step % p])
        return self.up[which], self.down[which]


_POWERS = _Powers()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(_U)


class Prefix:
    def __init__(self, text: str | np.ndarray):
        c = points(text) if isinstance(text, str) else text
        self.n, self.sums, self._all = len(c), [], None
        for w, p in enumerate(PRIMES):
            up, _ = _POWERS.get(w, self.n + 1)
            s = np.zeros(self.n + 1, _U)
            np.cumsum((c + _U(1)) * up[: self.n] % _U(p), out=s[1:])  # below 2**31 each: no overflow up to 2**33 code points
            self.sums.append(s % _U(p))

    def span(self, begin, end) -> np.ndarray:
        """62-bit hashes of spans [begin, end); arrays or numbers."""
        out = _U(0)
        for w, p in enumerate(PRIMES):
            _, down = _POWERS.get(w, self.n + 1)
            h = (self.sums[w][end] + _U(p) - self.sums[w][begin]) % _U(p) * down[begin] % _U(p)
            out = out << _U(31) | h
        return out

    def spans(self) -> np.ndarray:
        """Hashes of the spans of SPAN code points at every place; a shorter text is one span, an empty one none."""
        if self._all is None:
            at = np.arange(max(1, self.n - SPAN + 1) if self.n else 0)
            self._all = self.span(at, np.minimum(at + SPAN, self.n))
        return self._all

    @classmethod
    def joined(cls, a: Prefix, cut: int, b: Prefix, size: int) -> Prefix:
        """Of a's first ``cut`` code points followed by b's first ``size``: sums move by a power of the base, spans
        within either side are known, and only those across the seam are worked out."""
        p = cls.__new__(cls)
        p.n, p.sums, p._all = cut + size, [], None
        for w, prime in enumerate(PRIMES):
            up, _ = _POWERS.get(w, p.n + 1)
            tail = (b.sums[w][1 : size + 1] * up[cut] % _U(prime) + a.sums[w][cut]) % _U(prime)
            p.sums.append(np.concatenate([a.sums[w][: cut + 1], tail]))
        if p.n >= SPAN:
            own, last = max(0, cut - SPAN + 1), max(0, size - SPAN + 1)
            seam = np.arange(own, p.n - SPAN + 1 - last)
            p._all = np.concatenate([a.spans()[:own], p.span(seam, seam + SPAN), b.spans()[:last]])
        return p

    def same(self, at: int, other: Prefix, there: int, size: int) -> bool:
        """Whether two spans have equal hashes."""
        for w, p in enumerate(PRIMES):
            x, y, down = self.sums[w], other.sums[w], _POWERS.down[w]
            if ((x.item(at + size) - x.item(at)) * down.item(at) - (y.item(there + size) - y.item(there)) * down.item(there)) % p:
                return False
        return True

    def common(self, at: int, other: Prefix, there: int) -> int:
        """Length of the longest common extension from two places."""
        lo, hi = 0, min(self.n - at, other.n - there)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same(at, other, there, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def common_back(self, at: int, other: Prefix, there: int, most: int) -> int:
        """Length, at most ``most``, of the longest common extension backwards from two places."""
        lo, hi = 0, min(at, there, most)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same(at - mid, other, there - mid, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


def shared(a: Prefix, b: Prefix) -> float:
    """Share of a's code points in passages that b has too, found from a's begin on: the next place whose span equals
    one of b's blocks (spans at multiples of SPAN; the first of equal ones) is extended both ways and passed. So
    every passage of 2 * SPAN - 1 code points in common is met. Of shorter texts the common begin counts; two empty
    texts share all."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    if a.n < SPAN or b.n < SPAN:
        return a.common(0, b, 0) / a.n
    blocks, where = np.unique(b.spans()[::SPAN], return_index=True)
    found = np.minimum(np.searchsorted(blocks, a.spans()), len(blocks) - 1)
    places = np.flatnonzero(blocks[found] == a.spans())
    covered, end, i = 0, 0, 0
    while i < len(places):
        at = int(places[i])
        there = int(where[found[at]]) * SPAN
        back, on = a.common_back(at, b, there, at - end), a.common(at, b, there)
        covered, end = covered + back + on, at + on
        i = int(np.searchsorted(places, end))
    return covered / a.n


def sketch(text: str | np.ndarray | Prefix) -> np.ndarray:
    """The smallest mixed span hashes, distinct and ascending; a shorter text is one span."""
    p = text if isinstance(text, Prefix) else Prefix(text)
    if not p.n:
        return np.zeros(0, _U)
    h = p.spans()
    h = (h ^ h >> _U(31)) * _U(0x9E3779B97F4A7C15)
    h = h ^ h >> _U(29)
    if len(h) > 8 * KEPT:
        near = int(len(h) * 0.9)
        for few in (4 * KEPT, near):
            low = np.unique(np.partition(h, few)[: few + 1])
            if len(low) >= KEPT or few == near:
                break
        if len(low) >= KEPT:
            return low[:KEPT]
    return np.unique(h)[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common spans; two empty texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:KEPT]
    return float(len(np.intersect1d(np.intersect1d(union, a, assume_unique=True), b, assume_unique=True)) / len(union))


def said(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def edited(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness of
    sketches), shared_edited, shared_next (share of the text's code points in passages in common).

    The next document is the one after it in descending doc_id (nulls last; rows that repeat an id follow
    each other by descending text); the last one's next is the first. Null text counts as empty. A single
    document is its own next. Texts of any length are taken whole. An empty table gives no rows; other columns are ignored.

    Rows go to ranges of ids, as many as shuffle partitions; the greatest row of each range also goes to the
    range above, whose least row needs it. No task holds more than two documents at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = partitions(spark)
    ranges = 4 * n
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    edges = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(many: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in many:
            yield pd.Series(np.searchsorted(edges.value, x.to_numpy(), side="right") + 1).astype("int32")

    # ranges are numbered upwards; nulls stand below all ids, in range 0 of their own
    rows = rows.withColumn("b", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(range_of(F.coalesce("doc_id", F.lit(0).cast("long")))))
    top = {r.b: r.m for r in rows.groupBy("b").agg(F.max("doc_id").alias("m")).collect()}
    have = sorted(top)
    # the greatest of a range is the next of the least of the range above; of the highest, of the lowest
    above = {b: have[(i + 1) % len(have)] for i, b in enumerate(have)}
    tails = [(top[b], above[b]) for b in have if top[b] is not None]  # one for each range
    rows = rows.join(F.broadcast(spark.createDataFrame(tails, "doc_id long, goes int")), "doc_id", "left")
    if 0 in top:  # nulls: the greatest of them are those with the greatest text
        most = rows.where("doc_id is null").agg(F.max("text")).first()[0]
        rows = rows.withColumn("goes", F.when(F.col("doc_id").isNull() & (F.col("text") == F.lit(most)), F.lit(above[0])).otherwise(F.col("goes")))
    here = F.struct("b", F.lit(False).alias("tail"))
    place = F.when(F.col("goes").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("goes").alias("b"), F.lit(True).alias("tail"))))
    dealt = (
        rows.select("doc_id", "text", F.explode(place).alias("p"))
        .select("p.b", "p.tail", "doc_id", "text")
        .repartition(n, "b")
        .sortWithinPartitions("b", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (range, id, text, sketch, prefix) of the row that waits for its next
        tailed = None
        for batch in batches:
            out = []
            for b, tail, doc, text in zip(batch["b"], batch["tail"], batch["doc_id"], batch["text"]):
                if tail and tailed == b:
                    continue  # only the first of several rows with the range's greatest id
                prefix = Prefix(text)
                own = sketch(prefix)
                if held is not None and held[0] == b:
                    new = edited(held[2], text)
                    cut = len(held[2]) - len(held[2]) // 3
                    new_prefix = Prefix.joined(held[4], cut, prefix, len(new) - cut)
                    new_sketch = sketch(new_prefix)
                    out.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), said(held[3]), said(new_sketch), likeness(held[3], new_sketch), likeness(held[3], own), shared(held[4], new_prefix), shared(held[4], prefix)))
                tailed = b if tail else None
                held = None if tail else (b, doc, text, own, prefix)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_edited", "shared_next"]).astype({"doc_id": "Int64"})

    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited double, shared_next double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
