"""Language identification by nearest centroid.

Every text becomes a vector of hashed byte n-gram counts (letters only, lower-cased), damped, weighted by
inverse document frequency and scaled to unit length. Each language is represented by several centroids
found by spherical k-means. The nearest centroid by cosine gives the language; a text farther from all
centroids than nearly all training texts of that language is rejected.

Document frequencies are counted over all labelled texts. The centroids are fitted on the driver from the gram
counts of at most ``sample`` texts of each language; every text, in training and prediction, is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, give_back, lean, small_batches, table

DIMS = 1 << 13
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def counts(text: str) -> np.ndarray | None:
    """Hashed counts of 1- to 4-byte grams of the text's words; None without letters."""
    words = _OTHER.sub(" ", text).lower()
    if not _LETTER.search(text):
        return None
    data = np.frombuffer(f" {words} ".encode(), np.uint8).astype(np.uint32)
    out, gram = np.zeros(DIMS), data
    for n in range(1, 5):
        if n > 1:
            gram = gram[:-1] * np.uint32(0x01000193) ^ data[n - 1 :]
        if len(gram):
            out += np.bincount((gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(19), minlength=DIMS)
    return out


class Centroids:
    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], floors: np.ndarray):
        self.idf, self.centres, self.langs, self.floors = idf, centres, langs, floors

    def vector(self, count: np.ndarray) -> np.ndarray:
        v = np.log1p(count) * self.idf
        return v / max(np.linalg.norm(v), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine to its nearest centroid, rejected); 'und' where a text has no letter."""
        found = [counts(t) if t else None for t in texts]
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        rows = [i for i, c in enumerate(found) if c is not None]
        if rows and self.langs:
            cos = np.stack([self.vector(found[i]) for i in rows]) @ self.centres.T
            for i, best, score in zip(rows, cos.argmax(axis=1), cos.max(axis=1)):
                out[i] = self.langs[best], float(min(1.0, max(0.0, score))), bool(score < self.floors[best])
        return out


def fit(texts: list[str], langs: list[str], **how) -> Centroids:
    """From texts, with document frequencies over them alone."""
    pairs = [(c, g) for c, g in zip(map(counts, texts), langs) if c is not None]
    raw = np.stack([c for c, _ in pairs]) if pairs else np.zeros((0, DIMS))
    return fit_counts(raw, [g for _, g in pairs], (raw > 0).sum(axis=0), len(raw), **how)


def fit_counts(raw: np.ndarray, langs: list[str], having: np.ndarray, of: int, clusters: int = 4, rounds: int = 8, seed: int = 7, quantile: float = 0.001, slack: float = 0.5) -> Centroids:
    """From gram counts; ``having`` of ``of`` texts have each gram. A text is rejected below ``slack`` times the
    training texts' lowest ``quantile`` of cosine."""
    if not len(raw):
        return Centroids(np.ones(DIMS), np.zeros((0, DIMS)), [], np.zeros(0))
    idf = (np.log((1 + of) / (1 + having)) + 1).astype(np.float32)
    x = raw.astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng, centres, names, floors = np.random.default_rng(seed), [], [], []
    for lang in sorted(set(langs)):
        own = x[[g == lang for g in langs]]
        c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
        for _ in range(rounds):
            nearest = (own @ c.T).argmax(axis=1)
            c = np.stack([own[nearest == k].mean(axis=0) if (nearest == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        floor = np.quantile((own @ c.T).max(axis=1), quantile) * slack
        centres += list(c)
        names += [lang] * len(c)
        floors += [floor] * len(c)
    return Centroids(idf, np.stack(centres), names, np.array(floors))


#: More languages than this are refused: the model holds several centroids of each.
MAX_LANGS = 2_000


def train(docs: DataFrame, usable: Column, sample: int = 250, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Centroids:
    """Fit on at most ``sample`` usable labelled rows of each language, those that come first by a hash of id and
    text (ties, and rows that repeat both, in any order: they are equal); a language with fewer gives all. Texts
    without a letter teach nothing. Document frequencies are over all usable rows. Null text and null lang are left
    out; an empty table gives a model that knows no language.

    A threshold on the hash leaves about twice as many rows before they are ordered. Grams are counted by the
    executors, so that no text is sent to the driver."""
    small_batches(docs.sparkSession)
    h, space = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40)), 1 << 40
    good = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    good = good.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g"), h.alias("h"))
    sizes = good.groupBy("g").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return fit([], [])
    spark = docs.sparkSession
    below = spark.createDataFrame([(r.g, int(space * min(1.0, 2 * sample / r.n))) for r in sizes], "g string, below long")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many texts have each gram, and (gram -1) how many there are."""
        having, of = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for c in map(counts, b["t"]):
                if c is not None:
                    having += c > 0
                    of += 1
        yield pd.DataFrame({"gram": np.arange(-1, DIMS), "n": np.concatenate([[of], having])})

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [((g, h), c) for g, h, c in zip(b["g"], b["h"], map(counts, b["t"])) if c is not None]
            if found:
                yield pd.DataFrame({"g": [g for (g, _), _ in found], "h": [h for (_, h), _ in found], "at": [np.flatnonzero(c).astype(np.int32) for _, c in found], "n": [c[c > 0].astype(np.int32) for _, c in found]})

    having = np.zeros(DIMS + 1, np.int64)
    for r in good.select("t").mapInPandas(lean(partial), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        having[r.gram + 1] = r.n
    few = good.join(F.broadcast(below), "g").where("h <= below")
    few = few.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("h"))).where(F.col("r") <= sample)
    rows = few.select("t", "g", "h").mapInPandas(lean(sparse), "g string, h long, at array<int>, n array<int>").toPandas().sort_values(["g", "h"])
    raw = np.zeros((len(rows), DIMS), np.float32)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"])):
        raw[i, np.asarray(at)] = n
    langs = rows["g"].tolist()
    del rows
    return fit_counts(raw, langs, having[1:], int(having[0]))


def predict(docs: DataFrame, model: Centroids, text_col: str = "text", chunk: int = 256) -> DataFrame:
    """All columns of docs and lang_pred, score, rejected. 'und', 0 and rejected for null or letterless text. Of
    equally near centroids the first by language wins; repeated rows are predicted alike; texts are read whole;
    an empty table gives no rows. Where docs has a column of these names, that of the result gets an underscore
    more; the three are always the last."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.tolist()
            rows = [r for i in range(0, len(texts), chunk) for r in shared.value.predict(texts[i : i + chunk])]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])
        give_back()

    names = free_names(["lang_pred", "score", "rejected"], docs.columns)
    held = free_names(["__lang"], docs.columns)[0]
    return docs.withColumn(held, run(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(held)[c].alias(n) for c, n in zip(["lang_pred", "score", "rejected"], names)])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null id count as not held out; repeated rows are predicted alike; extra columns are ignored;
    an empty table gives no rows, and without any labelled row every text is 'und'."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
