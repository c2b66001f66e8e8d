"""Corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, token encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import language_id, line_dedup, mixing, ngram_join, sentencepiece_codec
from lacuna.llm.common import bounded, discard, free_names, materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents far from every language's centroids, or without a letter (null and empty ones too), go; the rest keep
    their rows, repeated ones and such without an id included. Where no row has a label, none is rejected."""
    model = language_id.train(docs, F.lit(True))
    if not model.langs:
        return docs
    found = language_id.predict(docs, model)
    return found.where(~F.col(found.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier go; a document goes only if it lost lines and nothing but white space is left of it.
    Null and empty texts stay. Rows equal in id and text count as one document, so each keeps its lines."""
    out = line_dedup.drop_repeated_lines(docs)
    exact, near = out.columns[-2:]
    out = out.where((F.col(exact) + F.col(near) == 0) | F.col("text").rlike(r"\S"))
    size = {"n_chars": F.length("text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {}
    return out.withColumns(size).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, the smallest doc_id stays.

    Rows are told apart by a 64-bit hash of id and text, so that one without an id, or one that repeats an id
    with another text, goes only if it is linked with one that stays. A component without any id keeps the
    smallest hash. Rows equal in id and text count as one document."""
    key, name = F.xxhash64("doc_id", "text"), free_names(["key"], docs.columns)[0]
    ids = docs.select(key.alias("key"), "doc_id")
    of = ngram_join.jaccard_components(docs.select(key.alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias("key"), "component_id")
    of = of.distinct().join(ids.distinct(), "key")
    stays = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias(name))
    stays = materialise(stays.select(name), "stays")
    out = docs.withColumn(name, key).join(bounded(stays), name, "left_semi")
    if ids.groupBy("key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([name])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights of rows ** 0.7. Each document comes once for every epoch that its source needs to
    hold its weight until the largest source has been given once; none is left out. Rows without an
    id, and rows that repeat one, are placed each by itself.
    The rows are range-ordered by slot, so that the files, by name, hold the schedule's interleaving."""
    placed = mixing.mix(docs, carry=True).orderBy("slot", "doc_id")
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text."""
    return sentencepiece_codec.encode_documents(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Edit joins, components of links and BPE cannot be told in SQL in reasonable time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if read is not None:
            discard(read)
        read = docs
    return docs
