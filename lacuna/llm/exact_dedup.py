"""Exact deduplication with skew-safe combining (DataFrame operations only).

Groups are combined in three steps, each comparing the whole normalised text: within every input
partition (Spark's map-side partial aggregate), within (digest, salt) groups, and, for the digests that
were salted, over the winners of all salts. Salts are used only for digests that hold more than
``hot_share`` of all rows. There can be at most ``1 / hot_share`` of those, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialise, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, hot_share: float = 1e-4) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Rows with a null id count in group_size; such a row is kept only if no row
    of its group has an id. Rows that repeat the winning id are all marked kept, as they cannot be told
    apart. Texts are compared whole, however long. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    rows = rows.select("doc_id", "body", F.unhex(F.sha2("body", 256)).alias("digest"), F.xxhash64("body").alias("check"))
    light = materialise(rows.select("doc_id", "digest", "check"), "digests")
    least = light.count() * hot_share
    # at most 1 / hot_share digests can hold more than that share of the rows
    hot = materialise(light.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > least).select("digest", F.lit(True).alias("hot")), "hot")

    salted = (
        rows.join(F.broadcast(hot), "digest", "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)))
        .groupBy("digest", "check", "salt", "body", "hot")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        # an unsalted group is complete: only winners of salts carry their text on
        .select("digest", "check", "hot", F.when(F.col("hot"), F.col("body")).alias("body"), "keep_id", "n")
    )
    groups = materialise(
        salted.groupBy("digest", "check", "hot", "body")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("parts"))
        .withColumn("group_size", F.when(F.col("hot").isNull() & (F.col("parts") > 1), F.raise_error(F.lit("two different texts share both digests"))).otherwise(F.col("group_size")))
        .select("digest", "check", "hot", "keep_id", "group_size"),
        "groups",
    )
    marked = light.join(F.broadcast(hot), "digest", "left")
    of_hot = marked.where("hot").drop("hot").join(F.broadcast(groups.where("hot").drop("hot")), ["digest", "check"])
    of_rest = marked.where("hot is null").drop("hot").join(groups.where("hot is null").drop("hot"), ["digest", "check"])
    return of_hot.unionByName(of_rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = f"""
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM (
  SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
)
"""
