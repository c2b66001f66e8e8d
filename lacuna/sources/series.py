"""Series sources: long tables (series_id, pos, t_ms, value, valid), dense in pos, which counts from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.sql import finite

HOUR_US = 3_600_000_000


def densify(observed: DataFrame, keys: tuple[str, ...] = ("series_id",), slot: str = "slot") -> DataFrame:
    """Complete grid of whole slots from the first to the last of every series; missing ones have null in all other
    columns. Each row gives itself and the slots up to the next one, so nothing is joined. A null slot, and two
    rows of one slot, are errors. Adds ``pos``."""
    w = W.partitionBy(*keys)
    after = F.lead(slot).over(w.orderBy(slot))
    observed = observed.withColumn(slot, F.coalesce(slot, F.raise_error(F.lit("null slot")).cast("long")))
    rows = observed.withColumns({"__next": after, "__first": F.min(slot).over(w)})
    bad = F.when(F.col("__next") == F.col(slot), F.raise_error(F.lit("repeated slot")))
    rows = rows.withColumn("__at", F.explode(F.sequence(F.col(slot), F.coalesce(bad.cast("long"), F.col("__next"), F.col(slot) + 1) - 1)))
    rest = [F.when(F.col("__at") == F.col(slot), F.col(c)).alias(c) for c in observed.columns if c not in (*keys, slot)]
    return rows.select(*keys, F.col("__at").alias(slot), (F.col("__at") - F.col("__first")).alias("pos"), *rest)


def numbered(frame: DataFrame, series: str, order: str) -> DataFrame:
    """Adds ``pos`` by the order of a column, for frames whose rows are samples already."""
    return frame.withColumn("pos", F.row_number().over(W.partitionBy(series).orderBy(order)).cast("long") - 1)


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per event type and hour, over all hours that the type spans; a deterministic rule marks some
    samples invalid."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(HOUR_US)).cast("long")
    observed = events.groupBy(F.col("event_type").alias("series_id"), hour.alias("slot")).agg(finite(F.avg("value")).alias("value"))
    rule = F.pmod(F.col("pos") * 7919 + F.length("series_id") * 104729, F.lit(37)) >= 2
    return densify(observed).select("series_id", "pos", (F.col("slot") * 3_600_000).cast("double").alias("t_ms"), "value", (F.col("value").isNotNull() & rule).alias("valid"))
