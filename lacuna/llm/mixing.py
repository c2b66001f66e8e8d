"""Mixing of sources to target weights by Pfair scheduling (DataFrame operations only).

Every source's rows are cut into blocks. Block j of a source with weight w may be placed no earlier than
slot floor(j / w) (release) and must be placed before slot ceil((j + 1) / w) (deadline). In each slot the
released block with the earliest deadline goes first; every source is then always within one block of its
share. With weights in whole parts of ``period`` the schedule repeats after ``period`` slots, so it is worked
out once, for one period, on the driver over the small table of sources; where a block goes follows by arithmetic.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded, materialise, partitions, table

#: More sources than this are refused: the schedule's table has a row for each slot of the period.
MAX_SOURCES = 50_000


def target_parts(counts: DataFrame, weights: dict[str, float] | None, power: float, period: int) -> DataFrame:
    """(source, parts): whole parts of the period, at least 1 each, by largest remainder. Given weights need
    not sum to 1; sources without one, and all by default, weigh rows ** power."""
    raw = F.pow(F.col("rows").cast("double"), F.lit(power))
    if weights:
        raw = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()], raw)
    every = W.partitionBy()  # one row a source
    w = counts.withColumn("w", raw).withColumn("n", F.count("*").over(every)).withColumn("share", F.col("w") / F.sum("w").over(every) * (F.lit(period) - F.col("n")))
    w = w.withColumn("base", F.floor("share")).withColumn("left", F.lit(period) - F.col("n") - F.sum(F.floor("share")).over(every))
    rank = F.row_number().over(W.orderBy((F.col("base") - F.col("share")), F.col("source").asc_nulls_first()))
    return w.withColumn("parts", (1 + F.col("base") + F.when(rank <= F.col("left"), 1).otherwise(0)).cast("long")).select("source", "rows", "parts")


def pfair_slots(parts: DataFrame, period: int) -> DataFrame:
    """(source, turn, slot) for one period: earliest deadline first among released blocks."""
    own = parts.select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"), "parts")
    p = [int(r.parts) for r in own.orderBy("named", "source").collect()]
    order, due, waiting = [], [], [[] for _ in range(period)]
    if p:
        waiting[0] = [(i, 0) for i in range(len(p))]
    for slot in range(period if p else 0):
        for i, done in waiting[slot]:
            heapq.heappush(due, (-(-(done + 1) * period // p[i]), -p[i], i, done))
        _, _, i, done = heapq.heappop(due)
        order.append(i)
        if done + 1 < p[i]:
            release = max(slot + 1, (done + 1) * period // p[i])
            waiting[release].append((i, done + 1))
    spark = parts.sparkSession
    names = own.agg(F.array_sort(F.collect_list(F.struct("named", "source"))).alias("s")).select(F.posexplode("s").alias("i", "x"))
    said = F.split(F.lit(",".join(map(str, order)) or "0"), ",").cast("array<int>")
    slots = spark.range(min(1, len(p))).select(F.posexplode(said).alias("slot", "i")).join(F.broadcast(names), "i")
    turn = F.row_number().over(W.partitionBy("i").orderBy("slot")) - 1
    return slots.select(F.when(F.col("x.named"), F.col("x.source")).alias("source"), turn.cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, period: int | None = None, block_rows: int = 8, bucket_rows: int = 20_000, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = None, carry: bool = False) -> DataFrame:
    """One row for each placement: doc_id, source, epoch, block (of the source, over all epochs), slot (, row).

    Slots in ascending order are the mixture. It goes on for as many whole periods as the slowest source
    needs to give all of its rows; no row is left out, and a faster source begins its rows again (epoch 1,
    2, ...). Within an epoch a source's rows come in hash order; rows that repeat an id, and null ids, follow
    each other. A null source is a source. Other columns are ignored; an empty table gives no rows.
    The period is 1,000 slots, or four a source if that is more; a given one is kept if it has two a source.
    With ``carry`` every placement holds its whole input row as a struct, and the hash is of all columns, so
    that rows of one id, or of none, are placed each by itself.
    A source is numbered in buckets, ranges of the hash that are fewer and larger the fewer partitions there are, and
    hold ``bucket_rows`` rows at most, so that none is ranked in one task; the order does not depend on them.
    Texts are carried whole, however long.
    """
    spark = docs.sparkSession
    held = ["row"] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    rows = rows.select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("src"), "doc_id", F.xxhash64("doc_id", *held).alias("h"), *held)
    counts = materialise(rows.groupBy("named", "src").agg(F.count("*").alias("rows")), "sources")
    n, total = counts.agg(F.count("*"), F.sum("rows")).first()
    if n > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # every source has a part, and there must be others to share out by weight
    period = max(1000, 4 * n) if period is None or period < 2 * n else period
    parts = materialise(target_parts(counts.select(F.when(F.col("named"), F.col("src")).alias("source"), "rows"), weights, power, period), "parts")
    slots = materialise(pfair_slots(parts, period), "slots")
    # ceil(rows / block) blocks an epoch; periods: enough for the slowest source
    size = max(1, min(bucket_rows, -(-(total or 0) // (4 * partitions(spark)))))
    plan = parts.select("source", F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("src"), "parts", F.ceil(F.col("rows") / F.lit(float(block_rows))).alias("blocks"), F.ceil(F.col("rows") / F.lit(float(size))).alias("buckets"))
    periods = plan.agg(F.max(F.ceil(F.col("blocks") / F.col("parts")))).first()[0] or 0
    # one row a source
    dealt = rows.join(F.broadcast(plan), ["named", "src"])
    dealt = dealt.withColumn("bucket", F.least(F.floor(F.shiftrightunsigned("h", 1) / F.lit(2.0**63) * F.col("buckets")), F.col("buckets") - 1))
    sizes = dealt.groupBy("named", "src", "bucket").agg(F.count("*").alias("n"))
    ahead = materialise(sizes.select("named", "src", "bucket", (F.sum("n").over(W.partitionBy("named", "src").orderBy("bucket")) - F.col("n")).alias("before")), "buckets")
    turn = F.row_number().over(W.partitionBy("named", "src", "bucket").orderBy("h", "doc_id")) - 1
    ranked = dealt.withColumn("turn", turn).join(bounded(ahead), ["named", "src", "bucket"])
    ranked = ranked.withColumn("block", F.floor((F.col("before") + F.col("turn")) / F.lit(float(block_rows))))
    given = F.col("parts") * F.lit(periods)  # blocks that the source gives in all
    epochs = F.ceil((given - F.col("block")) / F.col("blocks"))
    out = ranked.where(given > F.col("block")).select("doc_id", "source", "parts", "blocks", "block", *held, F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)).alias("epoch"))
    out = out.withColumn("block", F.col("block") + F.col("epoch") * F.col("blocks")).withColumn("turn", F.pmod("block", F.col("parts")))
    # at most `period` rows
    hit = slots.select(F.col("source").alias("s"), F.col("turn").alias("t"), F.col("slot").alias("within"))
    out = out.join(F.broadcast(hit), F.col("source").eqNullSafe(F.col("s")) & (F.col("turn") == F.col("t")))
    return out.select("doc_id", "source", "epoch", "block", (F.expr("block div parts") * period + F.col("within")).alias("slot"), *held)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
