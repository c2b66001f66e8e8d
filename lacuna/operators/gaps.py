"""Gap geometry: islands of missing samples, eligible artificial gaps, overlap, masking, audits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_order():
    return W.partitionBy("series_id").orderBy("pos")


def islands(samples: DataFrame, flag: str) -> DataFrame:
    """Maximal runs [gap_start, gap_end) of samples whose flag is true. One sort per series: the run number is
    pos less the running count of flagged samples, so no second window is needed."""
    run = F.col("pos") - F.row_number().over(in_order())
    runs = samples.where(F.col(flag)).select("series_id", "pos", run.alias("run")).groupBy("series_id", "run")
    return runs.agg(F.min("pos").alias("gap_start"), (F.max("pos") + 1).alias("gap_end"), F.count("*").alias("n")).drop("run")


def missing_gaps(samples: DataFrame) -> DataFrame:
    return islands(samples.withColumn("missing", ~F.col("valid")), "missing")


def regions(samples: DataFrame, flag: str) -> DataFrame:
    """Islands numbered from 1 in each series."""
    return islands(samples, flag).withColumn("region", F.row_number().over(W.partitionBy("series_id").orderBy("gap_start")).cast("long"))


def gap_count(samples: DataFrame) -> DataFrame:
    return missing_gaps(samples).groupBy("series_id").agg(F.count("*").alias("n_gaps"))


def gap_audit(samples: DataFrame) -> DataFrame:
    """Coverage, share of zeros and extremes of each series; number, shortest and longest of its missing runs."""
    seen = F.when(F.col("valid"), F.col("value"))
    per = samples.groupBy("series_id").agg(F.avg(F.col("valid").cast("double")).alias("coverage"), F.avg((seen == 0).cast("double")).alias("zero_share"), F.min(seen).alias("low"), F.max(seen).alias("high"))
    runs = missing_gaps(samples).groupBy("series_id").agg(F.count("*").alias("n_gaps"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return per.join(runs, "series_id", "left").fillna(0, ["n_gaps"])


def eligible_series(audit: DataFrame, coverage: float = 0.95, longest: int = 288) -> DataFrame:
    """Series with enough coverage and no run longer than so many samples. One without any run has no longest run
    and does not pass."""
    return audit.where((F.col("coverage") >= coverage) & (F.col("longest") <= longest))


def candidates(samples: DataFrame, lengths: tuple[int, ...], multiple: float = 1.0, share: float = 0.8, least: int = 2) -> DataFrame:
    """Starts where a gap of one of the lengths is wholly valid between valid neighbours, with enough valid context
    on each side: ``multiple`` times the length (halves to even), ``least`` at least. All frames share one sort."""
    v, w = F.col("valid").cast("int"), in_order()

    def of(n: int) -> tuple[dict[str, Column], Column]:
        c = max(least, round(multiple * n))
        frames = {
            f"in{n}": F.sum(v).over(w.rowsBetween(0, n - 1)), f"be{n}": F.sum(v).over(w.rowsBetween(-c, -1)),
            f"af{n}": F.sum(v).over(w.rowsBetween(n, n + c - 1)), f"ri{n}": F.lead("valid", n).over(w),
        }
        fits = (F.col("pos") >= c) & (F.col("pos") + n + c - 1 <= F.col("last"))
        ok = fits & (F.col(f"in{n}") == n) & F.col("left") & F.col(f"ri{n}") & (F.col(f"be{n}") >= share * c) & (F.col(f"af{n}") >= share * c)
        one = F.struct(F.lit(n).cast("long").alias("length"), F.lit(c).cast("long").alias("c"), (F.col(f"be{n}") / c).alias("left_share"), (F.col(f"af{n}") / c).alias("right_share"))
        return frames, F.when(ok, one)

    made = [of(n) for n in dict.fromkeys(lengths)]
    seen = samples.select("series_id", "pos", F.lag("valid").over(w).alias("left"), F.max("pos").over(W.partitionBy("series_id")).alias("last"), *[x.alias(k) for frames, _ in made for k, x in frames.items()])
    hit = seen.select("series_id", "pos", F.explode(F.filter(F.array(*[x for _, x in made]), lambda x: x.isNotNull())).alias("x")).select("series_id", "pos", "x.*")
    return hit.select(
        "series_id", "length", F.col("pos").alias("gap_start"), (F.col("pos") + F.col("length")).alias("gap_end"), (F.col("pos") - F.col("c")).alias("ctx_start"),
        (F.col("pos") + F.col("length") + F.col("c")).alias("ctx_end"), "left_share", "right_share",
        F.format_string("%s_%d_%d", "series_id", "length", "pos").alias("gap_id"),
    )


def _positions(windows: DataFrame) -> DataFrame:
    return windows.withColumn("pos", F.explode(F.sequence("ctx_start", F.col("ctx_end") - 1)))


def without_overlap(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``found`` whose whole window overlaps no window of ``chosen``. Windows are short, so they meet by
    their positions; a range join on the series alone would compare all with all of a long series."""
    taken = _positions(chosen).select("series_id", "pos").distinct()
    hit = _positions(found.select("series_id", "gap_id", "ctx_start", "ctx_end")).join(taken, ["series_id", "pos"]).select("gap_id").distinct()
    return found.join(hit, "gap_id", "left_anti")


def mask(samples: DataFrame, gaps: DataFrame, check: bool = False) -> DataFrame:
    """Context and gap samples of every gap: side L, G (value hidden, truth kept) or R, ``original_is_valid`` and
    ``is_artificial_gap``. Windows are exploded and meet the samples by (series, position). With ``check`` a gap
    that is not wholly observed is an error."""
    g = _positions(gaps.select("gap_id", "series_id", "gap_start", "gap_end", "ctx_start", "ctx_end", "length", "left_share", "right_share"))
    j = samples.join(g, ["series_id", "pos"])
    inside = (F.col("pos") >= F.col("gap_start")) & (F.col("pos") < F.col("gap_end"))
    side = F.when(inside, "G").when(F.col("pos") < F.col("gap_start"), "L").otherwise("R")
    truth = F.when(inside & ~F.col("valid"), F.raise_error(F.lit("the gap is not wholly observed")).cast("double")).when(inside, F.col("value")) if check else F.when(inside, F.col("value"))
    return j.select(
        "gap_id", "series_id", "length", "gap_start", "gap_end", "left_share", "right_share", "pos", "t_ms", side.alias("side"),
        F.when(~inside & F.col("valid"), F.col("value")).alias("value"), truth.alias("truth"), F.col("valid").alias("original_is_valid"), inside.alias("is_artificial_gap"),
    )


def runtime_context(samples: DataFrame, share: float = 0.8, least: int = 2, multiple: float = 1.0) -> DataFrame:
    """Every real gap with its context, clipped to the series: counts and shares of valid samples on each side, the
    duration from its first sample to the first after it, and why it can not be filled, if so."""
    gaps = missing_gaps(samples)
    c = F.greatest(F.lit(least), F.ceil(F.col("n") * multiple)).cast("long")
    ends = samples.groupBy("series_id").agg((F.max("pos") + 1).alias("size"))
    gaps = gaps.withColumn("c", c).join(ends, "series_id")
    gaps = gaps.withColumns({"lo": F.greatest(F.col("gap_start") - F.col("c"), F.lit(0)), "hi": F.least(F.col("gap_end") + F.col("c"), F.col("size"))})
    around = gaps.withColumn("pos", F.explode(F.sequence("lo", F.col("hi") - 1))).join(samples.select("series_id", "pos", "t_ms", "valid"), ["series_id", "pos"])
    left, right = F.col("pos") < F.col("gap_start"), F.col("pos") >= F.col("gap_end")
    a = around.groupBy("series_id", "gap_start", "gap_end", "n", "c", "size").agg(
        F.count_if(left & F.col("valid")).alias("left_valid"), F.count_if(right & F.col("valid")).alias("right_valid"), F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"),
        (F.max(F.when(F.col("pos") == F.col("gap_end"), F.col("t_ms"))) - F.max(F.when(F.col("pos") == F.col("gap_start"), F.col("t_ms")))).alias("duration_ms"),
    )
    part = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n))
    edge = (F.col("gap_start") < F.col("c")) | (F.col("gap_end") + F.col("c") > F.col("size"))
    poor = (part("left_valid", "n_left") < share) | (part("right_valid", "n_right") < share)
    return a.select(
        "series_id", "gap_start", "gap_end", F.col("c").alias("context"), "left_valid", "right_valid", part("left_valid", "n_left").alias("left_share"), part("right_valid", "n_right").alias("right_share"),
        "duration_ms", F.when(edge, "insufficient_edge_context").when(poor, "insufficient_valid_context").alias("reason"),
    )


def moved(gaps: DataFrame, by: Column) -> DataFrame:
    """Geometry so many positions on."""
    return gaps.withColumns({k: F.col(k) + by for k in ("gap_start", "gap_end", "ctx_start", "ctx_end")})


def from_manifest(rows: DataFrame, step_ms: float) -> DataFrame:
    """Geometry rebuilt from stored starts, lengths and contexts, with durations of whole steps."""
    return rows.withColumns({"gap_end": F.col("gap_start") + F.col("length"), "duration_ms": F.col("length") * F.lit(float(step_ms))})


def compact(samples: DataFrame, gaps: DataFrame, period: int, offsets: int = 8) -> DataFrame:
    """Only the samples that a gap's methods can reach: its window, and its own positions at 1 to ``offsets``
    periods before and after; numbered anew within the gap as ``at``."""
    own = _positions(gaps.select("gap_id", "series_id", "ctx_start", "ctx_end", "gap_start", "gap_end")).select("gap_id", "series_id", "pos")
    shifts = [F.lit(d * k * period).cast("long") for k in range(1, offsets + 1) for d in (-1, 1)]
    far = gaps.select("gap_id", "series_id", F.explode(F.sequence("gap_start", F.col("gap_end") - 1)).alias("p")).select("gap_id", "series_id", F.explode(F.array(*[F.col("p") + s for s in shifts])).alias("pos"))
    kept = samples.join(own.unionByName(far).distinct(), ["series_id", "pos"])
    return kept.withColumn("at", F.row_number().over(W.partitionBy("gap_id").orderBy("pos")).cast("long") - 1)


def strata(low: float, high: float, n: int) -> list[tuple[float, float]]:
    """Equal widths between two durations; all but the last are open above."""
    if not (0 < low <= high and math.isfinite(high) and n > 0):
        raise ValueError("durations must be positive, finite and in order")
    edges = [low + (high - low) * i / n for i in range(n)] + [high]
    return [(edges[i], edges[i + 1] if i == n - 1 else math.nextafter(edges[i + 1], -math.inf)) for i in range(n)]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
