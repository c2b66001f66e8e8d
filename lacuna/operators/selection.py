"""Choice of a method for each gap from predicted errors or gains; scale floors that know no held-out group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Held-out groups are a dimension (stations, districts, data sets).
MAX_GROUPS = 10_000


def rank_candidates(scores: DataFrame, error: str = "nrmse") -> DataFrame:
    """Methods of each gap by error, then by order of the portfolio; methods without an error are left out."""
    w = W.partitionBy("gap_id").orderBy(error, "method_ord")
    return scores.where(F.col(error).isNotNull()).select("gap_id", "method", F.row_number().over(w).cast("long").alias("rank"))


def lowest(scores: DataFrame, score: str = "predicted", applicable: str | None = None) -> DataFrame:
    """(gap_id, method, score) of the lowest score, among applicable methods if asked; the first of the portfolio on
    ties. A gap without any is an error."""
    ok = F.col(score).isNotNull() if applicable is None else F.col(score).isNotNull() & F.col(applicable)
    b = scores.groupBy("gap_id").agg(F.min(F.when(ok, F.struct(F.col(score).alias("score"), "method_ord", "method"))).alias("b"))
    return b.select("gap_id", F.when(F.col("b").isNull(), F.raise_error(F.lit("no method applies"))).otherwise(F.col("b.method")).alias("method"), F.col("b.score").alias("score"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def select_challenger(gains: DataFrame, default: str = "pchip", least: float = 0.0, z: float = 1.0, by: str = "lcb") -> DataFrame:
    """(gap_id, gain, uncertainty, method, applicable) -> the method of each gap, why, and its score: the default
    unless an applicable method's gain and uncertainty are finite, the gain is ``least`` or more, and gain - z *
    uncertainty is above 0. Of several, the highest bound (or mean gain) wins, on ties the method last by name."""
    if by not in ("lcb", "mean"):
        raise ValueError("by must be lcb or mean")
    bound = F.col("gain") - z * F.col("uncertainty")
    ok = F.col("applicable") & _finite(F.col("gain")) & _finite(F.col("uncertainty")) & (F.col("gain") >= least) & (bound > 0)
    score = bound if by == "lcb" else F.col("gain")
    best = F.max(F.when(ok, F.struct(score.alias("score"), F.col("method"))))
    why = F.when(F.col("b").isNull(), "retain_pchip_no_challenger_passed").otherwise("switch_highest_" + by)
    return gains.groupBy("gap_id").agg(best.alias("b")).select("gap_id", F.coalesce("b.method", F.lit(default)).alias("method"), why.alias("reason"), F.col("b.score").alias("score"))


def groups_of(frame: DataFrame, group: str = "series_id") -> list[str]:
    names = [r[0] for r in frame.select(group).distinct().limit(MAX_GROUPS + 1).collect()]
    if len(names) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return sorted(names)


def fold_floors(scale: DataFrame, groups: list[str], share: float = 0.01, group: str = "series_id") -> DataFrame:
    """For each held-out group, a low percentile of the positive scales of all others. Every row counts for the
    other groups' folds; the percentile's counts are combined before the shuffle."""
    folds = F.filter(F.array(*[F.lit(g) for g in groups]), lambda g: g != F.col(group))
    rest = scale.where("local_iqr > 0").select("local_iqr", F.explode(folds).alias("held_out"))
    return rest.groupBy("held_out").agg(F.percentile("local_iqr", share).alias("floor"), F.count("*").alias("n"))


def scale_floor(training: DataFrame, share: float = 0.01) -> float:
    """A low percentile of the positive scales of training rows; none is an error."""
    out = training.where("local_iqr > 0").agg(F.percentile("local_iqr", share)).first()[0]
    if out is None or not out > 0:
        raise ValueError("training rows have no positive local IQR")
    return float(out)


def recording_floor(samples: DataFrame, share: float = 0.05) -> DataFrame:
    """(series_id, floor): a share of the IQR of the observed values; null unless positive."""
    f = share * (F.percentile("value", 0.75) - F.percentile("value", 0.25))
    return samples.where("valid").groupBy("series_id").agg(f.alias("f")).select("series_id", F.when(F.col("f") > 0, F.col("f")).alias("floor"))
