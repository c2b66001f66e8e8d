"""Scales, errors, context features, best method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def iqr(value) -> Column:
    return F.percentile(value, 0.75) - F.percentile(value, 0.25)


def errors(preds: DataFrame) -> DataFrame:
    """RMSE and MAE per gap and method; null where a method does not apply."""
    d = F.col("truth") - F.col("pred")
    all_ = F.count("pred") == F.count("*")
    return preds.groupBy("gap_id", "series_id", "method", "method_ord").agg(F.when(all_, F.sqrt(F.avg(d * d))).alias("rmse"), F.when(all_, F.avg(F.abs(d))).alias("mae"))


def series_iqr_without(samples: DataFrame, masked: DataFrame) -> DataFrame:
    """IQR of each gap's whole series less the gap. The series' valid samples are ranked once; which ranks are the
    quartiles without the gap's samples follows from the ranks of these, so a gap looks up four values."""
    valid = samples.where("valid")
    w = W.partitionBy("series_id")
    ranked = valid.select("series_id", "pos", "value", (F.row_number().over(w.orderBy("value", "pos")) - 1).alias("rank"), F.count("*").over(w).alias("n"))
    inside = masked.where("side = 'G'").select("gap_id", "series_id", "pos")
    out = inside.join(ranked.select("series_id", "pos", "rank", "n"), ["series_id", "pos"]).groupBy("gap_id", "series_id").agg(F.array_sort(F.collect_list("rank")).alias("r"), (F.max("n") - F.count("*")).alias("m"))
    before = F.transform("r", lambda x, j: x - j)

    def lookups(q: float) -> list[Column]:
        h = F.lit(q) * (F.col("m") - 1)
        low = F.floor(h).cast("int")
        high = F.least(low + 1, F.col("m").cast("int") - 1)
        full = lambda k: (k + F.size(F.filter(before, lambda x: x <= k))).cast("int")
        sign = 1.0 if q > 0.5 else -1.0
        return [F.struct(full(low).alias("rank"), (sign * (1 - (h - low))).alias("weight")), F.struct(full(high).alias("rank"), (sign * (h - low)).alias("weight"))]

    want = out.where("m > 0").select("gap_id", "series_id", F.explode(F.array(*lookups(0.25), *lookups(0.75))).alias("x")).select("gap_id", "series_id", "x.rank", "x.weight")
    found = want.join(ranked.select("series_id", "rank", "value"), ["series_id", "rank"])
    return found.groupBy("gap_id").agg(F.sum(F.col("weight") * F.col("value")).alias("series_iqr"))


def scales(samples: DataFrame, masked: DataFrame, share: float = 0.05) -> DataFrame:
    """Per gap: IQR of the context, of the series without the gap, and their guarded maximum."""
    local = masked.where("side != 'G'").groupBy("gap_id").agg(iqr("value").alias("local_iqr"))
    both = F.col("local_iqr").isNotNull() & F.col("series_iqr").isNotNull()
    return local.join(series_iqr_without(samples, masked), "gap_id").withColumn("scale", F.when(both, F.greatest("local_iqr", share * F.col("series_iqr"))))


def normalised(errs: DataFrame, scale: DataFrame) -> DataFrame:
    return errs.join(scale, "gap_id").withColumn("nrmse", F.when(F.col("scale") > 0, F.col("rmse") / F.col("scale")))


def best(errs: DataFrame, error: str = "nrmse") -> DataFrame:
    """Lowest error per gap, first method of the portfolio on ties, and how many apply."""
    key = F.when(F.col(error).isNotNull(), F.struct(F.col(error), F.col("method_ord"), F.col("method")))
    return errs.groupBy("gap_id", "series_id").agg(F.min(key).alias("b"), F.count(error).alias("n_applicable")).select("gap_id", "series_id", F.col("b.method").alias("best_method"), F.col(f"b.{error}").alias("best_error"), "n_applicable")


# The selector's features in their order, and what of them is divided by the scale, with the names
# of the numerators.
FEATURES = (
    "realized_gap_duration_ms", "left_context_valid_fraction", "right_context_valid_fraction", "normalized_boundary_jump", "normalized_mean_difference_right_minus_left",
    "local_std_over_scale", "local_range_over_scale", "normalized_trend_before", "normalized_trend_after", "normalized_trend_difference", "trend_before_r2", "trend_after_r2",
    "normalized_median_absolute_velocity_left", "normalized_median_absolute_velocity_right", "normalized_p90_absolute_velocity_left", "normalized_p90_absolute_velocity_right",
)
NUMERATORS = {
    "normalized_boundary_jump": "raw_absolute_boundary_difference",
    "normalized_mean_difference_right_minus_left": "raw_mean_difference_right_minus_left",
    "local_std_over_scale": "raw_local_std",
    "local_range_over_scale": "raw_local_range",
    "normalized_trend_before": "raw_trend_before",
    "normalized_trend_after": "raw_trend_after",
    "normalized_trend_difference": "raw_trend_difference",
    "normalized_median_absolute_velocity_left": "raw_median_absolute_velocity_left",
    "normalized_median_absolute_velocity_right": "raw_median_absolute_velocity_right",
    "normalized_p90_absolute_velocity_left": "raw_p90_absolute_velocity_left",
    "normalized_p90_absolute_velocity_right": "raw_p90_absolute_velocity_right",
}


def raw_features(masked: DataFrame, step_ms: float) -> DataFrame:
    """Per gap: durations, shares, local IQR, R² and the eleven numerators. Trends are per second by least squares,
    velocities between consecutive valid samples. Gaps with fewer than two valid samples on a side, or without a
    valid neighbour, are left out."""
    seen = masked.where("value is not null")
    w = W.partitionBy("gap_id", "side").orderBy("pos")
    seconds = F.col("t_ms") / 1000
    seen = seen.withColumn("speed", F.abs((F.col("value") - F.lag("value").over(w)) / (seconds - F.lag(seconds).over(w))))
    at = lambda s, x: F.when(F.col("side") == s, x)
    a = seen.groupBy("gap_id", "series_id", "length", "left_share", "right_share").agg(
        iqr("value").alias("local_iqr"), F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("range"),
        *[f.alias(f"{k}{s}") for s in "LR" for k, f in {
            "n": F.count(at(s, F.col("value"))), "mean": F.avg(at(s, F.col("value"))), "slope": F.regr_slope(at(s, F.col("value")), at(s, seconds)),
            "r2": F.regr_r2(at(s, F.col("value")), at(s, seconds)), "half": F.median(at(s, F.col("speed"))), "most": F.percentile(at(s, F.col("speed")), 0.9),
        }.items()],
        F.max(F.when(F.col("pos") == F.col("gap_start") - 1, F.col("value"))).alias("xl"), F.max(F.when(F.col("pos") == F.col("gap_end"), F.col("value"))).alias("xr"),
    ).where("nL > 1 and nR > 1 and xl is not null and xr is not null")
    return a.select(
        "gap_id", "series_id", "local_iqr", (F.col("length") * F.lit(float(step_ms))).alias("realized_gap_duration_ms"),
        F.col("left_share").alias("left_context_valid_fraction"), F.col("right_share").alias("right_context_valid_fraction"),
        F.col("r2L").alias("trend_before_r2"), F.col("r2R").alias("trend_after_r2"),
        F.abs(F.col("xr") - F.col("xl")).alias("raw_absolute_boundary_difference"), (F.col("meanR") - F.col("meanL")).alias("raw_mean_difference_right_minus_left"),
        F.col("sd").alias("raw_local_std"), F.col("range").alias("raw_local_range"), F.col("slopeL").alias("raw_trend_before"), F.col("slopeR").alias("raw_trend_after"),
        (F.col("slopeR") - F.col("slopeL")).alias("raw_trend_difference"), F.col("halfL").alias("raw_median_absolute_velocity_left"), F.col("halfR").alias("raw_median_absolute_velocity_right"),
        F.col("mostL").alias("raw_p90_absolute_velocity_left"), F.col("mostR").alias("raw_p90_absolute_velocity_right"),
    )


def features(raw: DataFrame, floor) -> DataFrame:
    """Adds the features that depend on the scale: numerators by max(local IQR, floor). Raws are extracted once, so
    every fold only divides anew. A scale that is not positive is an error."""
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    scale = F.greatest("local_iqr", floor)
    scale = F.when(scale > 0, scale).otherwise(F.raise_error(F.lit("the feature scale is not positive")).cast("double"))
    return raw.withColumns({name: F.col(n) / scale for name, n in NUMERATORS.items()})


def check_features(columns: list[str]) -> None:
    """The selector may see its features and nothing that knows the truth."""
    if tuple(columns) != FEATURES:
        raise ValueError("not the selector's features in their order")
    known = [c for c in columns if any(x in c for x in ("rmse", "mae", "best_", "ground_truth"))]
    if known:
        raise ValueError(f"features that know the truth: {known}")
