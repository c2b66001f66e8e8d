"""The engine's queries over the events series; their SQL twins are in twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import kernels
from lacuna.functions.sql import identity_seed, samples_of
from lacuna.operators import evaluate, forest, gaps, impute, metrics, runtime, sampling, selection
from lacuna.sources.files import summarise
from lacuna.sources.series import events_hourly

LENGTHS = (2, 5)
HOUR_MS = 3_600_000
SIMPLE = ["forward_fill", "nearest_boundary", "linear"]
SEASON = kernels.Season("sample_offset", 24, offsets=4, per_direction=2, least=3)
DAYS = kernels.Season("fixed_timedelta", 24 * HOUR_MS, offsets=4, per_direction=3, least=2, how="mean", past_only=True)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in columns})


def _masked(spark, sf, lengths=LENGTHS):
    s = events_hourly(spark, sf)
    return s, gaps.mask(s, gaps.candidates(s, lengths))


def _errors(spark, sf):
    s, m = _masked(spark, sf)
    return metrics.normalised(metrics.errors(impute.simple_methods(m)), metrics.scales(s, m))


def _overlap(spark, sf):
    s = events_hourly(spark, sf)
    return gaps.without_overlap(gaps.candidates(s, (3,)), sampling.non_overlapping(gaps.candidates(s, (12,)), seed=None)).select("series_id", "gap_start", "gap_end")


def _gains(spark, sf):
    """Gain of every method over linear, with a tenth of its own error as uncertainty."""
    e = _errors(spark, sf).groupBy("gap_id").agg(F.collect_list(F.struct("method", "nrmse")).alias("e"))
    base = F.filter("e", lambda x: x["method"] == "linear")[0]["nrmse"]
    e = e.select("gap_id", base.alias("base"), F.explode("e").alias("x")).where("x.method != 'linear'")
    return e.select("gap_id", "x.method", (F.col("base") - F.col("x.nrmse")).alias("gain"), (0.1 * F.col("x.nrmse")).alias("uncertainty"), F.col("x.nrmse").isNotNull().alias("applicable"))


def _floors(spark, sf):
    s, m = _masked(spark, sf)
    local = m.where("side != 'G'").groupBy("gap_id", "series_id").agg(metrics.iqr("value").alias("local_iqr"))
    return selection.fold_floors(local, selection.groups_of(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("series_id"))))


def _raw(spark, sf):
    return metrics.raw_features(_masked(spark, sf)[1], HOUR_MS)


def _regions(spark, sf):
    return gaps.regions(runtime.outliers(events_hourly(spark, sf), "zscore", 2.0), "outlier")


def _decisions(spark, sf):
    """Decisions by the errors of the gap's neighbour to the left as predictions."""
    e = _errors(spark, sf)
    start = F.element_at(F.split("gap_id", "_"), -1).cast("long")
    last = e.select(F.concat(F.regexp_extract("gap_id", "^(.*_)", 1), (start + 1).cast("string")).alias("gap_id"), "method", F.col("nrmse").alias("predicted"))
    return evaluate.decisions(e, last, "linear")


def _metrics18(spark, sf):
    d = _decisions(spark, sf)
    return evaluate.selection_metrics(d.select("selected_method", F.col("selected_nrmse").alias("selected_error"), F.col("baseline_nrmse").alias("default_error"), F.col("oracle_nrmse").alias("oracle_error"), (F.col("baseline_nrmse") - F.col("oracle_nrmse")).alias("best_alternative_gain")), "linear")


def _kernel_errors(spark, sf):
    s, m = _masked(spark, sf)
    return metrics.normalised(metrics.errors(impute.by_kernels(m, kernels.METHODS)), metrics.scales(s, m))


def _pipeline(spark, sf):
    """Series with calendar timestamps through all three stages, linear ranked first."""
    s = events_hourly(spark, sf)
    frame = s.select("series_id", F.timestamp_millis(F.col("t_ms").cast("long")).alias("ts"), F.when(F.col("valid"), F.col("value")).alias("value"))
    config = runtime.Config(domain="weather", series_col="series_id", timestamp_col="ts", outlier_method="zscore", standardization="zscore")
    return runtime.impute(frame, "value", config, runtime.FixedScores({m: float(i) for i, m in enumerate(["linear", "pchip", "template"])}))


def _forest_scores(spark, sf):
    """A small forest learns the errors of four series and predicts those of the fifth."""
    s, m = _masked(spark, sf, (5,))
    x = metrics.features(metrics.raw_features(m, HOUR_MS), 1e-3)
    e = metrics.normalised(metrics.errors(impute.simple_methods(m)), metrics.scales(s, m))
    table = x.join(evaluate.wide(e, SIMPLE).drop("series_id"), "gap_id")
    held = F.col("series_id") == "view"
    targets = [f"{k}_nrmse" for k in SIMPLE]
    a, b = forest.matrix(table.where(~held), list(metrics.FEATURES), targets)
    f = forest.fit(spark, a, b, list(metrics.FEATURES), SIMPLE, forest.Settings(trees=16, leaf=5, features="sqrt"))
    return _round(forest.predict(table.where(held), f, with_spread=True), "predicted", "spread")


def _keys(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").cast("string").alias("participant"), F.col("o_orderkey").cast("string").alias("recording"))


def _exact(df: DataFrame, *whole: str) -> DataFrame:
    """Rounds every double."""
    return _round(df, *[c for c, t in df.dtypes if t == "double" and c not in whole])


QUERIES = {
    "densify_hourly": lambda sp, d: _round(events_hourly(sp, d).select("series_id", "pos", "t_ms", "value", "valid"), "value"),
    "recording_summary": lambda sp, d: _round(summarise(events_hourly(sp, d)), "valid_fraction"),
    "gap_islands": lambda sp, d: gaps.missing_gaps(events_hourly(sp, d)),
    "gap_count": lambda sp, d: gaps.gap_count(events_hourly(sp, d)),
    "gap_audit": lambda sp, d: _exact(gaps.gap_audit(events_hourly(sp, d))),
    "gap_candidates": lambda sp, d: _exact(gaps.candidates(events_hourly(sp, d), (5,)).drop("gap_id", "length")),
    "hourly_candidates": lambda sp, d: _exact(gaps.candidates(events_hourly(sp, d), (1, 3, 8), least=4).drop("gap_id")),
    "duration_samples": lambda sp, d: sp.read.parquet(f"{d}/events.parquet").select("event_id", samples_of(F.col("value"), F.lit(250.0)).alias("samples")),
    "non_overlapping_first": lambda sp, d: sampling.non_overlapping(gaps.candidates(events_hourly(sp, d), (5,)), seed=None).select("series_id", "gap_start", "gap_end"),
    "overlap_antijoin": _overlap,
    "runtime_context": lambda sp, d: _exact(gaps.runtime_context(events_hourly(sp, d))),
    "compact_windows": lambda sp, d: _round(gaps.compact(*(lambda s: (s, gaps.candidates(s, (5,))))(events_hourly(sp, d)), 24, 2).select("gap_id", "pos", "at", "value"), "value"),
    "mask_artificial_gap": lambda sp, d: _round(_masked(sp, d)[1].select("gap_id", "series_id", "pos", "side", "value", "truth", "original_is_valid", "is_artificial_gap"), "value", "truth"),
    "impute_simple": lambda sp, d: _round(impute.simple_methods(_masked(sp, d)[1]).select("gap_id", "pos", "method", "pred"), "pred"),
    "impute_seasonal_median": lambda sp, d: _round(impute.seasonal(*(lambda s: (s, gaps.candidates(s, LENGTHS)))(events_hourly(sp, d)), SEASON), "pred"),
    "impute_seasonal_past_days": lambda sp, d: _round(impute.seasonal(*(lambda s: (s, gaps.candidates(s, LENGTHS)))(events_hourly(sp, d)), DAYS), "pred"),
    "impute_template": lambda sp, d: _round(impute.template(_masked(sp, d)[1]).select("gap_id", "pos", "pred"), "pred"),
    "impute_pchip": lambda sp, d: _round(impute.pchip(_masked(sp, d)[1]).select("gap_id", "pos", "pred"), "pred"),
    "impute_kernels": lambda sp, d: _round(impute.by_kernels(_masked(sp, d)[1], kernels.METHODS).select("gap_id", "pos", "method", "pred", "applicable"), "pred"),
    "gap_features_raw": lambda sp, d: _exact(_raw(sp, d)),
    "gap_features": lambda sp, d: _exact(metrics.features(_raw(sp, d), 1e-3).select("gap_id", *metrics.FEATURES)),
    "leave_gap_out_scale": lambda sp, d: _exact(metrics.scales(*_masked(sp, d))),
    "recording_floor": lambda sp, d: _exact(selection.recording_floor(events_hourly(sp, d))),
    "method_errors": lambda sp, d: _exact(_errors(sp, d).select("gap_id", "method", "rmse", "mae", "nrmse")),
    "benchmark_record": lambda sp, d: _exact(evaluate.wide(_errors(sp, d), SIMPLE).drop("best_method_by_mae", *[f"{m}_failure_reason" for m in SIMPLE])),
    "best_method": lambda sp, d: _round(metrics.best(_errors(sp, d)), "best_error"),
    "general_oracle": lambda sp, d: _exact(evaluate.general_oracle(_errors(sp, d))),
    "general_oracle_macro": lambda sp, d: _exact(evaluate.general_oracle(_errors(sp, d), "series_id")),
    "oracle_vs_fixed_macro": lambda sp, d: _round(evaluate.fixed_and_oracle(_errors(sp, d)), "mean_nrmse"),
    "method_shares_zero_filled": lambda sp, d: _round(evaluate.method_shares(metrics.best(_errors(sp, d)), SIMPLE), "share"),
    "oracle_crosstab": lambda sp, d: _exact(evaluate.oracle_crosstab(metrics.best(_errors(sp, d)), SIMPLE)),
    "rank_candidates": lambda sp, d: selection.rank_candidates(_errors(sp, d)),
    "select_challenger": lambda sp, d: _round(selection.select_challenger(_gains(sp, d), "linear"), "score"),
    "fold_scale_floors": lambda sp, d: _round(_floors(sp, d), "floor"),
    "decisions": lambda sp, d: _exact(_decisions(sp, d)),
    "decision_summary": lambda sp, d: _exact(evaluate.summary(_decisions(sp, d))),
    "selection_metrics": lambda sp, d: _exact(_metrics18(sp, d)),
    "kernel_best_method": lambda sp, d: _round(metrics.best(_kernel_errors(sp, d)), "best_error"),
    "outlier_iqr": lambda sp, d: runtime.outliers(events_hourly(sp, d), "iqr", 1.5).where("outlier").select("series_id", "pos"),
    "outlier_zscore": lambda sp, d: runtime.outliers(events_hourly(sp, d), "zscore", 2.0).where("outlier").select("series_id", "pos"),
    "outlier_regions": _regions,
    "standardize_zscore": lambda sp, d: _round(runtime.standardise(events_hourly(sp, d), "zscore").select("series_id", "pos", "scaled"), "scaled"),
    "standardize_robust": lambda sp, d: _round(runtime.standardise(events_hourly(sp, d), "robust").select("series_id", "pos", "scaled"), "scaled"),
    "standardize_minmax": lambda sp, d: _round(runtime.standardise(events_hourly(sp, d), "minmax").select("series_id", "pos", "scaled"), "scaled"),
    "pipeline_run": lambda sp, d: _round(_pipeline(sp, d).frame, "value"),
    "pipeline_gap_log": lambda sp, d: runtime.log_summary(_pipeline(sp, d).gap_log),
    "sampled_gaps": lambda sp, d: _exact(sampling.sample_gaps(events_hourly(sp, d), 8, HOUR_MS, 12 * HOUR_MS, 1 / 3600, 4, shortfall="log")),
    "forest_predictions": _forest_scores,
    "participant_splits": lambda sp, d: sampling.split_participants(_keys(sp, d)),
    "balanced_recordings": lambda sp, d: sampling.balanced_recordings(_keys(sp, d), 20, 2),
    "identity_seeds": lambda sp, d: sp.read.parquet(f"{d}/orders.parquet").select("o_orderkey", identity_seed(F.lit(42), F.col("o_orderkey"), F.col("o_orderpriority")).alias("seed")),
}
