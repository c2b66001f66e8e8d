import pytest
from lacuna.functions import kernels
from lacuna.functions.sql import identity_seed, loosely_valid, outcome, samples_of, strictly_valid, years_on
from lacuna.operators import evaluate, gaps, impute, metrics, runtime, selection
from lacuna.sources.series import densify
from pyspark.sql import functions as F


def series(spark, values, valid=None, step=1000.0, name="a"):
    rows = [(name, i, i * step, None if v is None else float(v), v is not None and (valid is None or valid[i])) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, pos long, t_ms double, value double, valid boolean").repartition(3)


def test_islands_and_regions(spark):
    s = series(spark, [None, 1, None, None, 2, None])
    got = gaps.missing_gaps(s).orderBy("gap_start").collect()
    assert [(r.gap_start, r.gap_end, r.n) for r in got] == [(0, 1, 1), (2, 4, 2), (5, 6, 1)]
    assert gaps.missing_gaps(series(spark, [1, 2])).count() == 0 and gaps.gap_count(s).first().n_gaps == 3
    assert [(r.region, r.gap_start) for r in gaps.regions(s.withColumn("f", ~F.col("valid")), "f").orderBy("region").collect()] == [(1, 0), (2, 2), (3, 5)]


def test_densify_fills_and_refuses(spark):
    rows = spark.createDataFrame([("a", 5, 1.0), ("a", 8, 2.0), ("b", 0, None)], "series_id string, slot long, value double")
    got = densify(rows).orderBy("series_id", "slot").collect()
    assert [(r.series_id, r.slot, r.pos, r.value) for r in got] == [("a", 5, 0, 1.0), ("a", 6, 1, None), ("a", 7, 2, None), ("a", 8, 3, 2.0), ("b", 0, 0, None)]
    for bad in ([("a", 5, 1.0), ("a", 5, 1.0)], [("a", None, 1.0)]):
        with pytest.raises(Exception, match="slot"):
            densify(spark.createDataFrame(bad, "series_id string, slot long, value double")).collect()


def one_gap(spark, values, start, length, step=1000.0):
    s = series(spark, values, step=step)
    g = gaps.candidates(s, (length,)).where(F.col("gap_start") == start)
    return s, g, gaps.mask(s, g)


def test_masking_refuses_a_gap_that_is_not_observed(spark):
    s = series(spark, [1, 2, 3, None, 5, 6, 7, 8])
    g = spark.createDataFrame([("g", "a", 2, 5, 0, 8, 3, 1.0, 1.0)], "gap_id string, series_id string, gap_start long, gap_end long, ctx_start long, ctx_end long, length long, left_share double, right_share double")
    assert gaps.mask(s, g).count() == 8
    with pytest.raises(Exception, match="wholly observed"):
        gaps.mask(s, g, check=True).collect()


def test_simple_methods(spark):
    _, _, m = one_gap(spark, range(0, 70, 10), 2, 2)
    got = {}
    for r in impute.simple_methods(m).orderBy("pos").collect():
        got.setdefault(r.method, []).append(r.pred)
    assert got == {"forward_fill": [10, 10], "nearest_boundary": [10, 40], "linear": [20, 30]}


def test_features_on_a_ramp(spark):
    """Known values: a ramp of 2 a second, gap of 2, floor 1."""
    _, _, m = one_gap(spark, range(0, 14, 2), 2, 2)
    r = metrics.features(metrics.raw_features(m, 1000.0), 1.0).first()
    assert r.local_iqr == pytest.approx(7.0) and r.normalized_boundary_jump == pytest.approx(6 / 7) and r.normalized_mean_difference_right_minus_left == pytest.approx(8 / 7)
    assert r.raw_trend_before == pytest.approx(2.0) and r.trend_before_r2 == pytest.approx(1.0) and r.raw_trend_difference == pytest.approx(0.0)
    assert r.raw_median_absolute_velocity_left == pytest.approx(2.0) and r.raw_p90_absolute_velocity_right == pytest.approx(2.0) and r.realized_gap_duration_ms == 2000
    down = metrics.raw_features(one_gap(spark, range(14, 0, -2), 2, 2)[2], 1000.0).first()
    assert down.raw_mean_difference_right_minus_left == pytest.approx(-8.0)  # signed
    metrics.check_features(list(metrics.FEATURES))
    with pytest.raises(ValueError):
        metrics.check_features(["linear_rmse"])
    with pytest.raises(Exception, match="not positive"):
        metrics.features(spark.createDataFrame([(0.0, *[1.0] * 11)], ["local_iqr", *metrics.NUMERATORS.values()]), 0.0).collect()


def test_features_agree_with_the_runtime_ones(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = [None if i in (4, 20) else float(x) for i, x in enumerate(rng.normal(size=30))]
    s, _, m = one_gap(spark, values, 9, 5)
    r = metrics.features(metrics.raw_features(m, 1000.0), 1e-3).first()
    y = np.array([np.nan if v is None else v for v in values])
    w = kernels.Window(y, np.isfinite(y), 9, 14, 4, 19, np.arange(30) * 1000.0)
    for k, v in runtime.window_features(w, 1e-3, 5000.0).items():
        assert r[k] == pytest.approx(v), k


def test_scales_by_rank_agree_with_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.1 else round(float(rng.normal()), 1) for _ in range(80)]  # with ties
    s = series(spark, values)
    g = gaps.candidates(s, (3, 7), share=0.5)
    got = {r.gap_id: r for r in metrics.scales(s, gaps.mask(s, g)).collect()}
    rows = g.collect()
    assert len(rows) > 10 and len(got) == len(rows)
    for r in rows:
        rest = [v for i, v in enumerate(values) if v is not None and not r.gap_start <= i < r.gap_end]
        local = [v for i, v in enumerate(values) if v is not None and r.ctx_start <= i < r.ctx_end and not r.gap_start <= i < r.gap_end]
        assert got[r.gap_id].series_iqr == pytest.approx(np.subtract(*np.percentile(rest, [75, 25])))
        assert got[r.gap_id].local_iqr == pytest.approx(np.subtract(*np.percentile(local, [75, 25])))


def test_errors_and_ties(spark):
    p = spark.createDataFrame([("g", "a", 0, 1.0, "x", 1, 2.0), ("g", "a", 1, 3.0, "x", 1, 5.0), ("g", "a", 0, 1.0, "y", 0, 2.0), ("g", "a", 1, 3.0, "y", 0, 5.0), ("g", "a", 0, 1.0, "z", 2, None)], "gap_id string, series_id string, pos long, truth double, method string, method_ord int, pred double")
    e = metrics.errors(p)
    r = e.where("method = 'x'").first()
    assert r.rmse == pytest.approx(2.5**0.5) and r.mae == 1.5
    b = metrics.best(e, "rmse").first()
    assert b.best_method == "y" and b.n_applicable == 2
    w = evaluate.wide(e.withColumn("nrmse", F.col("rmse")), ["x", "y", "z"]).first()
    assert w.best_method_by_mae == "y" and w.x_applicable and not w.z_applicable and w.z_rmse is None
    ok, bad = evaluate.learnable(spark.createDataFrame([(1.0, 2.0), (1.0, None), (float("nan"), 1.0)], "a double, b double"), ["a", "b"])
    assert ok.count() == 1 and {r.reason for r in bad.collect()} == {"non_finite_feature_or_method_target"} and bad.count() == 2


def test_zero_spread_is_left_alone(spark):
    s = series(spark, [5, 5, 5, None])
    flagged = runtime.outliers(s, "zscore", 1.0)
    assert flagged.where("outlier").count() == 0
    assert runtime.outlier_details(flagged, "zscore").first().reason == "zero_std"
    assert {r.scaled for r in runtime.standardise(s, "minmax").collect()} == {5.0, None}
    assert runtime.outlier_details(runtime.outliers(series(spark, [None, None]), "iqr", 1.0), "iqr").first().reason == "no_finite_values"


def test_pchip_on_a_ramp_at_a_turn_and_at_an_end(spark):
    _, _, m = one_gap(spark, range(0, 70, 10), 2, 2)
    assert [r.pred for r in impute.pchip(m).orderBy("pos").collect()] == pytest.approx([20, 30])
    _, _, m = one_gap(spark, [5, 1, 9, 9, 4, 3, 3], 2, 2)  # both neighbours are turning points: flat ends
    t = [1 / 3, 2 / 3]
    assert [r.pred for r in impute.pchip(m).orderBy("pos").collect()] == pytest.approx([1 + 3 * (3 * x * x - 2 * x**3) for x in t])
    for lone in ([None, 1, 9, 9, 4, 3, 3], [2, 1, 9, 9, 4, None, 1], [None, 1, 9, 9, 4, None, 1]):  # one support point on a side
        s = series(spark, lone)
        g = spark.createDataFrame([("g", "a", 2, 4, 0, 6, 2, 1.0, 1.0)], "gap_id string, series_id string, gap_start long, gap_end long, ctx_start long, ctx_end long, length long, left_share double, right_share double")
        m = gaps.mask(s, g)
        by = {r.pos: r.pred for r in impute.by_kernels(m, {"pchip": kernels.pchip}).collect()}
        assert {r.pos: pytest.approx(r.pred) for r in impute.pchip(m).collect()} == by


def test_challenger_needs_a_sure_gain(spark):
    nan = float("nan")
    rows = [("a", "x", 0.5, 0.1, True), ("a", "y", 0.5, 0.1, True), ("a", "z", 0.9, 0.1, False), ("b", "x", 0.2, 0.3, True), ("c", "x", None, None, True), ("d", "x", nan, 0.1, True), ("d", "y", 0.5, nan, True), ("d", "z", float("inf"), 0.1, True)]
    df = spark.createDataFrame(rows, "gap_id string, method string, gain double, uncertainty double, applicable boolean")
    got = {r.gap_id: (r.method, r.reason) for r in selection.select_challenger(df).collect()}
    stay = ("pchip", "retain_pchip_no_challenger_passed")
    assert got == {"a": ("y", "switch_highest_lcb"), "b": stay, "c": stay, "d": stay}


def test_floor_knows_no_row_of_its_own_group(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 2.0), ("b", 4.0), ("c", -1.0)], "series_id string, local_iqr double")
    assert selection.groups_of(s) == ["a", "b", "c"]
    assert {r.held_out: (r.floor, r.n) for r in selection.fold_floors(s, ["a", "b", "c"], 0.5).collect()} == {"a": (3.0, 2), "b": (1.0, 1), "c": (2.0, 3)}
    assert selection.scale_floor(s, 0.5) == 2.0
    with pytest.raises(ValueError):
        selection.scale_floor(s.where("local_iqr <= 0"))


def test_scalar_rules(spark):
    df = spark.createDataFrame([(5.0, 100.0, True, "1"), (15.0, 100.0, None, "x"), (25.0, 100.0, False, "nan")], "ms double, hz double, flag boolean, v string")
    got = df.select(samples_of(F.col("ms"), F.col("hz")).alias("n"), strictly_valid(F.col("flag"), F.col("ms")).alias("s"), loosely_valid(F.lit(1), F.col("v")).alias("l"), outcome(F.col("ms"), F.lit(15.0)).alias("o")).collect()
    assert [tuple(r) for r in got] == [(1, True, True, "better"), (2, False, False, "equal"), (2, False, False, "worse")]
    ts = F.lit("2024-02-29 12:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(*[years_on(ts, F.lit(1), p).cast("string").alias(p) for p in ("feb28", "mar1", "skip")], years_on(ts, F.lit(4), "skip").cast("string").alias("leap")).first()
    assert tuple(row) == ("2025-02-28 12:00:00", "2025-03-01 12:00:00", None, "2028-02-29 12:00:00")
    a, b = spark.range(1).select(identity_seed(F.lit(1), F.lit("")).alias("a"), identity_seed(F.lit(1), F.lit(None)).alias("b")).first()
    assert a != b and len(a) == 16


def test_seasonal_by_calendar_years(spark):
    """Four days in each of five years; the gap is two days of the third."""
    import datetime as dt

    days = [dt.datetime(y, 1, d, 12, tzinfo=dt.timezone.utc) for y in range(2021, 2026) for d in range(1, 5)]
    s = spark.createDataFrame([("a", i, t.timestamp() * 1000, float(t.year * 10 + t.day), True) for i, t in enumerate(days)], "series_id string, pos long, t_ms double, value double, valid boolean")
    g = spark.createDataFrame([("g", "a", 9, 11, 2)], "gap_id string, series_id string, gap_start long, gap_end long, length long")
    season = kernels.Season("calendar_year", 1, offsets=2, per_direction=2, least=3, how="mean")
    got = {r.pos: (r.pred, r.references) for r in impute.seasonal(s, g, season).collect()}
    assert got == {9: (pytest.approx(20232.0), 4), 10: (pytest.approx(20233.0), 4)}
    import numpy as np

    rows = s.orderBy("pos").toPandas()
    w = kernels.Window(rows.value.to_numpy(), np.ones(20, bool), 9, 11, 0, 20, rows.t_ms.to_numpy())
    assert kernels.seasonal(w, season) == pytest.approx([20232.0, 20233.0])
    for bad in ({"period": 0}, {"least": 9}, {"strategy": "x"}, {"how": "x"}, {"period": 1.5}):
        with pytest.raises(ValueError):
            kernels.Season(**{"strategy": "calendar_year", "period": 1, **bad})


def test_runtime_context_reasons(spark):
    s = series(spark, [None, 1, 2, 3, 4, None, 6, 7, 8, None, None, 9, None, 10, 11])
    got = {r.gap_start: (r.reason, r.left_valid, r.right_valid, r.duration_ms) for r in gaps.runtime_context(s).collect()}
    assert got[0][0] == "insufficient_edge_context" and got[5] == (None, 2, 2, 1000.0) and got[9][0] == "insufficient_valid_context" and got[9][1:] == (2, 1, 2000.0)


def test_compact_keeps_what_methods_reach(spark):
    s = series(spark, range(60))
    g = gaps.candidates(s, (2,)).where("gap_start = 30")
    got = [(r.pos, r["at"]) for r in gaps.compact(s, g, 10, 2).orderBy("pos").collect()]
    assert got == [(p, i) for i, p in enumerate([10, 11, 20, 21, 28, 29, 30, 31, 32, 33, 40, 41, 50, 51])]
    assert gaps.from_manifest(g.drop("gap_end"), 5.0).first().duration_ms == 10.0 and gaps.moved(g, F.lit(100)).first().gap_end == 132


def test_audit_drops_series_without_any_gap(spark):
    a = gaps.gap_audit(series(spark, [1, 0, None, 4] + [1] * 40).unionByName(series(spark, [1] * 44, name="b")))
    assert {r.series_id: round(r.zero_share, 4) for r in a.collect()} == {"a": round(1 / 43, 4), "b": 0.0}
    assert [r.series_id for r in gaps.eligible_series(a).collect()] == ["a"]


def test_oracle_and_decisions(spark):
    e = spark.createDataFrame([("g1", "a", "x", 0, 1.0), ("g1", "a", "y", 1, 1.0), ("g2", "a", "x", 0, 3.0), ("g2", "a", "y", 1, 1.0), ("g3", "b", "x", 0, 1.0), ("g3", "b", "y", 1, 5.0)], "gap_id string, series_id string, method string, method_ord int, nrmse double")
    assert evaluate.general_oracle(e).first().method == "x" and evaluate.general_oracle(e, "series_id").first().method == "x"
    p = e.select("gap_id", "method", F.when(F.col("method") == "x", 0.0).otherwise(1.0).alias("predicted"))
    d = {r.gap_id: r for r in evaluate.decisions(e, p, "y").collect()}
    assert d["g1"].oracle_method == "x" and d["g2"].regret == 2.0 and d["g2"].outcome == "worse" and d["g3"].improvement == 4.0
    s = {r.series_id: r for r in evaluate.summary(evaluate.decisions(e, p, "y")).collect()}
    assert s["a"].improvement_percent == -100 and s["b"].improvement_percent == 80 and s["macro"].improvement_percent == -10 and s["macro"].n == 3
    r = {x.series_id: x for x in evaluate.summary(evaluate.decisions(e, p, "y"), ratio_of_means=True).collect()}["macro"]
    assert r.improvement_percent == pytest.approx(50.0)
    assert {(x.series_id, x.method): x.mean_nrmse for x in evaluate.fixed_and_oracle(e).collect()}[("macro", "oracle")] == 1.0
    shares = evaluate.method_shares(metrics.best(e), ["x", "y", "z"]).collect()
    assert {(x.series_id, x.best_method): x.n for x in shares}[("b", "z")] == 0 and len(shares) == 6
    assert evaluate.coverage(e.select("series_id").distinct(), e.where("series_id = 'a'"), ["series_id"]).where("n = 0").count() == 1
    low = selection.lowest(e.withColumnRenamed("nrmse", "predicted").withColumn("ok", F.col("method") == "y"), applicable="ok")
    assert {x.method for x in low.collect()} == {"y"}
