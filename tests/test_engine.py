"""Kernels, samplers, forests, the runtime pipeline, file sources and sinks."""

import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from lacuna.functions import kernels
from lacuna.operators import forest, gaps, runtime, sampling
from lacuna.sources import files, sinks
from pyspark.sql import functions as F

from test_series import series


def window(y, start, end, left=0, right=None, t=None):
    y = np.array([np.nan if v is None else v for v in y], float)
    return kernels.Window(y, np.isfinite(y), start, end, left, len(y) if right is None else right, t)


def test_spline_against_a_dense_solve():
    rng = np.random.default_rng(1)
    for n in (4, 5, 9):
        x = np.sort(rng.uniform(0, 10, n + 2))
        y = rng.normal(size=n + 2)
        k = n // 2
        w = window(y, k, k + 2, t=x * 1000)
        got = kernels.natural_spline(w)
        keep = [i for i in range(n + 2) if not k <= i < k + 2]
        a, b = x[keep] * 1000, y[keep]
        m = len(a)
        # unknowns: a cubic on each interval; values, slopes and curvatures meet, and the ends do not bend
        rows, rhs = [], []
        for i in range(m - 1):
            for p in (a[i], a[i + 1]):
                r = np.zeros(4 * (m - 1))
                r[4 * i : 4 * i + 4] = [((p - a[i]) / 1000) ** j for j in range(4)]
                rows.append(r), rhs.append(b[i if p == a[i] else i + 1])
        for i in range(m - 2):
            h = (a[i + 1] - a[i]) / 1000
            for d in (1, 2):
                r = np.zeros(4 * (m - 1))
                r[4 * i : 4 * i + 4] = [0, 1, 2 * h, 3 * h * h] if d == 1 else [0, 0, 2, 6 * h]
                r[4 * i + 4 + d] = -d
                rows.append(r), rhs.append(0)
        r0, r1 = np.zeros(4 * (m - 1)), np.zeros(4 * (m - 1))
        r0[2], h = 2, (a[-1] - a[-2]) / 1000
        r1[-2:] = [2, 6 * h]
        c = np.linalg.solve(np.array([*rows, r0, r1]), np.array([*rhs, 0, 0]))
        for at, v in zip(x[k : k + 2] * 1000, got):
            i = np.searchsorted(a, at) - 1
            assert v == pytest.approx(sum(c[4 * i + j] * ((at - a[i]) / 1000) ** j for j in range(4)))


def test_polyfit_takes_the_lowest_degree_that_fits():
    for degree, f in ((1, lambda t: 3 * t - 1), (2, lambda t: t * t), (3, lambda t: t**3 - t)):
        t = np.arange(14.0)
        w = window(f(t), 5, 8, t=t)
        assert kernels.polyfit_bic(w) == pytest.approx(f(t[5:8]), abs=1e-6) and w.meta["selected_degree"] == degree


def test_template_and_reasons():
    y = [0, 1, 4, 2, 0, 0, 0, 8, 2, 6, 4]
    got = kernels.template(window(y, 4, 7, 1, 10))
    line, mean = 2 + 6 * np.arange(1, 4) / 4, np.mean([[1, 4, 2], [8, 2, 6]], axis=0)
    assert got == pytest.approx(line + np.array([0, 1, 0]) * (mean - np.linspace(mean[0], mean[-1], 3)))
    assert kernels.run(kernels.template, window([1, None, 3, 0, 0, 6, None, 8], 3, 5, 1, 7)) == (None, "no whole segment in the context")
    assert kernels.run(kernels.linear, window([1, None, 0, 4], 2, 3))[1] == "a neighbour of the gap is not valid"
    assert kernels.run(lambda w: 1 / 0, window([1, 2, 3], 1, 2))[1].startswith("ZeroDivisionError")
    assert kernels.run(lambda w: [1, 2], window([1, 2, 3], 1, 2))[1] == "prediction_length_or_shape_mismatch"
    assert kernels.run(lambda w: [np.nan], window([1, 2, 3], 1, 2))[1] == "non_finite_predictions"
    bad = window([1, 2, 3, 4, 5], 2, 3, t=np.array([0, 1, 2, 2, 3.0]))
    assert kernels.run(kernels.pchip, bad)[1] and kernels.run(kernels.nearest_boundary, bad)[0] == [2.0]
    assert list(kernels.portfolio("traffic"))[-1] == "seasonal_periodic" and len(kernels.portfolio()) == 7


def test_samplers_do_not_overlap_and_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    s = series(spark, [None if rng.random() < 0.02 else 1.0 for _ in range(600)])
    kw = {"n": 7, "low_ms": 1000, "high_ms": 9000, "rate_hz": 1.0, "n_strata": 3}
    for more in ({}, {"order": "given", "shortfall": "log"}, {"avoid_first": False, "attempts": 500}, {"n_strata": 1}):
        a = sampling.sample_gaps(s, **{**kw, **more}).orderBy("gap_start").collect()
        assert a == sampling.sample_gaps(s.repartition(1), **{**kw, **more}).orderBy("gap_start").collect()
        assert len(a) == 7 and all(r.status == "accepted" for r in a)
        ends = [(r.ctx_start, r.ctx_end) for r in a]
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))
        assert max(pd.Series([r.stratum for r in a]).value_counts()) - 7 // {**kw, **more}["n_strata"] <= 1
        fit = {(r.gap_start, r.length) for r in gaps.candidates(s, tuple(range(1, 10))).collect()}
        assert all((r.gap_start, r.length) in fit for r in a)
    short = series(spark, [1.0] * 12)
    with pytest.raises(Exception, match="gaps found"):
        sampling.sample_gaps(short, **kw).collect()
    assert sampling.sample_gaps(short, **kw, shortfall="log").where("status = 'skipped'").count() > 0
    found = gaps.candidates(s, (4,))
    got = sampling.non_overlapping(found, 10).orderBy("ctx_start").collect()
    assert len(got) == 10 and all(x.ctx_end <= y.ctx_start for x, y in zip(got, got[1:]))
    with pytest.raises(Exception, match="gaps found"):
        sampling.non_overlapping(found, 10_000).collect()
    years = s.withColumn("year", F.when(F.col("pos") < 300, 2020).otherwise(2021))
    assert sampling.sample_gaps(years, **kw, within="year").count() == 14


def test_splits_and_choices(spark):
    rec = spark.createDataFrame([("d", f"p{i}", f"r{j}") for i in range(20) for j in range(1 + i % 3)], "dataset string, participant string, recording string")
    s = sampling.split_participants(rec)
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 14, "validation": 3, "test": 3}
    assert sampling.assign_recordings(rec, s).count() == rec.count()
    with pytest.raises(Exception, match="no split"):
        sampling.assign_recordings(rec, s.where("split != 'test'")).collect()
    assert sampling.split_counts(3) == [1, 1, 1] and sampling.split_counts(11) == [8, 2, 1]
    b = sampling.balanced_recordings(rec, 5, 2)
    assert b.count() == 10 and b.select("participant").distinct().count() == 5
    ids = spark.createDataFrame([("a", "x", None), ("a", "x", None), ("b", "x", "1"), ("b", "y", "1")], "series_id string, p string, q string")
    assert {tuple(r) for r in sampling.identity(ids, ["p", "q", "z"]).collect()} == {("a", "x", "<null>", "<missing>"), ("b", "<multiple>", "1", "<missing>")}
    assert sampling.exactly_one(ids.where("series_id = 'a'"), ["series_id"], "p").first().p == "x"
    with pytest.raises(Exception, match="not one value"):
        sampling.exactly_one(ids, ["series_id"], "p").collect()


def test_forest_learns_and_nests(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3))
    y = np.stack([np.where(x[:, 0] > 0, 1.0, 3.0), np.full(240, 2.0)], axis=1) + rng.normal(scale=0.05, size=(240, 2))
    for s in (forest.Settings(trees=8, leaf=3), forest.Settings(trees=8, leaf=3, bootstrap=False, extra=True)):
        f = forest.fit(spark, x[:200], y[:200], ["a", "b", "c"], ["m", "n"], s)
        assert (f.predict(x[200:]).argmin(axis=1) == (x[200:, 0] <= 0)).mean() > 0.9
    again = forest.fit(spark, x[:200], y[:200], ["a", "b", "c"], ["m", "n"], s)
    assert np.array_equal(again.predict(x), f.predict(x))
    df = spark.createDataFrame(pd.DataFrame({"gap_id": [f"g{i}" for i in range(40)], "a": x[200:, 0], "b": x[200:, 1], "c": [None, *x[201:, 2]]}))
    got = forest.predict(df, f, True).orderBy("gap_id", "method_ord").collect()
    assert len(got) == 80 and got[0].predicted == pytest.approx(f.predict(np.array([[x[200, 0], x[200, 1], np.nan]]))[0, 0]) and got[0].spread >= 0
    assert f.frame(spark).count() == 8
    table = pd.DataFrame({"gap_id": [f"g{i}" for i in range(240)], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "m": y[:, 0], "n": y[:, 1], "grp": [f"s{i % 3}" for i in range(240)]})
    grid = [forest.Settings(trees=2, depth=0), forest.Settings(trees=4, leaf=3)]
    out, tuned = forest.nested(spark, table, ["a", "b", "c"], ["m", "n"], "grp", grid)
    assert len(out) == 240 and set(out["candidate"]) == {1} and len(tuned) == 6 and forest.final_settings(tuned, grid) == grid[1]


def ramp(spark, n=60, missing=(20, 21, 40), **more):
    rows = [(i, None if i in missing else float(i), f"n{i}") for i in range(n)]
    return spark.createDataFrame(rows, "i long, x double, note string").repartition(3)


def test_pipeline_fills_in_order_and_tells(spark):
    frame = ramp(spark, missing=(1, 20, 21, 40, 42, 43))
    config = runtime.Config(rate_hz=1000.0, order_col="i")
    r = runtime.impute(frame, "x", config, runtime.FixedScores({"pchip": 0.2, "linear": 0.1}))
    got = {x.i: x for x in r.frame.collect()}
    assert r.frame.columns == frame.columns and got[20].x == pytest.approx(20) and got[21].x == pytest.approx(21) and got[5].note == "n5"
    log = {x.gap_start: x for x in r.gap_log.collect()}
    assert log[1].reason == "insufficient_edge_context" and got[1].x is None
    assert log[20].status == "success" and log[20].used == "linear" and log[20].ranking == ["linear", "pchip"] and log[20].features["realized_gap_duration_ms"] == 2.0
    # the gap at 40 has an empty place in its right context (42); that at 42 sees 40 only if it was filled
    assert log[40].reason == "insufficient_valid_context" and log[42].reason == "insufficient_valid_context" and log[42].diagnostics["left_valid"] == "1"
    assert [a["name"] for a in r.provenance["activities"]] == ["outlier_detection", "missing_value_imputation", "standardisation"] and json.dumps(r.provenance)


def test_pipeline_fallback_range_and_scale(spark):
    scores = runtime.FixedScores({"template": 0.1, "linear": 0.2})
    frame = ramp(spark, 40, (18, 19, 20, 15))  # no whole segment of three on the left of 18
    c = runtime.Config(rate_hz=1000.0, order_col="i")
    log = {r.gap_start: r for r in runtime.impute(frame, "x", c, scores).gap_log.collect()}
    assert log[15].status == "success" and log[18].status == "success"
    slow = runtime.Config(rate_hz=1.0, order_col="i")
    assert {r.gap_start: r.reason for r in runtime.impute(frame, "x", slow, scores).gap_log.collect()} == {15: "outside_validated_gap_duration_range", 18: "insufficient_valid_context"}
    forced = runtime.impute(frame, "x", runtime.Config(rate_hz=1.0, order_col="i", outside_validated_range=True), scores).gap_log.collect()
    assert all(r.warning and r.status == "success" for r in forced)
    flat = spark.createDataFrame([(i, None if i == 10 else 1.0) for i in range(20)], "i long, x double")
    assert runtime.impute(flat, "x", c, scores).gap_log.first().reason == "nonpositive_or_nonfinite_recording_scale"
    hourly = spark.createDataFrame([(i * 300_000.0, None if i in (50, 51) else float(i % 7)) for i in range(100)], "t double, x double")
    got = runtime.impute(hourly, "x", runtime.Config("traffic", timestamp_col="t"), runtime.FixedScores({"seasonal_periodic": 0.1, "linear": 0.2})).gap_log.first()
    assert got.status == "fallback" and got.used == "linear" and got.attempts[0].startswith("seasonal_periodic: too few") and got.features["realized_gap_duration_minutes"] == 10.0


def test_pipeline_outliers_standardisation_and_checks(spark):
    frame = spark.createDataFrame([(i, 1000.0 if i == 30 else float(i % 5), i != 7) for i in range(60)], "i long, x double, ok boolean")
    c = runtime.Config(rate_hz=1000.0, order_col="i", validity_col="ok", outlier_method="zscore", outlier_threshold=3.0, standardization="minmax")
    r = runtime.impute(frame, "x", c, runtime.FixedScores({"linear": 0.0}))
    got = {x.i: x.x for x in r.frame.collect()}
    assert {x.gap_start for x in r.gap_log.collect()} == {7, 30} and got[30] == pytest.approx(0.625) and max(got.values()) == 1.0
    skipped = runtime.impute(frame, "x", c, runtime.FixedScores({"linear": 0.0}), outlier_log={"by": "hand"})
    assert {x.gap_start for x in skipped.gap_log.collect()} == {7}
    for bad in ({"domain": "x"}, {"outlier_method": "x"}, {"order_col": None}, {"order_col": "zz"}, {"domain": "weather"}, {"outlier_threshold": 0}):
        with pytest.raises(ValueError):
            runtime.impute(frame, "x", runtime.Config(**{"order_col": "i", **bad}), runtime.FixedScores({"linear": 0.0}))
    with pytest.raises(ValueError):
        runtime.check_selector(runtime.FixedScores({"seasonal_periodic": 1.0}), "eye_tracking")
    with pytest.raises(ValueError):
        runtime.merged({"a": 1}, {"a": 2})
    assert runtime.merged({"a": 1}, {"coordinate_basis": 2, "b": 3}) == {"a": 1, "b": 3}


def test_loaders(spark, tmp_path):
    (tmp_path / "S_1001_S1_TEX.csv").write_text("n,x,val\n0,1.5,0\n1,,0\n2,2.5,1\n3,3.5,0\n")
    g = files.gazebase(spark, str(tmp_path / "S_1001_S1_TEX.csv")).orderBy("pos").collect()
    assert [r.valid for r in g] == [True, False, False, True] and g[0].participant_id == "1001" and g[0].session_id == "1" and g[0].sampling_rate_hz == 1000
    (tmp_path / "S_1001_S1_4_TEX.csv").write_text("n,x\n0,1\n4,\n")
    assert [r.valid for r in files.gazebase_vr(spark, str(tmp_path / "S_1001_S1_4_TEX.csv")).orderBy("pos").collect()] == [True, False]
    (tmp_path / "other.csv").write_text("n,x,val\n0,1,0\n")
    with pytest.raises(Exception, match="unexpected file name"):
        files.gazebase(spark, str(tmp_path / "other.csv")).collect()
    frames, told = files.with_manifest(spark, [("good", lambda: files.gazebase_vr(spark, str(tmp_path / "S_1001_S1_4_TEX.csv"))), ("bad", lambda: files.gazebase(spark, str(tmp_path / "missing.csv")))])
    assert len(frames) == 1 and {r.source: r.status for r in told.collect()} == {"good": "loaded", "bad": "excluded_loader_error"}
    s = files.summarise(files.gazebase(spark, str(tmp_path / "S_1001_S1_TEX.csv"))).first()
    assert (s.n_samples, s.duration_ms, s.n_valid, s.n_invalid) == (4, 3.0, 2, 2)


def test_trials_of_one_eye(spark, tmp_path):
    head = "TRIAL_INDEX,TIMESTAMP,STIMULUS,LEFT_GAZE_X,LEFT_GAZE_Y,LEFT_PUPIL_SIZE,RIGHT_GAZE_X,RIGHT_GAZE_Y,RIGHT_PUPIL_SIZE\n"
    (tmp_path / "01.csv").write_text(head + "1,0,haus,1,2,3,.,.,.\n1,1,haus,4,5,0,.,.,.\n2,0,1'000,.,.,.,1,2,3\n3,0,blorf,.,.,.,7,8,9\n")
    args = (spark, str(tmp_path / "01.csv"), {"haus"}, {"blorf"})
    got = {(r.recording_id, r.pos): r for r in files.pedrotti(*args, keep_numbers=True).collect()}
    assert {k: (r.valid, r.tracked_eye, r.stimulus_condition) for k, r in got.items()} == {("01_trial_001", 0): (True, "left", "word"), ("01_trial_001", 1): (False, "left", "word"), ("01_trial_002", 0): (True, "right", "number"), ("01_trial_003", 0): (True, "right", "pseudoword")}
    assert files.pedrotti(*args).count() == 3
    z = spark.createDataFrame([(1.0, 0.0, 0.0, 5.0), (2.0, None, 1.0, 5.0), (3.0, 1.0, 1.0, 0.0)], "time double, x double, y double, area double")
    assert [r.valid for r in files.zuco_rows(z).orderBy("time").collect()] == [True, False, False]
    p = spark.createDataFrame([("/a/raw/ZUCO/YAC/YAC_NR1_ET.mat",), ("/a/raw/ZUCO/YAC/ZZZ_NR1_ET.mat",)], "p string")
    assert tuple(p.where("p like '%YAC_NR%'").select(files.zuco_identity(F.col("p")).alias("z")).first().z) == ("YAC", "NR1")
    with pytest.raises(Exception, match="unexpected path"):
        p.select(files.zuco_identity(F.col("p"))).collect()


def test_temperatures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "stundenwerte_TU_00232_x.zip", "w") as z:
        z.writestr("produkt_tu_stunde_x_00232.txt", "STATIONS_ID;MESS_DATUM; TT_TU;eor\n  232;2000010100;  1.5;eor\n  232;2000010103;-999;eor\n  232;2000010105;  2.5;eor\n  232;1999010105;  2.5;eor\n")
    out = files.prepare_temperatures(spark, str(tmp_path / "in"), str(tmp_path / "out"), "2000-01-01", "2000-12-31")
    got = files.temperatures(spark, out, "2000-01-01", "2000-12-31", ["232"]).orderBy("pos").collect()
    assert [(r.series_id, r.value) for r in got] == [("00232", v) for v in (1.5, None, None, None, None, 2.5)] and got[1].t_ms - got[0].t_ms == 3_600_000
    with pytest.raises(ValueError, match="missing stations"):
        files.temperatures(spark, out, "2000-01-01", "2000-12-31", ["1"])


def test_tables_contract_and_config(spark, tmp_path):
    p = spark.createDataFrame([("D4", 2017, 1, i, float(i)) for i in range(3)], "district string, year int, sensor int, step int, flow double")
    files.write_flow_panel(p, str(tmp_path / "panel"), 3)
    assert files.flow_panel(spark, str(tmp_path / "panel"), ["D4"], [2017], [1]).count() == 3 and files.flow_panel(spark, str(tmp_path / "panel"), ["D5"]).count() == 0
    t = spark.createDataFrame([("g1", 1.0, 0.5), ("g2", None, 0.5), ("g3", 1.0, None)], "gap_id string, f double, linear_normalized_rmse double")
    sinks.write_frame(t, str(tmp_path / "gaps"))
    assert files.learnable_gaps(spark, str(tmp_path / "gaps"), ["f"], ["linear"]).count() == 1 and files.learnable_gaps(spark, str(tmp_path / "gaps"), ["f"], ["linear"], False).count() == 2
    with pytest.raises(Exception, match="exist"):
        sinks.write_frame(t, str(tmp_path / "gaps"))
    sinks.write_set({"a": t}, str(tmp_path / "set"), ("a",), {"n": 3})
    sinks.check_contract(str(tmp_path / "set"), ("a",))
    with pytest.raises(FileExistsError):
        sinks.write_set({"a": t}, str(tmp_path / "set"), ("a",), {})
    with pytest.raises(FileNotFoundError):
        sinks.check_contract(str(tmp_path / "set"), ("a", "b"))
    (tmp_path / "c.toml").write_text("[benchmark]\na = 1\n")
    assert files.strict_config(str(tmp_path / "c.toml"), {"a"}, "benchmark") == {"a": 1}
    with pytest.raises(ValueError, match="missing keys"):
        files.strict_config(str(tmp_path / "c.toml"), {"a", "b"}, "benchmark")
    (tmp_path / ".env").write_text("# x\nLACUNA_TEST_X='1'\n")
    assert files.local_environment(str(tmp_path / ".env")) == {"LACUNA_TEST_X": "1"}
    assert runtime.file_metadata(str(tmp_path / "c.toml"))["format"] == "toml"
    with pytest.raises(ValueError, match="repeated"):
        files.require_unique(t.unionByName(t), "gap_id")
