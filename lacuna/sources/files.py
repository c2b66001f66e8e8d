"""File sources. Formats are schemas and rules over Spark's readers; a file that breaks its rule fails its rows, or is
set aside with a reason where many files are read together."""

from __future__ import annotations

import os
import tomllib
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.sql import finite, number

from .series import densify


def require_columns(frame: DataFrame, columns) -> DataFrame:
    missing = set(columns) - set(frame.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return frame


def require_unique(frame: DataFrame, *keys: str) -> DataFrame:
    if frame.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated {', '.join(keys)}")
    return frame


def _csv(spark: SparkSession, path, **options) -> DataFrame:
    return spark.read.options(header=True, **options).csv(path).withColumn("__file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def _named(frame: DataFrame, pattern: str, groups: list[str]) -> DataFrame:
    """Columns from the file's name, which must match."""
    ok = F.col("__file").rlike(f"^{pattern}$")
    cols = {g: F.when(ok, F.regexp_extract("__file", f"^{pattern}$", i + 1)).otherwise(F.raise_error(F.concat(F.lit("unexpected file name: "), F.col("__file")))) for i, g in enumerate(groups)}
    return frame.withColumns(cols)


def _recording(frame: DataFrame, dataset: str, rate: float, unit: str, t, value, valid, extra: list = ()) -> DataFrame:
    out = frame.select(F.lit(dataset).alias("dataset_id"), "participant_id", "recording_id", "session_id", t.alias("t_ms"), F.lit(rate).alias("sampling_rate_hz"), value.alias("value"), valid.alias("valid"), F.col("__file").alias("source_file"), F.lit(unit).alias("coordinate_unit"), *extra)
    return out.withColumn("series_id", F.concat_ws("/", "dataset_id", "recording_id")).withColumn("pos", F.row_number().over(W.partitionBy("series_id").orderBy("t_ms")).cast("long") - 1)


def gazebase(spark: SparkSession, path) -> DataFrame:
    """S_<participant>_S<session>_TEX.csv with n, x, val: valid where x is there and val is 0; 1000 Hz, degrees."""
    f = require_columns(_csv(spark, path), ["n", "x", "val"])
    f = _named(f, r"S_(\d+)_S(\d+)_TEX\.csv", ["participant_id", "session_id"]).withColumn("recording_id", F.regexp_replace("__file", r"\.csv$", ""))
    x = number(F.col("x"))
    return _recording(f, "gazebase", 1000.0, "degree", number(F.col("n")), x, x.isNotNull() & F.coalesce(number(F.col("val")) == 0, F.lit(False)))


def gazebase_vr(spark: SparkSession, path) -> DataFrame:
    """S_<participant>_S<session>_<order>_TEX.csv with n, x: valid where x is there; 250 Hz, degrees."""
    f = require_columns(_csv(spark, path), ["n", "x"])
    f = _named(f, r"S_(\d+)_S(\d+)_(\d+)_TEX\.csv", ["participant_id", "session_id", "order"]).withColumn("recording_id", F.regexp_replace("__file", r"\.csv$", ""))
    x = number(F.col("x"))
    return _recording(f, "gazebase_vr", 250.0, "degree", number(F.col("n")), x, x.isNotNull())


def zuco_identity(path):
    """(participant, session) of .../raw/ZUCO/<PID>/<PID>_NR<k>_ET.mat; other paths are errors."""
    pattern = r"raw/ZUCO/([A-Z]+)/\1_NR(\d+)_ET\.mat$"
    bad = F.raise_error(F.concat(F.lit("unexpected path: "), path))
    pick = lambda i: F.when(path.rlike(pattern), F.regexp_extract(path, pattern, i)).otherwise(bad)
    return F.struct(pick(1).alias("participant_id"), F.concat(F.lit("NR"), pick(2)).alias("session_id"))


def zuco_rows(rows: DataFrame) -> DataFrame:
    """Validity of decoded samples (time, x, y, area): all finite and area above 0; coordinates of 0 are valid. The
    matrix files themselves need a decoder that is not at hand."""
    ok = finite(F.col("time")).isNotNull() & finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull() & (finite(F.col("area")) > 0)
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def tracked_eye(columns: dict) -> object:
    """left or right, whichever has an observation in all three channels; both or none is an error."""
    usable = {eye: F.max((cols[0].isNotNull()).cast("int")) + F.max(cols[1].isNotNull().cast("int")) + F.max(cols[2].isNotNull().cast("int")) == 3 for eye, cols in columns.items()}
    return F.when(usable["left"] & ~usable["right"], "left").when(usable["right"] & ~usable["left"], "right").otherwise(F.raise_error(F.lit("not exactly one usable eye")))


def stimulus_condition(text, words: set[str], pseudowords: set[str]):
    """word, pseudoword, or number for digits with thousands marks; anything else is an error."""
    t = F.trim(text)
    return F.when(t.isin(sorted(words)), "word").when(t.isin(sorted(pseudowords)), "pseudoword").when(t.rlike(r"^\d[\d'’]*$"), "number").otherwise(F.raise_error(F.concat(F.lit("unknown stimulus: "), text)))


def pedrotti(spark: SparkSession, path, words: set[str], pseudowords: set[str], keep_numbers: bool = False) -> DataFrame:
    """Eye samples with '.' for missing; each trial of a file is a recording. Valid where time, x, y and pupil are
    there and the pupil is above 0; one stimulus a trial. Trials on numbers are left out unless kept."""
    f = _csv(spark, path, nullValue=".")
    f = require_columns(f, ["TRIAL_INDEX", "TIMESTAMP", "STIMULUS", *[f"{e}_{c}" for e in ("LEFT", "RIGHT") for c in ("GAZE_X", "GAZE_Y", "PUPIL_SIZE")]])
    f = f.withColumn("participant_id", F.regexp_replace("__file", r"\.csv$", "")).withColumn("trial", number(F.col("TRIAL_INDEX")).cast("int"))
    n = {e.lower(): [number(F.col(f"{e}_{c}")) for c in ("GAZE_X", "GAZE_Y", "PUPIL_SIZE")] for e in ("LEFT", "RIGHT")}
    one = F.when(F.count_distinct("STIMULUS") == 1, F.min("STIMULUS")).otherwise(F.raise_error(F.lit("not one stimulus a trial")).cast("string"))
    per = f.groupBy("__file", "trial").agg(tracked_eye(n).alias("eye"), one.alias("stimulus_text"))
    f = f.join(per.withColumn("stimulus_condition", stimulus_condition(F.col("stimulus_text"), words, pseudowords)), ["__file", "trial"])
    x, y, size = (F.when(F.col("eye") == "left", a).otherwise(b) for a, b in zip(n["left"], n["right"]))
    t = number(F.col("TIMESTAMP"))
    f = f.withColumn("recording_id", F.format_string("%s_trial_%03d", "participant_id", "trial")).withColumn("session_id", F.col("trial").cast("string"))
    ok = t.isNotNull() & x.isNotNull() & y.isNotNull() & F.coalesce(size > 0, F.lit(False))
    out = _recording(f, "pedrotti", 1000.0, "pixel", t, x, ok, [y.alias("gaze_y"), F.col("eye").alias("tracked_eye"), "stimulus_text", "stimulus_condition"])
    return out if keep_numbers else out.where("stimulus_condition != 'number'")


def prepare_temperatures(spark: SparkSession, folder: str, out: str, start: str, end: str) -> str:
    """Unpacks TU_<station> archives on the driver into ``out``/raw, and writes stations' hours between two dates,
    with -999 as missing, to ``out``/hours. Both ends count."""
    raw = Path(out) / "raw"
    raw.mkdir(parents=True, exist_ok=True)
    for archive in sorted(Path(folder).glob("*.zip")):
        with zipfile.ZipFile(archive) as z:
            for name in z.namelist():
                if Path(name).name.startswith("produkt_tu"):
                    (raw / f"{archive.stem}__{Path(name).name}").write_bytes(z.read(name))
    f = _csv(spark, str(raw), sep=";", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    f = f.toDF(*[c.strip() for c in f.columns])
    ts = F.try_to_timestamp(F.trim("MESS_DATUM"), F.lit("yyyyMMddHH"))
    value = number(F.trim("TT_TU"))
    rows = f.select(F.regexp_extract("__file", r"TU_(\d{5})_", 1).alias("station_id"), ts.alias("MESS_DATUM"), F.when(value != -999, value).alias("TT_TU"))
    rows.where(F.col("MESS_DATUM").between(start, end)).write.mode("errorifexists").csv(f"{out}/hours", sep=";", header=True)
    return f"{out}/hours"


def temperatures(spark: SparkSession, path: str, start: str, end: str, stations: list[str] | None = None) -> DataFrame:
    """Complete hourly grids of the stations; a station that is asked for and not there is an error."""
    f = _csv(spark, path, sep=";").drop("__file").where(F.to_timestamp("MESS_DATUM").between(start, end))
    f = f.withColumn("station_id", F.lpad("station_id", 5, "0"))
    if stations is not None:
        asked = spark.createDataFrame([(s.zfill(5),) for s in stations], "station_id string")
        missing = asked.join(f.select("station_id").distinct(), "station_id", "left_anti").collect()
        if missing:
            raise ValueError(f"missing stations: {sorted(r[0] for r in missing)}")
        f = f.join(F.broadcast(asked), "station_id", "left_semi")
    slot = F.floor(F.unix_micros(F.to_timestamp("MESS_DATUM")) / 3_600_000_000).cast("long")
    grid = densify(f.select(F.col("station_id").alias("series_id"), slot.alias("slot"), number(F.col("TT_TU")).alias("value")))
    return grid.select("series_id", "pos", (F.col("slot") * 3_600_000).cast("double").alias("t_ms"), "value", F.col("value").isNotNull().alias("valid"))


def flow_panel(spark: SparkSession, path: str, districts: list[str] | None = None, years: list[int] | None = None, sensors: list[int] | None = None) -> DataFrame:
    """Long panel (district, year, sensor, step, flow) written by district and year: partitions and columns are pruned."""
    p = spark.read.parquet(path)
    for column, wanted in (("district", districts), ("year", years), ("sensor", sensors)):
        if wanted is not None:
            p = p.where(F.col(column).isin(wanted))
    return p.withColumn("flow", F.col("flow").cast("double"))


def write_flow_panel(panel: DataFrame, path: str, expected: int | None = None) -> None:
    """Files of each district and year; Spark's commit makes the table appear whole. A wrong count is an error."""
    panel.withColumn("flow", F.col("flow").cast("float")).repartition("district", "year").sortWithinPartitions("sensor", "step").write.mode("errorifexists").partitionBy("district", "year").parquet(path)
    if expected is not None and panel.sparkSession.read.parquet(path).count() != expected:
        raise ValueError("the panel does not hold the audited rows")


def learnable_gaps(spark: SparkSession, path: str, features: list[str], methods: list[str], features_too: bool = True) -> DataFrame:
    """A stored gap table: old error names are renamed, gap ids must be unique, and rows stay whose targets (and
    features, if asked) are all finite."""
    f = spark.read.options(header=True).csv(path) if str(path).endswith(".csv") else spark.read.parquet(path)
    f = f.withColumnsRenamed({c: c.replace("_normalized_rmse", "_nrmse") for c in f.columns if c.endswith("_normalized_rmse")})
    targets = [f"{m}_nrmse" for m in methods]
    require_unique(require_columns(f, ["gap_id", *features, *targets]), "gap_id")
    f = f.withColumns({c: number(F.col(c)) for c in (*features, *targets)})
    if "station_id" in f.columns:
        f = f.withColumn("station_id", F.lpad(F.col("station_id").cast("int").cast("string"), 5, "0"))
    return f.dropna(subset=[*targets, *(features if features_too else [])])


def with_manifest(spark: SparkSession, sources: list[tuple[str, object]]) -> tuple[list[DataFrame], DataFrame]:
    """Reads (name, callable -> frame) one by one; one that fails is set aside, and the manifest tells why."""
    frames, told = [], []
    for name, load in sources:
        try:
            frame = load()
            n = frame.count()
            frames.append(frame)
            told.append((name, "loaded", n, None))
        except Exception as why:  # noqa: BLE001 a broken file must not end the others
            told.append((name, "excluded_loader_error", None, str(why).splitlines()[0][:300]))
    return frames, spark.createDataFrame(told, "source string, status string, n_samples long, reason string")


def strict_config(path: str, keys: set[str], section: str | None = None) -> dict:
    """TOML with exactly these keys: missing and unknown ones are errors."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    found = found[section] if section else found
    if set(found) != keys:
        raise ValueError(f"missing keys {sorted(keys - set(found))}, unknown keys {sorted(set(found) - keys)}")
    return found


def local_environment(path: str, override: bool = False) -> dict[str, str]:
    """KEY=VALUE lines; the process's own values win unless overridden."""
    out = {}
    for line in Path(path).read_text().splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            k, v = k.strip(), v.strip().strip("\"'")
            if override or k not in os.environ:
                os.environ[k] = v
            out[k] = os.environ[k]
    return out


def summarise(recordings: DataFrame) -> DataFrame:
    """One row a recording: samples, duration from the first to the last, valid and invalid ones."""
    return recordings.groupBy("series_id").agg(
        F.count("*").alias("n_samples"), (F.max_by("t_ms", "pos") - F.min_by("t_ms", "pos")).alias("duration_ms"), F.count_if("valid").alias("n_valid"), (F.count("*") - F.count_if("valid")).alias("n_invalid"),
        F.avg(F.col("valid").cast("double")).alias("valid_fraction"),
    )
