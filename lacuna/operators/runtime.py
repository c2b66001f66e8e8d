"""The runtime pipeline: outliers out, gaps filled by the selector's ranked methods, values standardised, all told.

Only the fill is sequential, as each filled gap is context for the next: one grouped map per series gives a log row
for every gap, with its predictions. The rest are plans over whole tables.
"""

from __future__ import annotations

import hashlib
import inspect
import time
import uuid
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions import kernels
from lacuna.functions.sql import loosely_valid, number

from . import gaps
from .metrics import FEATURES, iqr

# Durations that selectors were validated for, in ms; units of the duration feature.
VALIDATED = {"eye_tracking": (1.0, 250.0), "weather": (3_600_000.0, 1_584_000_000.0), "traffic": (300_000.0, 86_400_000.0)}
UNIT = {"weather": ("realized_gap_duration_hours", 3_600_000.0), "traffic": ("realized_gap_duration_minutes", 60_000.0)}
SHARE, FLOOR_SHARE, LEAST = 0.8, 0.05, 2


def _bounds(method: str, k: float) -> tuple[Column, Column, Column]:
    """Per series of valid values: low and high bound, and the spread."""
    if method == "iqr":
        lo, hi = F.percentile("value", 0.25), F.percentile("value", 0.75)
        return lo - k * (hi - lo), hi + k * (hi - lo), hi - lo
    if method == "zscore":
        return F.avg("value") - k * F.stddev_pop("value"), F.avg("value") + k * F.stddev_pop("value"), F.stddev_pop("value")
    raise ValueError(method)


def outliers(samples: DataFrame, method: str, k: float) -> DataFrame:
    """Adds ``outlier``: strictly outside the bounds of the series' valid values; never on zero spread, nor with
    method none."""
    if method == "none":
        return samples.withColumn("outlier", F.lit(False))
    lo, hi, w = _bounds(method, k)
    q = samples.where("valid").groupBy("series_id").agg(lo.alias("lo"), hi.alias("hi"), w.alias("w"), F.avg("value").alias("c"))
    bad = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")) if method == "iqr" else F.abs(F.col("value") - F.col("c")) / F.col("w") > k
    return samples.join(q, "series_id", "left").withColumn("outlier", F.coalesce(F.col("valid") & (F.col("w") > 0) & bad, F.lit(False))).select(*samples.columns, "outlier")


def outlier_details(flagged: DataFrame, method: str) -> DataFrame:
    """Per series: flagged samples and regions, and why nothing could be flagged."""
    per = flagged.groupBy("series_id").agg(F.count_if("outlier").alias("n_outliers"), F.count_if("valid").alias("n_valid"), F.min(F.when(F.col("valid"), F.col("value"))).alias("lo"), F.max(F.when(F.col("valid"), F.col("value"))).alias("hi"),
                                           *( [iqr(F.when(F.col("valid"), F.col("value"))).alias("w")] if method == "iqr" else [F.stddev_pop(F.when(F.col("valid"), F.col("value"))).alias("w")]))
    runs = gaps.regions(flagged, "outlier").groupBy("series_id").agg(F.count("*").alias("n_regions"))
    why = F.when(F.lit(method == "none"), "disabled").when(F.col("n_valid") == 0, "no_finite_values").when(F.col("w") == 0, "zero_" + ("iqr" if method == "iqr" else "std"))
    return per.join(runs, "series_id", "left").fillna(0, ["n_regions"]).select("series_id", "n_outliers", "n_regions", why.alias("reason"))


def standardise(samples: DataFrame, method: str | None) -> DataFrame:
    """Adds ``scaled``: (value - centre) / spread of the valid values; unchanged on zero spread, or without a method."""
    if method is None:
        return samples.withColumn("scaled", F.when(F.col("valid"), F.col("value")))
    v = samples.where("valid").groupBy("series_id")
    how = {"zscore": (F.avg("value"), F.stddev_pop("value")), "robust": (F.median("value"), iqr("value")), "minmax": (F.min("value"), F.max("value") - F.min("value"))}
    c, s = how[method]
    q = v.agg(c.alias("c"), s.alias("w"))
    x = F.when(F.col("w") > 0, (F.col("value") - F.col("c")) / F.col("w")).otherwise(F.col("value"))
    return samples.join(q, "series_id", "left").withColumn("scaled", F.when(F.col("valid"), x)).select(*samples.columns, "scaled")


@dataclass(frozen=True)
class Config:
    domain: str = "eye_tracking"
    series_col: str | None = None
    timestamp_col: str | None = None
    timestamp_unit: str = "ms"
    order_col: str | None = None
    rate_hz: float | None = None
    validity_col: str | None = None
    outlier_method: str = "none"
    outlier_threshold: float = 2.5
    standardization: str | None = None
    outside_validated_range: bool = False

    def check(self, frame: DataFrame, value_col: str) -> None:
        for ok, why in (
            (self.domain in VALIDATED, "unknown domain"),
            (self.outlier_threshold > 0, "the outlier threshold must be positive"),
            (self.rate_hz is None or self.rate_hz > 0, "the sampling rate must be positive"),
            (self.outlier_method in ("none", "iqr", "zscore"), "the outlier method is none, iqr or zscore"),
            (self.standardization in (None, "zscore", "robust", "minmax"), "unknown standardization"),
            (self.timestamp_unit in ("s", "ms", "us"), "the timestamp unit is s, ms or us"),
            (self.domain == "eye_tracking" or self.timestamp_col is not None, f"{self.domain} needs timestamps"),
            (self.timestamp_col is not None or self.order_col is not None, "rows need a timestamp or an order column"),
        ):
            if not ok:
                raise ValueError(why)
        missing = {c for c in (value_col, self.series_col, self.timestamp_col, self.order_col, self.validity_col) if c} - set(frame.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")


class FixedScores:
    """A selector that gives every gap the same predicted errors; stands in where no forest is trained."""

    def __init__(self, scores: dict[str, float], features: tuple[str, ...] = FEATURES, floor: float | None = None):
        self.methods, self.features, self.floor = list(scores), list(features), floor
        self._scores = np.array(list(scores.values()))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.tile(self._scores, (len(x), 1))


def check_selector(selector, domain: str) -> None:
    """Ordered features (with the domain's duration unit) and known methods without repeats."""
    want = [UNIT[domain][0] if domain in UNIT and f == "realized_gap_duration_ms" else f for f in FEATURES]
    if list(selector.features) not in (want, list(FEATURES)):
        raise ValueError("the selector's features are not those of the domain in their order")
    known = kernels.portfolio(domain)
    if len(set(selector.methods)) != len(selector.methods) or not set(selector.methods) <= set(known):
        raise ValueError("the selector's methods repeat or are not in the portfolio")


def time_axis(frame: DataFrame, config: Config) -> Column:
    """Milliseconds of each row: of a timestamp, of a number in its unit, or of the position at the rate (250 Hz if
    none is told)."""
    if config.timestamp_col is None:
        return F.col("__pos") * F.lit(1000.0 / (config.rate_hz or 250.0))
    kind = dict(frame.dtypes)[config.timestamp_col]
    c = F.col(config.timestamp_col)
    if kind.startswith(("timestamp", "date")):
        return F.unix_micros(c.cast("timestamp")) / 1000.0
    parsed = F.unix_micros(F.try_to_timestamp(c.cast("string"))) / 1000.0
    return F.coalesce(number(c) * {"s": 1000.0, "ms": 1.0, "us": 0.001}[config.timestamp_unit], *([parsed] if kind == "string" else []))


def window_features(w: kernels.Window, floor: float, duration: float) -> dict[str, float]:
    """The sixteen features of one gap, as metrics.features gives them; raises where a side is too poor."""
    xl, xr = w.ends()
    out, sides = {}, {}
    for name, a, b in (("left", w.left, w.start), ("right", w.end, w.right)):
        at = np.arange(a, b)[w.valid[a:b]]
        if len(at) < 2:
            raise ValueError(f"fewer than two valid samples on the {name} side")
        t, y = w.t[at] / 1000, w.values[at]
        if not (np.diff(t) > 0).all():
            raise ValueError(f"{name} times do not increase")
        u = t - t.mean()
        slope = float((u * (y - y.mean())).sum() / (u * u).sum())
        rss, tss = float(((y - y.mean() - slope * u) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
        speed = np.abs(np.diff(y) / np.diff(t))
        sides[name] = (y, slope, 1.0 if tss == 0 else 1 - rss / tss, float(np.median(speed)), float(np.percentile(speed, 90)), len(at) / (b - a))
    (y0, s0, r0, m0, p0, f0), (y1, s1, r1, m1, p1, f1) = sides["left"], sides["right"]
    y = np.concatenate([y0, y1])
    scale = max(float(np.percentile(y, 75) - np.percentile(y, 25)), floor)
    values = (duration, f0, f1, abs(xr - xl) / scale, (y1.mean() - y0.mean()) / scale, y.std() / scale, np.ptp(y) / scale, s0 / scale, s1 / scale, (s1 - s0) / scale, r0, r1, m0 / scale, m1 / scale, p0 / scale, p1 / scale)
    return out | dict(zip(FEATURES, map(float, values)))


LOG = "series_id string, gap_number long, gap_start long, gap_end long, duration_ms double, status string, reason string, recommended string, used string, ranking array<string>, attempts array<string>, warning string, features map<string,double>, predicted map<string,double>, diagnostics map<string,string>, pred array<double>"


def fill_series(values: np.ndarray, t: np.ndarray, config: Config, selector) -> list[dict]:
    """Fills ``values`` in place, gap by gap; one log entry each."""
    if not (np.isfinite(t).all() and (np.diff(t) > 0).all()):
        raise ValueError("times must be finite and strictly increasing")
    methods = kernels.portfolio(config.domain)
    seen = values[np.isfinite(values)]
    floor = selector.floor
    if floor is None and len(seen):
        floor = FLOOR_SHARE * float(np.percentile(seen, 75) - np.percentile(seen, 25))
    missing = ~np.isfinite(values)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], missing.astype(int), [0]])))
    log = []
    for k, (a, b) in enumerate(zip(edge[::2].tolist(), edge[1::2].tolist()), 1):
        entry = {"gap_number": k, "gap_start": a, "gap_end": b, "status": "skip"}
        log.append(entry)
        c = max(LEAST, b - a)
        lo, hi, valid = a - c, b + c, np.isfinite(values)
        if lo < 0 or hi > len(values):
            entry["reason"] = "insufficient_edge_context"
            continue
        entry["duration_ms"] = float(t[b] - t[a])
        if min(valid[lo:a].mean(), valid[b:hi].mean()) < SHARE:
            entry |= {"reason": "insufficient_valid_context", "diagnostics": {"left_valid": str(int(valid[lo:a].sum())), "right_valid": str(int(valid[b:hi].sum())), "context": str(c)}}
            continue
        low, high = VALIDATED[config.domain]
        outside = not low <= entry["duration_ms"] <= high
        if outside and not config.outside_validated_range:
            entry["reason"] = "outside_validated_gap_duration_range"
            continue
        if floor is None or not floor > 0:
            entry["reason"] = "nonpositive_or_nonfinite_recording_scale"
            continue
        w = kernels.Window(values, valid, a, b, lo, hi, t)
        try:
            found = window_features(w, floor, entry["duration_ms"])
        except (ValueError, kernels.NotApplicable) as why:
            entry["reason"] = f"feature_extraction_failed: {why}"
            continue
        if config.domain in UNIT:
            found[UNIT[config.domain][0]] = entry["duration_ms"] / UNIT[config.domain][1]
        scores = selector.predict(np.array([[found[f] for f in selector.features]]))[0]
        ranked = [selector.methods[i] for i in sorted(range(len(scores)), key=lambda i: (scores[i], i))]
        entry |= {"features": found, "predicted": dict(zip(selector.methods, map(float, scores))), "ranking": ranked, "recommended": ranked[0], "attempts": []}
        if outside:
            entry["warning"] = "imputed_outside_validated_gap_duration_range_by_explicit_configuration"
        for m in ranked:
            w.meta.clear()
            got, why = kernels.run(methods[m], w)
            entry["attempts"].append(f"{m}: {why or 'applied'}")
            if got is not None:
                values[a:b] = got
                entry |= {"used": m, "status": "success" if m == ranked[0] else "fallback", "pred": got.tolist(), "diagnostics": {k: str(v) for k, v in w.meta.items()}}
                break
        else:
            entry["reason"] = "no_candidate_method_applied"
    return log


def fill(samples: DataFrame, config: Config, selector) -> DataFrame:
    """Log of all gaps of (series_id, pos, t_ms, value), each series in one task."""
    shared = samples.sparkSession.sparkContext.broadcast(selector)
    names = [c.split()[0] for c in LOG.split(", ")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        log = fill_series(group["value"].to_numpy(float, copy=True), group["t_ms"].to_numpy(float), config, shared.value)
        return pd.DataFrame([{"series_id": key[0], **e} for e in log], columns=names).astype(object).where(lambda x: x.notna(), None)

    return samples.select("series_id", "pos", "t_ms", "value").groupBy("series_id").applyInPandas(run, LOG)


def file_metadata(path: str) -> dict:
    at = Path(path)
    digest = hashlib.sha256()
    with at.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    s = at.stat()
    return {"path": str(at), "format": at.suffix.lstrip("."), "size": s.st_size, "modified": s.st_mtime, "sha256": digest.hexdigest()}


def activity(name: str, function, began: float, details: dict) -> dict:
    source = hashlib.sha256(inspect.getsource(function).encode()).hexdigest()
    return {"name": name, "implementation": f"{function.__module__}.{function.__qualname__}", "implementation_sha256": source, "seconds": round(time.time() - began, 6), "details": details}


def merged(entry: dict, more: dict, without: tuple[str, ...] = ("coordinate_basis",)) -> dict:
    """An entry with a method's diagnostics; a name that both have is an error."""
    more = {k: v for k, v in more.items() if k not in without}
    if clash := set(entry) & set(more):
        raise ValueError(f"both have {sorted(clash)}")
    return entry | more


@dataclass
class Result:
    frame: DataFrame
    gap_log: DataFrame
    provenance: dict


def impute(frame: DataFrame, value_col: str, config: Config, selector, agents: dict | None = None, outlier_log: dict | None = None, stages: str | None = None) -> Result:
    """Frame in, frame out: the value column without outliers, with its gaps filled, standardised if asked; all other
    columns pass through. Numbers that are not finite, and rows whose validity is not truthy, are gaps. With
    ``outlier_log`` outliers count as removed already. ``stages`` names a folder for the frames between stages."""
    config.check(frame, value_col)
    check_selector(selector, config.domain)
    began = time.time()
    series = F.col(config.series_col).cast("string") if config.series_col else F.lit("series")
    order = config.timestamp_col or config.order_col
    rows = frame.withColumn("__series", series).withColumn("__pos", F.row_number().over(W.partitionBy("__series").orderBy(order)).cast("long") - 1)
    valid = loosely_valid(F.col(config.validity_col), F.col(value_col)) if config.validity_col else number(F.col(value_col)).isNotNull()
    rows = rows.withColumns({"__t": time_axis(frame, config), "__value": F.when(valid, number(F.col(value_col)))})
    samples = rows.select(F.col("__series").alias("series_id"), F.col("__pos").alias("pos"), F.col("__t").alias("t_ms"), F.col("__value").alias("value"), F.col("__value").isNotNull().alias("valid"))
    method = "none" if outlier_log is not None else config.outlier_method
    flagged = outliers(samples, method, config.outlier_threshold)
    clean = flagged.select("series_id", "pos", "t_ms", F.when(~F.col("outlier"), F.col("value")).alias("value"), (F.col("valid") & ~F.col("outlier")).alias("valid"))
    acts = [activity("outlier_detection", outliers, began, outlier_log or {"method": method, "threshold": config.outlier_threshold})]
    began = time.time()
    log = fill(clean, config, selector)
    preds = log.where("pred is not null").select("series_id", "gap_start", F.posexplode("pred").alias("i", "pred")).select("series_id", (F.col("gap_start") + F.col("i")).alias("pos"), "pred")
    filled = clean.join(preds, ["series_id", "pos"], "left").withColumn("value", F.coalesce("value", "pred"))
    filled = filled.select("series_id", "pos", "value", F.col("value").isNotNull().alias("valid"))
    acts.append(activity("missing_value_imputation", fill_series, began, {"portfolio": selector.methods}))
    began = time.time()
    done = standardise(filled, config.standardization).select(F.col("series_id").alias("__series"), F.col("pos").alias("__pos"), F.col("scaled").alias("__new"))
    acts.append(activity("standardisation", standardise, began, {"method": config.standardization}))
    out = rows.join(done, ["__series", "__pos"]).select(*[F.col("__new").alias(c) if c == value_col else F.col(f"`{c}`") for c in frame.columns])
    if stages:
        clean.write.mode("errorifexists").csv(f"{stages}_after_outlier_detection", header=True)
        filled.write.mode("errorifexists").csv(f"{stages}_after_missing_value_imputation", header=True)
    told = {"run": uuid.uuid4().hex, "agents": agents or {}, "configuration": asdict(config), "activities": acts, "value_column": value_col}
    return Result(out, log, told)


def log_summary(log: DataFrame) -> DataFrame:
    """How often each status, reason and method occurs."""
    return log.groupBy("status", "reason", "used").agg(F.count("*").alias("n"))
