"""Reconstruction methods: plans where Spark can express them, kernels on grouped arrays elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions import kernels
from lacuna.functions.sql import years_on


def boundaries(masked: DataFrame) -> DataFrame:
    """Gap samples with the values and times at both neighbours: one window over each gap's own samples."""
    w = W.partitionBy("gap_id")
    at = lambda p, c: F.max(F.when(F.col("pos") == p, F.col(c))).over(w)
    a, b = F.col("gap_start") - 1, F.col("gap_end")
    return masked.withColumns({"xl": at(a, "value"), "xr": at(b, "value"), "tl": at(a, "t_ms"), "tr": at(b, "t_ms")}).where("side = 'G'")


def simple_methods(masked: DataFrame) -> DataFrame:
    """(gap_id, pos, truth, method, method_ord, pred) for forward fill, nearest boundary (by time; the left one on
    ties) and linear (by position)."""
    b = boundaries(masked)
    preds = {
        "forward_fill": F.col("xl"),
        "nearest_boundary": F.when(F.col("t_ms") - F.col("tl") <= F.col("tr") - F.col("t_ms"), F.col("xl")).otherwise(F.col("xr")),
        "linear": F.col("xl") + (F.col("xr") - F.col("xl")) * (F.col("pos") - F.col("gap_start") + 1) / (F.col("length") + 1),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("method"), F.lit(i).cast("long").alias("method_ord"), F.when(F.col("xl").isNotNull() & F.col("xr").isNotNull(), p).alias("pred")) for i, (k, p) in enumerate(preds.items())])
    return b.select("gap_id", "series_id", "pos", "truth", F.explode(rows).alias("m")).select("gap_id", "series_id", "pos", "truth", "m.*")


def template(masked: DataFrame, strength: float = 1.0) -> DataFrame:
    """The line between the neighbours with the tapered movement of the nearest whole segment on each side. A gap's
    window is one row of arrays; segments are looked for outwards within it."""
    w = masked.groupBy("gap_id", "series_id", "length").agg(F.array_sort(F.collect_list(F.struct("pos", "side", "value"))).alias("s"))
    n = F.col("length").cast("int")
    side = lambda k: F.transform(F.filter("s", lambda x: x["side"] == k), lambda x: x["value"])
    w = w.withColumns({"l": side("L"), "r": side("R"), "p": F.transform(F.filter("s", lambda x: x["side"] == "G"), lambda x: x["pos"])})
    w = w.withColumns({"xl": F.element_at("l", -1), "xr": F.get("r", F.lit(0))}).where("xl is not null and xr is not null")

    def nearest(values: str, outward: bool):
        starts = F.when(F.size(values) >= n, F.sequence(F.size(values) - n, F.lit(0), F.lit(-1)) if outward else F.sequence(F.lit(0), F.size(values) - n)).otherwise(F.array().cast("array<int>"))
        segments = F.transform(starts, lambda k: F.slice(values, k + 1, n))
        return F.get(F.filter(segments, lambda x: ~F.exists(x, lambda v: v.isNull())), F.lit(0))

    w = w.withColumns({"a": nearest("l", True), "b": nearest("r", False)}).where("a is not null or b is not null")
    mean = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.zip_with("a", "b", lambda x, y: (x + y) / 2))
    w = w.withColumn("m", mean)
    one = F.greatest(n - 1, F.lit(1))

    def value(m, k):
        trend = F.get("m", F.lit(0)) + (F.element_at("m", -1) - F.get("m", F.lit(0))) * k / one
        taper = F.when(n == 1, 0.0).otherwise(F.pow(F.sin(F.lit(np.pi) * k / one), 2))
        return F.col("xl") + (F.col("xr") - F.col("xl")) * (k + 1) / (n + 1) + taper * strength * (m - trend)

    out = w.select("gap_id", "series_id", F.explode(F.arrays_zip("p", F.transform("m", value).alias("v"))).alias("x"))
    return out.select("gap_id", "series_id", F.col("x.p").alias("pos"), F.col("x.v").alias("pred"))


def seasonal(samples: DataFrame, gaps: DataFrame, season: kernels.Season) -> DataFrame:
    """Periodic self-join: whole valid segments at 1 to ``offsets`` periods before and after, nearest first, at most
    ``per_direction`` each way and ``least`` in all; pointwise mean or median. Sample offsets join on positions,
    times and calendar years on times."""
    ways = (-1,) if season.past_only else (-1, 1)
    shifts = F.explode(F.array(*[F.struct(F.lit(o).alias("off"), F.lit(d).alias("dir")) for o in range(1, season.offsets + 1) for d in ways]))
    want = gaps.select("gap_id", "series_id", "length", "gap_start", "gap_end", F.explode(F.sequence("gap_start", F.col("gap_end") - 1)).alias("pos"))
    by_time = season.strategy != "sample_offset"
    if by_time:
        want = want.join(samples.select("series_id", "pos", "t_ms"), ["series_id", "pos"])
    want = want.select("*", shifts.alias("x")).select("*", "x.off", "x.dir").drop("x")
    k = F.col("dir") * F.col("off")
    if season.strategy == "calendar_year":
        ts = F.timestamp_millis(F.col("t_ms").cast("long")).cast("timestamp_ntz")
        ref = F.unix_millis(years_on(ts, (k * int(season.period)).cast("int"), season.leap).cast("timestamp")).cast("double")
    else:
        ref = F.col("t_ms" if by_time else "pos") + k * (season.period if by_time else int(season.period))
    ok = samples.where("valid").select(F.col("series_id").alias("s"), F.col("t_ms" if by_time else "pos").alias("r"), F.col("pos").alias("rp"), "value")
    hit = want.withColumn("ref", ref).join(ok, (F.col("series_id") == F.col("s")) & (F.col("ref") == F.col("r"))).where("rp < gap_start or rp >= gap_end")
    whole = hit.groupBy("gap_id", "dir", "off", "length").agg(F.count("*").alias("n")).where("n = length")
    near = whole.withColumn("k", F.row_number().over(W.partitionBy("gap_id", "dir").orderBy("off"))).where(F.col("k") <= season.per_direction)
    enough = near.withColumn("all", F.count("*").over(W.partitionBy("gap_id"))).where(F.col("all") >= season.least).select("gap_id", "dir", "off")
    fold = F.median("value") if season.how == "median" else F.avg("value")
    return hit.join(enough, ["gap_id", "dir", "off"]).groupBy("gap_id", "pos").agg(fold.alias("pred"), F.count("*").alias("references"))


def _inner(h0, s0, h1, s1):
    """Derivative of a monotone cubic at a point between two intervals of width h and slope s."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(s0 * s1 > 0, (w0 + w1) / (w0 / s0 + w1 / s1)).otherwise(0.0)


def _end(h0, s0, h1, s1):
    """Derivative at the outer end of the interval 0, whose other neighbour is the interval 1."""
    d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
    return F.when(d * s0 <= 0, 0.0).when((s0 * s1 <= 0) & (F.abs(d) > 3 * F.abs(s0)), 3 * s0).otherwise(d)


def pchip(masked: DataFrame) -> DataFrame:
    """Monotone cubic over the context by time. Only the two support points on each side shape the curve inside the
    gap, so one aggregate finds them; a side with one point takes the end rule, two sides with one point each give
    the line between them. Null where a neighbour of the gap is missing."""
    point = F.when(F.col("value").isNotNull(), F.struct("pos", F.col("t_ms").alias("t"), "value"))
    here = lambda p: F.max(F.when(F.col("pos") == p, point))
    a = masked.groupBy("gap_id", "series_id", "gap_start", "gap_end").agg(
        F.max(F.when(F.col("pos") < F.col("gap_start") - 1, point)).alias("p0"), here(F.col("gap_start") - 1).alias("p1"), here(F.col("gap_end")).alias("p2"),
        F.min(F.when(F.col("pos") > F.col("gap_end"), point)).alias("p3"), F.array_sort(F.collect_list(F.when(F.col("side") == "G", F.struct("pos", F.col("t_ms").alias("t"))))).alias("at"),
    )
    y1, y2 = F.col("p1.value"), F.col("p2.value")
    h = F.col("p2.t") - F.col("p1.t")
    s = (y2 - y1) / h
    h0, h3 = F.col("p1.t") - F.col("p0.t"), F.col("p3.t") - F.col("p2.t")
    s0, s3 = (y1 - F.col("p0.value")) / h0, (F.col("p3.value") - y2) / h3
    left, right = F.col("p0").isNotNull(), F.col("p3").isNotNull()
    d1 = F.when(left, _inner(h0, s0, h, s)).when(right, _end(h, s, h3, s3)).otherwise(s)
    d2 = F.when(right, _inner(h, s, h3, s3)).when(left, _end(h, s, h0, s0)).otherwise(s)
    a = a.select("gap_id", "series_id", y1.alias("y1"), y2.alias("y2"), F.col("p1.t").alias("t1"), h.alias("h"), d1.alias("d1"), d2.alias("d2"), F.explode("at").alias("x"))
    t = (F.col("x.t") - F.col("t1")) / F.col("h")
    y = F.col("y1") * (1 + 2 * t) * (1 - t) * (1 - t) + F.col("h") * F.col("d1") * t * (1 - t) * (1 - t) + F.col("y2") * t * t * (3 - 2 * t) + F.col("h") * F.col("d2") * t * t * (t - 1)
    return a.select("gap_id", "series_id", F.col("x.pos").alias("pos"), y.alias("pred"))


def by_kernels(masked: DataFrame, methods: dict[str, kernels.Kernel]) -> DataFrame:
    """(gap_id, series_id, pos, truth, method, method_ord, pred, applicable, reason): every method on every gap's own
    window. Windows are gathered to one row of arrays each and go through Python in Arrow batches; a method that
    fails gives its reason and leaves the others alone."""
    rows = masked.groupBy("gap_id", "series_id", "gap_start", "gap_end").agg(F.array_sort(F.collect_list(F.struct("pos", "t_ms", "value", "truth"))).alias("s"))
    rows = rows.select("gap_id", "series_id", "gap_start", "gap_end", *[F.col("s")[c].alias(c) for c in ("pos", "t_ms", "value", "truth")])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                pos, t = np.asarray(r.pos), np.asarray(r.t_ms, float)
                y = np.array([np.nan if v is None else v for v in r.value], float)
                a, z = int(r.gap_start - pos[0]), int(r.gap_end - pos[0])
                for k, (name, kernel) in enumerate(methods.items()):
                    got, why = kernels.run(kernel, kernels.Window(y.copy(), np.isfinite(y), a, z, 0, len(y), t.copy()))
                    for i in range(a, z):
                        out.append((r.gap_id, r.series_id, int(pos[i]), r.truth[i], name, k, None if got is None else float(got[i - a]), got is not None, why))
            if out:
                yield pd.DataFrame(out, columns=["gap_id", "series_id", "pos", "truth", "method", "method_ord", "pred", "applicable", "reason"])

    return rows.mapInPandas(fill, "gap_id string, series_id string, pos long, truth double, method string, method_ord long, pred double, applicable boolean, reason string")
