"""Seeded samplers of artificial gaps, splits and balanced choices.

Greedy choice without overlap is sequential within a series, so each series (or series and year) is one group
of a grouped map; its generator is seeded by the seed and the group's key, never by partitions. Keys are ranked
by hashes, so choices among them are plans.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gaps import strata

SCHEMA = "series_id string, stratum int, status string, length long, gap_start long, gap_end long, ctx_start long, ctx_end long, left_share double, right_share double"


class GapSamplingError(ValueError):
    pass


def generator(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(json.dumps([seed, *map(str, key)]).encode()).digest()[:8], "big"))


class Starts:
    """Eligible starts of a series for any length, by prefix sums of validity; remembered by length."""

    def __init__(self, valid: np.ndarray, multiple: float = 1.0, share: float = 0.8, least: int = 2):
        self.valid, self.multiple, self.share, self.least = valid, multiple, share, least
        self.sums, self.known = np.concatenate([[0], np.cumsum(valid)]), {}

    def context(self, n: int) -> int:
        return max(self.least, round(self.multiple * n))

    def of(self, n: int) -> np.ndarray:
        if n not in self.known:
            c, size = self.context(n), len(self.valid)
            s = np.arange(c, size - n - c + 1)
            inside = self.sums[s + n] - self.sums[s] == n
            before, after = self.sums[s] - self.sums[s - c], self.sums[s + n + c] - self.sums[s + n]
            ok = inside & self.valid[s - 1] & self.valid[np.minimum(s + n, size - 1)] & (before >= self.share * c) & (after >= self.share * c)
            self.known[n] = s[ok]
        return self.known[n]

    def window(self, start: int, n: int) -> tuple[int, int]:
        return start - self.context(n), start + n + self.context(n)

    def shares(self, start: int, n: int) -> tuple[float, float]:
        c = self.context(n)
        return (self.sums[start] - self.sums[start - c]) / c, (self.sums[start + n + c] - self.sums[start + n]) / c


def _free(starts: np.ndarray, n: int, of: Starts, taken: list[tuple[int, int]]) -> np.ndarray:
    c = of.context(n)
    for a, b in taken:
        starts = starts[(starts + n + c <= a) | (starts - c >= b)]
    return starts


def balanced(n: int, parts: int, rng: np.random.Generator) -> list[int]:
    """n over so many strata as evenly as can be; who gets one more is drawn."""
    more = set(rng.permutation(parts)[: n % parts].tolist())
    return [n // parts + (i in more) for i in range(parts)]


def draw(of: Starts, rng: np.random.Generator, tasks: list[tuple[int, float, float]], rate_hz: float, attempts: int, avoid_first: bool) -> list[tuple]:
    """For each task (stratum, low, high in ms) a gap whose window overlaps none before it: a duration is drawn
    evenly, then a start among those that fit (with ``avoid_first`` among those that are free)."""
    taken, out = [], []
    for stratum, low, high in tasks:
        for _ in range(attempts):
            n = max(1, round(rng.uniform(low, high) / 1000 * rate_hz))
            starts = of.of(n)
            if avoid_first:
                starts = _free(starts, n, of, taken)
            if not len(starts):
                continue
            start = int(starts[rng.integers(len(starts))])
            lo, hi = of.window(start, n)
            if avoid_first or all(hi <= a or lo >= b for a, b in taken):
                taken.append((lo, hi))
                out.append((stratum, "accepted", n, start, start + n, lo, hi, *of.shares(start, n)))
                break
        else:
            out.append((stratum, "skipped", *[None] * 7))
    return out


def sample_gaps(samples: DataFrame, n: int, low_ms: float, high_ms: float, rate_hz: float, n_strata: int = 1, seed: int = 42, order: str = "shuffled", shortfall: str = "raise", attempts: int = 100, avoid_first: bool = True, multiple: float = 1.0, share: float = 0.8, least: int = 2, within: str | None = None) -> DataFrame:
    """``n`` gaps a series without overlap, durations between two bounds in ``n_strata`` strata of equal width and
    balanced counts. One stratum is plain random sampling. Strata come in order or shuffled; a shortfall raises or
    gives rows with status 'skipped'. ``within`` names a further column (a year) that parts a series into groups
    which are sampled apart. Reads (series_id, pos, valid)."""
    if order not in ("shuffled", "given") or shortfall not in ("raise", "log"):
        raise ValueError("order is shuffled or given, shortfall raise or log")
    edges = strata(low_ms, high_ms, n_strata)
    keys = ["series_id"] + ([within] if within else [])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        first = int(group["pos"].iloc[0])
        rng = generator(seed, *key)
        tasks = [(i, *edges[i]) for i, k in enumerate(balanced(n, n_strata, rng)) for _ in range(k)]
        if order == "shuffled":
            tasks = [tasks[i] for i in rng.permutation(len(tasks))]
        of = Starts(group["valid"].to_numpy(bool), multiple, share, least)
        rows = draw(of, rng, tasks, rate_hz, attempts, avoid_first)
        if shortfall == "raise" and any(r[1] == "skipped" for r in rows):
            raise GapSamplingError(f"{sum(r[1] == 'accepted' for r in rows)} of {n} gaps found in {key}")
        out = pd.DataFrame([(str(key[0]), *r) for r in rows], columns=[c.split()[0] for c in SCHEMA.split(", ")])
        for c in ("gap_start", "gap_end", "ctx_start", "ctx_end"):
            out[c] = out[c].astype("Int64") + first
        out["length"] = out["length"].astype("Int64")
        return out.sort_values("gap_start")

    return samples.select(*keys, "pos", "valid").groupBy(*keys).applyInPandas(run, SCHEMA)


def non_overlapping(found: DataFrame, n: int | None = None, seed: int | None = 42) -> DataFrame:
    """Rows of candidates, per series, none of whose windows overlap: in shuffled order (or, without a seed, the
    earliest first) each is taken if it is free, until there are ``n``. Fewer than n is an error."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ctx_start", "length", "gap_id"])
        order = generator(seed, *key).permutation(len(group)) if seed is not None else np.arange(len(group))
        lo, hi, taken = group["ctx_start"].to_numpy(), group["ctx_end"].to_numpy(), []
        for i in order:
            if n is not None and len(taken) == n:
                break
            a, b = lo[taken], hi[taken]
            if ((hi[i] <= a) | (lo[i] >= b)).all():
                taken.append(i)
        if n is not None and len(taken) < n:
            raise GapSamplingError(f"{len(taken)} of {n} gaps found in {key}")
        return group.iloc[sorted(taken)]

    return found.groupBy("series_id").applyInPandas(run, found.schema)


def _hashed(seed: int, *columns: str):
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *columns), 256)


def ranked_choice(keys: DataFrame, within: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` keys of each group without replacement: those first by a seeded hash. Groups with fewer give none."""
    w = W.partitionBy(*within)
    order = F.row_number().over(w.orderBy(_hashed(seed, *within, key), key))
    return keys.select(*within, key).distinct().withColumns({"k": order, "all": F.count("*").over(w)}).where((F.col("k") <= n) & (F.col("all") >= n)).drop("k", "all")


def balanced_recordings(recordings: DataFrame, participants: int, each: int, seed: int = 42) -> DataFrame:
    """(dataset, participant, recording) rows: in every data set so many participants who have ``each`` recordings
    or more, and so many recordings of each, by seeded hashes."""
    rows = recordings.select("dataset", "participant", "recording").distinct()
    enough = rows.groupBy("dataset", "participant").agg(F.count("*").alias("n")).where(F.col("n") >= each)
    who = ranked_choice(enough, ["dataset"], "participant", participants, seed)
    return ranked_choice(rows.join(who, ["dataset", "participant"], "left_semi"), ["dataset", "participant"], "recording", each, seed + 1)


def split_counts(n: int, shares: tuple[float, ...] = (0.7, 0.15, 0.15)) -> list[int]:
    """Largest remainders; with enough keys no split stays empty."""
    if abs(sum(shares) - 1) > 1e-9 or min(shares) <= 0:
        raise ValueError("shares must be positive and sum to 1")
    raw = [n * s for s in shares]
    out = [int(r) for r in raw]
    for i in sorted(range(len(raw)), key=lambda i: (out[i] - raw[i], i))[: n - sum(out)]:
        out[i] += 1
    while n >= len(out) and 0 in out:
        out[out.index(max(out))] -= 1
        out[out.index(0)] += 1
    return out


def split_participants(recordings: DataFrame, shares: tuple[float, ...] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """(dataset, participant, split): all of a participant's recordings fall in one split, train, validation or test."""
    names = ("train", "validation", "test")
    keys = recordings.select("dataset", "participant").distinct()
    cut = np.cumsum(split_counts(keys.count(), shares)).tolist()
    # one row a participant
    k = F.row_number().over(W.orderBy(_hashed(seed, "dataset", "participant"), "dataset", "participant"))
    return keys.withColumn("k", k).select("dataset", "participant", F.when(F.col("k") <= cut[0], names[0]).when(F.col("k") <= cut[1], names[1]).otherwise(names[2]).alias("split"))


def assign_recordings(recordings: DataFrame, splits: DataFrame) -> DataFrame:
    """Recordings with their split; one whose participant has none is an error."""
    out = recordings.join(splits, ["dataset", "participant"], "left")
    return out.withColumn("split", F.coalesce("split", F.raise_error(F.lit("a recording's participant is in no split")).cast("string")))


def identity(recordings: DataFrame, keys: list[str], by: str = "series_id") -> DataFrame:
    """One value of every identity column for each series, or <missing>, <null> and <multiple> where there is no one."""
    def told(c: str):
        if c not in recordings.columns:
            return F.lit("<missing>").alias(c)
        n = F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
        return F.when(n > 1, "<multiple>").otherwise(F.coalesce(F.max(F.col(c).cast("string")), F.lit("<null>"))).alias(c)

    return recordings.groupBy(by).agg(*[told(c) for c in keys])


def exactly_one(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The value of a column that must be one and the same for each key."""
    one = F.when((F.count_distinct(column) == 1) & (F.count(column) == F.count("*")), F.min(column))
    return frame.groupBy(*keys).agg(F.coalesce(one, F.raise_error(F.lit(f"not one value of {column}")).cast(dict(frame.dtypes)[column])).alias(column))


Sampler = Callable[..., DataFrame]
