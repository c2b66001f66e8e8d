"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """NaN and infinities count as missing."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def number(value: Column) -> Column:
    """What is no finite number is missing."""
    return finite(value.try_cast("double"))


def strictly_valid(flag: Column, value: Column) -> Column:
    """A true boolean (not 1, not 'true') beside a finite value."""
    return F.coalesce(flag, F.lit(False)) & finite(value).isNotNull()


def loosely_valid(flag: Column, value: Column) -> Column:
    """Any truthy flag beside a finite value."""
    return F.coalesce(flag.try_cast("boolean"), F.lit(False)) & number(value).isNotNull()


def samples_of(duration_ms: Column, rate_hz: Column) -> Column:
    """Samples that a duration takes: to the nearest, halves to even, one at least."""
    return F.greatest(F.lit(1), F.bround(duration_ms / 1000 * rate_hz)).cast("long")


def unit_hours(ms: Column) -> Column:
    return ms / 3_600_000


def unit_minutes(ms: Column) -> Column:
    return ms / 60_000


def outcome(selected: Column, baseline: Column, tolerance: float = 1e-12) -> Column:
    """better, worse or equal, within a tolerance."""
    return F.when(selected < baseline - tolerance, "better").when(selected > baseline + tolerance, "worse").otherwise("equal")


def years_on(ts: Column, years: Column, leap: str = "feb28") -> Column:
    """A timestamp so many calendar years on; 29 February falls on the 28th, on 1 March, or gives null."""
    to = F.make_ym_interval(years, F.lit(0)) + ts
    moved = (F.month(ts) == 2) & (F.dayofmonth(ts) == 29) & (F.dayofmonth(to) != 29)
    if leap == "feb28":
        return to
    return F.when(~moved, to) if leap == "skip" else F.when(moved, to + F.expr("interval 1 day")).otherwise(to)


def identity_seed(*parts: Column) -> Column:
    """First 8 bytes, in hex, of the SHA-256 of the identity; missing parts are told apart from empty ones."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("<null>")) for p in parts])), 256), 1, 16)
