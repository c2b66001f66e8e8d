"""Reconstruction kernels on arrays: one gap of one series at a time, for what is not a plain plan.

A kernel takes a ``Window`` and gives the values of the gap's samples, or raises ``NotApplicable`` with a reason;
``run`` turns that into (values or None, reason or None). No kernel ever reads a value inside the gap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


class NotApplicable(Exception):
    pass


@dataclass
class Window:
    """A series with a gap [start, end) and a context [left, right) around it. ``t`` is in milliseconds, or None."""

    values: np.ndarray
    valid: np.ndarray
    start: int
    end: int
    left: int
    right: int
    t: np.ndarray | None = None
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        self.valid = self.valid & np.isfinite(self.values)

    def ends(self) -> tuple[float, float]:
        if not (0 < self.start < self.end < len(self.values)):
            raise NotApplicable("the gap has no neighbour on both sides")
        if not (self.valid[self.start - 1] and self.valid[self.end]):
            raise NotApplicable("a neighbour of the gap is not valid")
        return float(self.values[self.start - 1]), float(self.values[self.end])

    def increasing(self, a: int, b: int) -> bool:
        return self.t is not None and bool(np.isfinite(self.t[a:b]).all() and (np.diff(self.t[a:b]) > 0).all())

    def support(self, sides: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates and values of the context's valid samples, and the gap's coordinates: times if there are any,
        which must then increase over the whole window, else positions."""
        self.ends()
        at = np.concatenate([np.arange(max(0, self.left), self.start), np.arange(self.end, min(self.right, len(self.values)))])
        at = at[self.valid[at]]
        if len(at) < 2 or (sides and not ((at < self.start).any() and (at >= self.end).any())):
            raise NotApplicable("too few valid samples around the gap")
        if self.t is not None and not self.increasing(max(0, self.left), min(self.right, len(self.values))):
            raise NotApplicable("times are not finite and strictly increasing")
        x = self.t if self.t is not None else np.arange(len(self.values), dtype=float)
        return x[at].astype(float), self.values[at].astype(float), x[self.start : self.end].astype(float)


def forward_fill(w: Window) -> np.ndarray:
    return np.full(w.end - w.start, w.ends()[0])


def nearest_boundary(w: Window) -> np.ndarray:
    """By time where times increase over the gap and its neighbours, else by position; the left one on ties."""
    a, b = w.ends()
    x = w.t if w.increasing(w.start - 1, w.end + 1) else np.arange(len(w.values), dtype=float)
    inside = x[w.start : w.end]
    return np.where(inside - x[w.start - 1] <= x[w.end] - inside, a, b)


def linear(w: Window) -> np.ndarray:
    a, b = w.ends()
    return a + (b - a) * np.arange(1, w.end - w.start + 1) / (w.end - w.start + 1)


def _slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of the monotone cubic through all points."""
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    if len(s) == 1:
        return np.full(2, s[0])
    d = np.zeros(len(x))
    same = s[1:] * s[:-1] > 0
    w0, w1 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    d[1:-1][same] = ((w0 + w1)[same]) / (w0[same] / s[:-1][same] + w1[same] / s[1:][same])
    for i, j, k in ((0, 0, 1), (-1, -1, -2)):
        e = ((2 * h[j] + h[k]) * s[j] - h[j] * s[k]) / (h[j] + h[k])
        d[i] = 0.0 if e * s[j] <= 0 else 3 * s[j] if s[j] * s[k] <= 0 and abs(e) > 3 * abs(s[j]) else e
    return d


def pchip(w: Window) -> np.ndarray:
    x, y, at = w.support()
    d, i = _slopes(x, y), np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    u = (at - x[i]) / h
    return y[i] * (1 + 2 * u) * (1 - u) ** 2 + h * d[i] * u * (1 - u) ** 2 + y[i + 1] * u * u * (3 - 2 * u) + h * d[i + 1] * u * u * (u - 1)


def natural_spline(w: Window) -> np.ndarray:
    """Cubic spline over all support points whose second derivative is 0 at both ends."""
    x, y, at = w.support()
    h, s, n = np.diff(x), np.diff(y) / np.diff(x), len(x)
    c = np.zeros(n)
    if n > 2:  # tridiagonal system of the second derivatives, solved by elimination
        diag, up, rhs = 2 * (h[:-1] + h[1:]), h[1:-1].copy(), 6 * np.diff(s)
        for i in range(1, n - 2):
            f = h[i] / diag[i - 1]
            diag[i] -= f * up[i - 1]
            rhs[i] -= f * rhs[i - 1]
        for i in range(n - 3, -1, -1):
            c[i + 1] = (rhs[i] - (up[i] * c[i + 2] if i < n - 3 else 0.0)) / diag[i]
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = x[i + 1] - at, at - x[i]
    return (c[i] * a**3 + c[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - c[i] * h[i] / 6) * a + (y[i + 1] / h[i] - c[i + 1] * h[i] / 6) * b


def polyfit_bic(w: Window) -> np.ndarray:
    """Least squares of degree 1, 2 or 3, whichever has the least BIC; the lowest on ties."""
    x, y, at = w.support(sides=False)
    centre, n = x.mean(), len(x)
    spread = np.abs(x - centre).max()
    if not spread > 0:
        raise NotApplicable("support times cannot be scaled")
    u, best = (x - centre) / spread, None
    for degree in range(1, min(3, n - 1) + 1):
        p = np.polynomial.polynomial.polyfit(u, y, degree)
        rss = float(((y - np.polynomial.polynomial.polyval(u, p)) ** 2).sum())
        bic = n * np.log(max(rss / n, np.finfo(float).eps)) + (degree + 1) * np.log(n)
        if best is None or bic < best[0]:
            best = bic, degree, p
    w.meta |= {"selected_degree": best[1]}
    return np.polynomial.polynomial.polyval((at - centre) / spread, best[2])


def template(w: Window, strength: float = 1.0) -> np.ndarray:
    """The line between the neighbours, with the tapered movement of the nearest whole segment on each side."""
    a, b = w.ends()
    n, found = w.end - w.start, []
    for starts in (range(w.start - n, max(0, w.left) - 1, -1), range(w.end, min(w.right, len(w.values)) - n + 1)):
        at = next((k for k in starts if w.valid[k : k + n].all()), None)
        if at is not None:
            found.append(w.values[at : at + n])
    if not found:
        raise NotApplicable("no whole segment in the context")
    mean = np.mean(found, axis=0)
    moved = strength * (mean - np.linspace(mean[0], mean[-1], n))
    w.meta |= {"number_of_template_candidates": len(found)}
    return linear(w) + np.sin(np.pi * np.linspace(0.0, 1.0, n)) ** 2 * moved


@dataclass(frozen=True)
class Season:
    """Reference segments at whole periods before and after the gap."""

    strategy: str = "sample_offset"  # or fixed_timedelta (period in milliseconds), calendar_year (period in years)
    period: float = 24
    offsets: int = 8
    per_direction: int = 3
    least: int = 3
    how: str = "median"
    leap: str = "feb28"  # or skip, mar1
    past_only: bool = False

    def __post_init__(self):
        ways = 1 if self.past_only else 2
        for ok, why in (
            (self.strategy in ("sample_offset", "fixed_timedelta", "calendar_year"), "unknown period strategy"),
            (self.period > 0, "the period must be positive"),
            (self.strategy == "fixed_timedelta" or self.period == int(self.period), "the period must be whole"),
            (self.offsets > 0 and self.per_direction > 0 and self.least > 0, "counts must be positive"),
            (self.least <= self.per_direction * ways, "more references are asked for than there can be"),
            (self.how in ("mean", "median") and self.leap in ("feb28", "skip", "mar1"), "unknown aggregation or leap day policy"),
        ):
            if not ok:
                raise ValueError(why)


def shifted_years(t: np.ndarray, years: int, leap: str) -> np.ndarray | None:
    """Times in ms, so many calendar years on. 29 February falls on 28 February, on 1 March, or spoils the segment."""
    day = np.floor(t / 86_400_000).astype("int64").astype("datetime64[D]")
    month = day.astype("datetime64[M]")
    year, rest = day.astype("datetime64[Y]"), (day - month).astype(int)
    to = (year + np.timedelta64(years, "Y")).astype("datetime64[M]") + (month - year.astype("datetime64[M]"))
    out = to.astype("datetime64[D]") + rest
    over = out.astype("datetime64[M]") != to  # only 29 February in a common year
    if over.any() and leap == "skip":
        return None
    out = np.where(over & (leap == "feb28"), out - 1, out)
    return out.astype("int64") * 86_400_000.0 + (t - np.floor(t / 86_400_000) * 86_400_000)


def seasonal(w: Window, season: Season) -> np.ndarray:
    n, found = w.end - w.start, {-1: [], 1: []}
    if season.strategy != "sample_offset" and not w.increasing(0, len(w.values)):
        raise NotApplicable("times are not finite and strictly increasing")
    ways = (-1,) if season.past_only else (-1, 1)
    for offset in range(1, season.offsets + 1):
        for way in ways:
            if len(found[way]) >= season.per_direction:
                continue
            if season.strategy == "sample_offset":
                at = np.arange(n) + w.start + way * offset * int(season.period)
            else:
                want = w.t[w.start : w.end] + way * offset * season.period if season.strategy == "fixed_timedelta" else shifted_years(w.t[w.start : w.end], way * offset * int(season.period), season.leap)
                if want is None:
                    continue
                at = np.searchsorted(w.t, want)
                if (at >= len(w.t)).any() or (w.t[np.minimum(at, len(w.t) - 1)] != want).any():
                    continue
            if at[0] < 0 or at[-1] >= len(w.values) or ((at >= w.start) & (at < w.end)).any() or not w.valid[at].all():
                continue
            found[way].append(w.values[at])
    every = found[-1] + found[1]
    if len(every) < season.least:
        raise NotApplicable("too few whole reference segments")
    w.meta |= {"past_candidate_count": len(found[-1]), "future_candidate_count": len(found[1])}
    return (np.mean if season.how == "mean" else np.median)(every, axis=0)


Kernel = Callable[[Window], np.ndarray]
#: Seven methods in the order that breaks ties.
METHODS: dict[str, Kernel] = {
    "pchip": pchip, "linear": linear, "local_natural_cubic_spline": natural_spline, "polyfit_bic": polyfit_bic,
    "template": template, "nearest_boundary": nearest_boundary, "forward_fill": forward_fill,
}
WEEK_MS = 7 * 86_400_000
SEASONS = {"weather": Season("calendar_year", 1, how="mean", leap="skip"), "traffic": Season("fixed_timedelta", WEEK_MS, leap="skip")}


def portfolio(domain: str | None = None) -> dict[str, Kernel]:
    """The seven methods; weather and traffic have the seasonal one besides."""
    if domain not in SEASONS:
        return dict(METHODS)
    return METHODS | {"seasonal_periodic": lambda w: seasonal(w, SEASONS[domain])}


def run(kernel: Kernel, w: Window) -> tuple[np.ndarray | None, str | None]:
    """Never raises: what a kernel throws, and values that are no finite vector of the gap's length, are reasons."""
    try:
        out = np.asarray(kernel(w), dtype=float)
    except NotApplicable as why:
        return None, str(why)
    except Exception as why:  # noqa: BLE001 a method that fails must not end the others
        return None, f"{type(why).__name__}: {why}"
    if out.shape != (w.end - w.start,):
        return None, "prediction_length_or_shape_mismatch"
    if not np.isfinite(out).all():
        return None, "non_finite_predictions"
    return out, None
