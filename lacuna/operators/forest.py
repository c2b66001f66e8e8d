"""Multi-output regression forests and nested leave-one-group-out evaluation.

Targets are learned together: a split lowers the summed squared error of all outputs. Trees are grown one to a
task on a matrix that is broadcast behind a check of its size, and a forest is a table of trees, so that it is
written and read as Parquet and predicts by Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The training matrix is broadcast; larger ones are refused.
MAX_CELLS = 50_000_000
TREES = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<array<double>>"


@dataclass(frozen=True)
class Settings:
    trees: int = 300
    depth: int | None = None
    leaf: int = 1
    features: float | str = 1.0  # share of the features that a split looks at, or 'sqrt'
    bootstrap: bool = True
    extra: bool = False  # thresholds drawn instead of searched
    seed: int = 42


#: The grids that are searched.
GRID = [Settings(300, None, 1, 1.0), Settings(300, None, 5, 1.0), Settings(300, 12, 5, "sqrt")]
GRID_WIDE = [Settings(300, d, m, f) for d, m, f in ((None, 1, 1.0), (None, 3, 1.0), (None, 5, 1.0), (None, 5, "sqrt"), (8, 5, 1.0), (12, 5, 1.0), (12, 10, "sqrt"))]


def grow(x: np.ndarray, y: np.ndarray, s: Settings, tree: int) -> tuple[list, list, list, list, list]:
    rng = np.random.default_rng([s.seed, tree])
    rows = rng.integers(len(x), size=len(x)) if s.bootstrap else np.arange(len(x))
    width = x.shape[1]
    look = max(1, int(np.sqrt(width)) if s.features == "sqrt" else round(float(s.features) * width))
    feature, threshold, left, right, value = [], [], [], [], []

    def split(at: np.ndarray) -> tuple[int, float] | None:
        best, found = 1e-12, None
        n, total = len(at), y[at].sum(axis=0)
        base = (total**2).sum() / n
        for f in rng.permutation(width)[:look]:
            v = x[at, f]
            if s.extra:
                lo, hi = v.min(), v.max()
                cuts = [rng.uniform(lo, hi)] if hi > lo else []
                for c in cuts:
                    m = v <= c
                    k = int(m.sum())
                    if min(k, n - k) >= s.leaf:
                        part = y[at[m]].sum(axis=0)
                        gain = (part**2).sum() / k + ((total - part) ** 2).sum() / (n - k) - base
                        if gain > best:
                            best, found = gain, (int(f), float(c))
                continue
            order = np.argsort(v, kind="stable")
            w = v[order]
            sums = np.cumsum(y[at[order]], axis=0)[:-1]
            k = np.arange(1, n)
            gain = (sums**2).sum(axis=1) / k + ((total - sums) ** 2).sum(axis=1) / (n - k) - base
            gain[(w[1:] == w[:-1]) | (k < s.leaf) | (n - k < s.leaf)] = -1.0
            i = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[i] > best:
                best, found = gain[i], (int(f), float((w[i] + w[i + 1]) / 2))
        return found

    todo = [(rows, 0, -1, False)]
    while todo:
        at, depth, parent, is_right = todo.pop()
        me = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1), value.append(y[at].mean(axis=0).tolist())
        cut = split(at) if len(at) >= 2 * s.leaf and (s.depth is None or depth < s.depth) else None
        if cut:
            feature[me], threshold[me] = cut
            m = x[at, cut[0]] <= cut[1]
            todo += [(at[~m], depth + 1, me, True), (at[m], depth + 1, me, False)]
    return feature, threshold, left, right, value


def descend(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), int)
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return node
        at = node[inner]
        node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])


class Forest:
    def __init__(self, trees: list[tuple], features: list[str], methods: list[str], medians: np.ndarray):
        self.trees = [tuple(np.asarray(a) for a in t) for t in trees]
        self.features, self.methods, self.medians = features, methods, medians

    def each(self, x: np.ndarray) -> np.ndarray:
        """Predictions of every tree: (tree, row, method). Missing features are the training medians."""
        x = np.where(np.isfinite(x), x, self.medians)
        return np.stack([v[descend(x, f, t, lo, hi)] for f, t, lo, hi, v in self.trees])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.each(x).mean(axis=0)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *[a.tolist() for a in t]) for i, t in enumerate(self.trees)], TREES)


def matrix(train: DataFrame, features: list[str], targets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of the rows whose targets are all there, in an order that does not depend on partitions."""
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in (*features, *targets)]).dropna(subset=targets)
    if rows.count() * len(rows.columns) > MAX_CELLS:
        raise ValueError("the training matrix is too large to be broadcast")
    m = rows.toPandas().to_numpy(float)
    m = m[np.lexsort(m.T[::-1])]
    return m[:, : len(features)], m[:, len(features) :]


def fit(spark: SparkSession, x: np.ndarray, y: np.ndarray, features: list[str], methods: list[str], s: Settings = Settings()) -> Forest:
    """Missing features become the exact medians of the training rows. One task grows some of the trees."""
    if not len(x):
        raise ValueError("no training rows")
    finite = np.where(np.isfinite(x), x, np.nan)
    medians = np.nan_to_num(np.nanmedian(finite, axis=0)) if len(x) else np.zeros(len(features))
    shared = spark.sparkContext.broadcast((np.where(np.isfinite(x), x, medians), y))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["id"]:
                yield pd.DataFrame([(t, *grow(*shared.value, s, int(t)))], columns=["tree", "feature", "threshold", "left", "right", "value"])

    tasks = max(1, min(s.trees, spark.sparkContext.defaultParallelism))
    rows = spark.range(0, s.trees, numPartitions=tasks).mapInPandas(run, TREES).collect()
    return Forest([(r.feature, r.threshold, r.left, r.right, r.value) for r in sorted(rows, key=lambda r: r.tree)], features, methods, medians)


def predict(frame: DataFrame, forest: Forest, with_spread: bool = False) -> DataFrame:
    """(gap_id, method, method_ord, predicted (, spread)): one row per gap and method; the spread is the standard
    deviation over trees."""
    shared = frame.sparkSession.sparkContext.broadcast(forest)
    cols = list(forest.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            if len(b):
                each = f.each(b[cols].to_numpy(float))
                n, m = len(b), len(f.methods)
                yield pd.DataFrame({"gap_id": np.repeat(b["gap_id"].to_numpy(), m), "method": f.methods * n, "method_ord": np.tile(np.arange(m), n), "predicted": each.mean(axis=0).ravel(), "spread": each.std(axis=0).ravel()})

    out = frame.select("gap_id", *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(run, "gap_id string, method string, method_ord long, predicted double, spread double")
    return out if with_spread else out.drop("spread")


def chosen_error(predicted: np.ndarray, actual: np.ndarray) -> np.ndarray:
    """Actual errors of the methods with the lowest predicted ones, the first on ties."""
    return actual[np.arange(len(actual)), predicted.argmin(axis=1)]


def leave_one_out(spark: SparkSession, x: np.ndarray, y: np.ndarray, groups: np.ndarray, s: Settings) -> float:
    """Unweighted mean over held-out groups of the mean actual error of the chosen methods."""
    names = [str(i) for i in range(x.shape[1])], [str(i) for i in range(y.shape[1])]
    return float(np.mean([chosen_error(fit(spark, x[groups != g], y[groups != g], *names, s).predict(x[groups == g]), y[groups == g]).mean() for g in np.unique(groups)]))


def nested(spark: SparkSession, table: pd.DataFrame, features: list[str], targets: list[str], group: str, grid: list[Settings], rescale=None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Nested leave-one-group-out: for each outer group the grid is scored on inner groups of the rest, the best (the
    first on ties) is fitted on the rest and predicts the group. Gives predictions and inner scores. ``rescale``
    (table, training mask) -> features makes fold-local features; else the columns are taken as they are."""
    y, of = table[targets].to_numpy(float), table[group].to_numpy()
    tuned, out = [], []
    for outer in sorted(np.unique(of)):
        rest = of != outer
        x = table[features].to_numpy(float) if rescale is None else rescale(table, rest)
        scores = [leave_one_out(spark, x[rest], y[rest], of[rest], s) for s in grid]
        tuned += [{"outer": outer, "candidate": i, "score": v, **asdict(grid[i])} for i, v in enumerate(scores)]
        s = grid[int(np.argmin(scores))]
        p = fit(spark, x[rest], y[rest], features, targets, s).predict(x[~rest])
        part = pd.DataFrame(p, columns=[f"predicted_{t}" for t in targets]).assign(gap_id=table["gap_id"].to_numpy()[~rest], **{group: outer}, candidate=int(np.argmin(scores)))
        part["selected_method"] = [targets[i] for i in p.argmin(axis=1)]
        part["selected_error"] = chosen_error(p, y[~rest])
        out.append(part)
    return pd.concat(out, ignore_index=True), pd.DataFrame(tuned)


def final_settings(tuned: pd.DataFrame, grid: list[Settings]) -> Settings:
    """The candidate with the lowest mean inner score over outer folds, the first on ties."""
    return grid[int(tuned.groupby("candidate")["score"].mean().sort_index().idxmin())]
