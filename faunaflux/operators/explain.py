"""Shapley values of trees, exact and dependent on the trees' own paths.

Each leaf is a path: an interval for each feature on it, and the share of training weight that the splits on that feature let through. For a set of known features, a leaf counts by whether a
row lies in the intervals of those, and by the shares of the others; so the Shapley value of a feature is a sum over leaves of sums over how many other features are known, and the sets
themselves are never listed. Values add up to the prediction less the mean prediction of the training weights.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import FIELDS, chunked, matrix


def paths(tree: dict) -> list[tuple[float, dict[int, list[float]]]]:
    """(value, {feature: [low, high, share]}) of each leaf; a row is inside if low < x <= high."""
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        f = int(tree["feature"][node])
        if f < 0:
            out.append((float(tree["value"][node]), path))
            continue
        at, cover = float(tree["threshold"][node]), max(float(tree["cover"][node]), 1e-300)
        for side, below in ((int(tree["left"][node]), True), (int(tree["right"][node]), False)):
            low, high, share = path.get(f, [-np.inf, np.inf, 1.0])
            own = [low, min(high, at)] if below else [max(low, at), high]
            todo.append((side, {**path, f: [*own, share * float(tree["cover"][side]) / cover]}))
    return out


def _of_leaf(value: float, share: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Values (row, feature of the path) of one leaf, by which of its intervals rows lie in."""
    m = len(share)
    out = np.zeros((len(inside), m))
    weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    for i in range(m):
        # by number of other features known: sum of products of what each of them counts
        known = np.zeros((len(inside), m))
        known[:, 0] = 1.0
        for j in range(m):
            if j != i:
                more = known * share[j]
                more[:, 1:] += known[:, :-1] * inside[:, j : j + 1]
                known = more
        out[:, i] = value * (inside[:, i] - share[i]) * (known @ weights)
    return out


def shapley(x: np.ndarray, leaves: list[tuple[float, dict[int, list[float]]]], width: int) -> tuple[np.ndarray, float]:
    """Values (row, feature) of the sum of leaves, and the mean."""
    phi, mean = np.zeros((len(x), width)), 0.0
    over: dict[tuple[int, float], np.ndarray] = {}  # by feature and threshold, which many leaves share
    for value, path in leaves:
        names, m = list(path), len(path)
        share = np.array([path[f][2] for f in names])
        mean += value * float(np.prod(share))
        if m and 1 << m <= len(x):
            # rows are told apart only by which of the intervals they lie in
            kind = np.zeros(len(x), np.intp)
            for j, f in enumerate(names):
                low, high, _ = path[f]
                for at in (low, high):
                    if np.isfinite(at) and (f, at) not in over:
                        over[f, at] = x[:, f] > at
                inside = ~over[f, high] if np.isfinite(high) else np.ones(len(x), bool)
                kind |= (inside & over[f, low] if np.isfinite(low) else inside).astype(np.intp) << j
            rows = np.arange(1 << m)
            own = _of_leaf(value, share, (rows[:, None] >> np.arange(m) & 1).astype(float))
            for i, f in enumerate(names):
                phi[:, f] += own[:, i].take(kind)
            continue
        # a value that goes low at every split is inside where nothing bounds it from below
        inside = np.stack([((x[:, f] > path[f][0]) | (path[f][0] == -np.inf)) & (x[:, f] <= path[f][1]) for f in names], 1).astype(float) if m else np.zeros((len(x), 0))
        own = _of_leaf(value, share, inside)
        for i, f in enumerate(names):
            phi[:, f] += own[:, i]
    return phi, mean


def tree_shapley(model: DataFrame, rows: DataFrame, keys: list[str], features: list[str], row: str) -> DataFrame:
    """keys, row, mean (of the model, base included), phi (array, a value for each feature) of rows whose group has a model of trees.fit(); of boosting, in log-odds."""
    t, m = chunked(rows.select(*dict.fromkeys([*keys, row, *features])), model, keys)
    kinds, by, k = dict(rows.dtypes), [*keys, "__chunk"], len(features)

    def run(a: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        out = a[[*keys, row]].iloc[: len(a) if len(of) else 0].copy()
        of = of.sort_values("tree")
        leaves = [leaf for r in of[list(FIELDS)].to_dict("records") for leaf in paths(r)]
        phi, mean = shapley(matrix(a, features), leaves, k) if len(of) else (np.zeros((0, k)), 0.0)
        out["mean"] = mean + (float(of["base"].iloc[0]) if len(of) else 0.0)
        out["phi"] = pd.Series([p.tolist() for p in phi], out.index, dtype=object)
        return out

    return t.groupBy(*by).cogroup(m.groupBy(*by)).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"`{row}` {kinds[row]}", "mean double", "phi array<double>"]))


def summary(values: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, mean_abs, mean of row-wise values."""
    names = F.array(*[F.lit(f) for f in features])
    cells = values.select(*keys, F.posexplode("phi").alias("i", "v"))
    return cells.groupBy(*keys, F.get(names, F.col("i")).alias("feature")).agg(F.avg(F.abs("v")).alias("mean_abs"), F.avg("v").alias("mean"))
