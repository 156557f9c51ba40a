"""Logistic regression of all groups at once by Newton steps, each of which is one aggregate over the rows.

A step sums gradient and Hessian by group, so a group of any size is combined in its tasks before the shuffle; what is solved is one small system for each group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, d
from ..lineage import durable

ROUNDS, TOLERANCE = 15, 1e-8


def score(x: list[Column], beta: str = "beta") -> Column:
    """Intercept and slopes of an array column, applied."""
    z = F.get(F.col(beta), F.lit(0))
    for i, c in enumerate(x):
        z = z + F.get(F.col(beta), F.lit(i + 1)) * c
    return z


def fit(df: DataFrame, keys: list[str], x: list[Column], y: Column, ridge: float = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """keys, beta (intercept first), gradient (the largest part of it at the last step): least negative log-likelihood plus ridge / 2 x the slopes' squares.

    Groups with one class keep growing slopes, held only by the ridge. Rows with a null among x or y do not count.
    """
    p = len(x) + 1
    names = [f"__x{i}" for i in range(1, p)]
    rows = df.select(*keys, *[c.cast("double").alias(n) for c, n in zip(x, names, strict=True)], y.cast("double").alias("__y")).na.drop(subset=[*names, "__y"])
    cols = [d(1), *[F.col(n) for n in names]]
    kinds = dict(rows.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "beta array<double>", "gradient double"])

    def solve(batches):
        for t in batches:
            g, h, b = (np.stack(t[c].to_list()) if len(t) else np.zeros((0, n)) for c, n in (("__g", p), ("__h", p * p), ("beta", p)))
            hess = h.reshape(-1, p, p) + np.diag([1e-9] + [ridge + 1e-9] * (p - 1))
            grad = g - b * np.array([0.0] + [ridge] * (p - 1))
            move = np.linalg.solve(hess, grad[:, :, None])[:, :, 0] if len(t) else grad
            # a step that is too long for the quadratic to hold is cut
            move *= np.minimum(1, 5 / np.maximum(np.abs(move).max(1, initial=0), 1e-12))[:, None]
            out = t[keys].copy()
            out["beta"], out["gradient"] = list(b + move), np.abs(grad).max(1, initial=0)
            yield out

    beta = rows.groupBy(*keys).agg(F.array(*[d(0)] * p).alias("beta"))
    for k in range(rounds):
        q = d(1) / (d(1) + F.exp(-clip(score(cols[1:]), -35, 35)))
        t = rows.join(beta, keys).withColumn("__r", F.col("__y") - q).withColumn("__w", q * (d(1) - q))
        g = F.array(*[F.sum(F.col("__r") * c) for c in cols]).alias("__g")
        upper = {(i, j): F.sum(F.col("__w") * cols[i] * cols[j]) for i in range(p) for j in range(i, p)}
        h = F.array(*[upper[min(i, j), max(i, j)] for i in range(p) for j in range(p)]).alias("__h")
        beta = t.groupBy(*keys).agg(F.first("beta").alias("beta"), g, h).mapInPandas(solve, ddl)
        # one row for each group is kept, so that a step does not run those before it again
        beta = durable(beta)
        worst = beta.agg(F.max("gradient")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
        if k < rounds - 1:
            beta = beta.drop("gradient")
    return beta
