"""Feature summaries of series and patches, and fusion of modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import d, finite


def temporal_summary(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """mean, sd (population), min, max, first, last and slope on the place 0..T-1 of each series; what is not finite is 0."""
    w = Window.partitionBy(key).orderBy(time)
    t = df.select(key, time, F.coalesce(finite(value), d(0)).alias("v")).withColumn("i", (F.row_number().over(w) - 1).cast("double"))
    return t.groupBy(key).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"), F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"), F.coalesce(F.regr_slope("v", "i"), d(0)).alias("slope"))


def patch_statistics(df: DataFrame, key: str, array: str) -> DataFrame:
    """mean, sd (population), min, max and median of an array column, row by row; what is not finite is 0."""
    x = F.transform(F.col(array), lambda v: F.coalesce(finite(v), d(0)))
    t = df.select(key, x.alias("a")).withColumn("n", F.size("a"))
    add = lambda a: F.aggregate(a, d(0), lambda s, v: s + v)
    t = t.withColumn("mean", F.try_divide(add(F.col("a")), F.col("n"))).withColumn("s", F.array_sort("a"))
    sd = F.sqrt(add(F.transform("a", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / F.nullif(F.col("n"), F.lit(0)))
    median = (F.get("s", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("s", F.floor(F.col("n") / 2).cast("int"))) / 2
    return t.select(key, "mean", sd.alias("sd"), F.array_min("a").alias("min"), F.array_max("a").alias("max"), median.alias("median"))


def combine_scales(scales: list[Column], mode: str) -> Column:
    """Arrays of several scales as one: concat, mean, max, or attention (softmax over their lengths as vectors)."""
    if mode == "concat":
        return F.concat(*scales)
    total = lambda f: F.transform(scales[0], lambda _, i: f([F.get(s, i) for s in scales]))
    if mode == "mean":
        return total(lambda v: sum(v[1:], v[0]) / len(v))
    if mode == "max":
        return total(lambda v: F.greatest(*v)) if len(scales) > 1 else scales[0]
    if mode == "attention":
        norm = [F.sqrt(F.aggregate(s, d(0), lambda a, v: a + v.cast("double") * v)) for s in scales]
        top = F.greatest(*norm) if len(norm) > 1 else norm[0]
        e = [F.exp(n - top) for n in norm]
        z = sum(e[1:], e[0])
        return total(lambda v: sum((x * (w / z) for x, w in zip(v[1:], e[1:], strict=True)), v[0] * (e[0] / z)))
    raise ValueError(f"unknown mode {mode!r}")


def concat_fusion(modalities: dict[str, Column]) -> Column:
    """Arrays one after the other, in order of modality names."""
    return F.concat(*[modalities[m].cast("array<double>") for m in sorted(modalities)])


def modality_weights(auc: dict[str, float]) -> dict[str, float]:
    """Late fusion: skill above chance, as shares; equal where none has any."""
    skill = {m: max(a - 0.5, 0.0) for m, a in auc.items()}
    total = sum(skill.values())
    return {m: s / total if total else 1 / len(skill) for m, s in skill.items()}


def block_weights(auc: dict[str, float]) -> dict[str, float]:
    """Weighted fusion: 0 at chance to 1 at certainty."""
    return {m: min(1.0, max(0.0, 2 * (a - 0.5))) for m, a in auc.items()}


def fast_ica(df: DataFrame, keys: list[str], columns: list[str], k: int, rounds: int = 500, seed: int = 32639) -> DataFrame:
    """keys, component, column, weight: FastICA (log-cosh, symmetric) of each group, which one task holds."""
    import numpy as np
    import pandas as pd

    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in keys), "component int", "column string", "weight double"])

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        x = t[columns].to_numpy(float)
        x = x - x.mean(0)
        _, s, vt = np.linalg.svd(x, full_matrices=False)
        n = min(k, int((s > 1e-12 * max(s[0], 1e-300)).sum()))
        white = vt[:n].T / s[:n] * np.sqrt(len(x))
        z = x @ white
        w = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
        for _ in range(rounds):
            g = np.tanh(z @ w.T)
            new = g.T @ z / len(z) - (1 - g**2).mean(0)[:, None] * w
            u, _, v = np.linalg.svd(new)
            new = u @ v
            done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-6
            w = new
            if done:
                break
        full = w @ white.T
        rows = [(*[t[c].iloc[0] for c in keys], i, c, float(full[i, j])) for i in range(n) for j, c in enumerate(columns)]
        return pd.DataFrame(rows, columns=[*keys, "component", "column", "weight"])

    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(fit, schema)
