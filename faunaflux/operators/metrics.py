"""Grouped prediction metrics: one result row for each group of (keys, y, p) rows.

Rank metrics first count rows by distinct score, so that what is shuffled to a group's window is at most one row for each score;
everything else is one aggregate with map-side combination. A group whose data cannot carry a metric gets null, never a made-up value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, d, finite, logit

DIRECTIONS = {"roc_auc": "higher", "pr_auc": "higher", "average_precision": "higher", "boyce": "higher", "balanced_accuracy": "higher", "max_tss": "higher", "sensitivity": "higher", "specificity": "higher", "brier": "lower", "log_loss": "lower", "runtime": "lower", "calibration_slope": "closest_to_one", "calibration_intercept": "lower", "prevalence": "higher"}


def _scores(pred: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """keys, s, pos, n: counts by distinct score."""
    rows = pred.select(*keys, F.col(y).cast("int").alias("__y"), finite(p).alias("__s")).where("__y is not null and __s is not null")
    return rows.groupBy(*keys, "__s").agg(F.sum("__y").alias("__pos"), F.count("*").alias("__n"))


def _both(value: Column, pos: Column, total: Column) -> Column:
    return F.when((pos > 0) & (pos < total), value)


def roc_auc(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p", name: str = "roc_auc") -> DataFrame:
    """Mann-Whitney area with average ranks for ties; null where a class is missing."""
    w = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    t = _scores(pred, keys, y, p).withColumn("__below", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    pos, n = F.sum("__pos").cast("double"), F.sum("__n").cast("double")
    ranks = F.sum(F.col("__pos") * (F.col("__below") + (F.col("__n") + 1).cast("double") / 2))
    return t.groupBy(*keys).agg(_both((ranks - pos * (pos + 1) / 2) / (pos * (n - pos)), pos, n).alias(name))


def _descending(pred: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("__s"))
    all_ = Window.partitionBy(*keys)
    t = _scores(pred, keys, y, p)
    t = t.withColumn("__tp", F.sum("__pos").over(w).cast("double")).withColumn("__k", F.sum("__n").over(w).cast("double"))
    return t.withColumn("__pos_all", F.sum("__pos").over(all_).cast("double")).withColumn("__n_all", F.sum("__n").over(all_).cast("double"))


def average_precision(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p", name: str = "average_precision") -> DataFrame:
    t = _descending(pred, keys, y, p)
    total, n = F.max("__pos_all"), F.max("__n_all")
    return t.groupBy(*keys).agg(_both(F.sum(F.try_divide("__pos", "__pos_all") * F.col("__tp") / F.col("__k")), total, n).alias(name))


def pr_trapezoid(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p", name: str = "pr_trapezoid") -> DataFrame:
    """Area under precision by recall, by trapezoids from the point (0, 1)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("__s"))
    t = _descending(pred, keys, y, p).withColumn("__r", F.try_divide("__tp", "__pos_all")).withColumn("__q", F.col("__tp") / F.col("__k"))
    t = t.withColumn("__area", (F.col("__r") - F.coalesce(F.lag("__r").over(w), d(0))) * (F.col("__q") + F.coalesce(F.lag("__q").over(w), d(1))) / 2)
    return t.groupBy(*keys).agg(_both(F.sum("__area"), F.max("__pos_all"), F.max("__n_all")).alias(name))


def pr_auc(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p", method: str = "average_precision", name: str = "pr_auc") -> DataFrame:
    if method not in ("average_precision", "trapezoid"):
        raise ValueError(f"unknown method {method!r}")
    return (average_precision if method == "average_precision" else pr_trapezoid)(pred, keys, y, p, name)


def brier_expr(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p).cast("double") - F.col(y), 2))


def log_loss_expr(y: str = "y", p: str = "p", eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return -F.avg(F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(d(1) - q)))


def prevalence_expr(y: str = "y") -> Column:
    return F.avg((F.col(y) == 1).cast("double"))


def scoring_rules(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    return pred.groupBy(*keys).agg(brier_expr(y, p).alias("brier"), log_loss_expr(y, p).alias("log_loss"), prevalence_expr(y).alias("prevalence"))


def max_tss(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """max_tss and threshold: the highest threshold that reaches the largest tpr - fpr; null threshold without skill."""
    t = _descending(pred, keys, y, p).withColumn("__tss", F.try_divide("__tp", "__pos_all") - F.try_divide(F.col("__k") - F.col("__tp"), F.col("__n_all") - F.col("__pos_all")))
    best = F.max(F.struct("__tss", "__s"))
    ok = (F.max("__pos_all") > 0) & (F.max("__pos_all") < F.max("__n_all"))
    t = t.groupBy(*keys).agg(F.when(ok, best).alias("__b"))
    return t.select(*keys, F.when(F.col("__b.__tss") > 0, F.col("__b.__tss")).otherwise(F.when(F.col("__b").isNotNull(), d(0))).alias("max_tss"), F.when(F.col("__b.__tss") > 0, F.col("__b.__s")).alias("threshold"))


def sensitivity_specificity(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p", threshold: float | None = None) -> DataFrame:
    """sensitivity, specificity, balanced_accuracy at p >= threshold (that of max_tss if none is given)."""
    rows = pred.select(*keys, F.col(y).cast("int").alias("__y"), finite(p).alias("__s"))
    if threshold is None:
        cuts = max_tss(pred, keys, y, p).select(*keys, "threshold")
        rows = rows.join(cuts, keys)
    else:
        rows = rows.withColumn("threshold", d(threshold))
    hit = (F.col("__s") >= F.col("threshold")).cast("double")
    t = rows.groupBy(*keys).agg(F.avg(F.when(F.col("__y") == 1, hit)).alias("sensitivity"), F.avg(F.when(F.col("__y") == 0, d(1) - hit)).alias("specificity"))
    single = F.col("sensitivity").isNull() | F.col("specificity").isNull()
    t = t.withColumn("sensitivity", F.when(~single, F.col("sensitivity"))).withColumn("specificity", F.when(~single, F.col("specificity")))
    return t.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def continuous_boyce(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p", n_bins: int = 0, resolution: int = 100, remove_duplicates: bool = True, name: str = "boyce") -> DataFrame:
    """Spearman correlation of window midpoints and the ratio of presence to overall share, over moving windows, or over n_bins bins.

    Distinct scores are joined to window numbers by a computed range of numbers, so rows grow by the overlap of windows, not by their number times the rows.
    """
    counts = _scores(pred, keys, y, p)
    bounds = counts.groupBy(*keys).agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi"), F.sum("__pos").cast("double").alias("__pos_all"), F.sum("__n").cast("double").alias("__n_all"))
    if n_bins:
        bounds = bounds.withColumn("__width", (F.col("__hi") - F.col("__lo")) / n_bins).withColumn("__step", F.col("__width")).withColumn("__last", F.lit(n_bins - 1))
    else:
        bounds = bounds.withColumn("__width", (F.col("__hi") - F.col("__lo")) / 10).withColumn("__step", (F.col("__hi") - F.col("__lo") - F.col("__width")) / resolution).withColumn("__last", F.lit(resolution))
    start = F.col("__lo") + F.col("__i") * F.col("__step")
    stop = start + F.col("__width") + F.when(F.col("__i") == F.col("__last"), d(1e-12)).otherwise(d(0))
    t = counts.join(bounds, keys).where("__hi > __lo and __pos_all > 0")
    low = F.greatest(F.floor(F.try_divide(F.col("__s") - F.col("__lo") - F.col("__width"), F.col("__step"))) - 1, F.lit(0))
    high = F.least(F.floor(F.try_divide(F.col("__s") - F.col("__lo"), F.col("__step"))) + 1, F.col("__last"))
    t = t.withColumn("__i", F.explode(F.sequence(low.cast("int"), high.cast("int")))).where((F.col("__s") >= start) & (F.col("__s") <= stop))
    t = t.groupBy(*keys, "__i").agg(F.try_divide(F.try_divide(F.sum("__pos"), F.max("__pos_all")), F.try_divide(F.sum("__n"), F.max("__n_all"))).alias("__f"), F.max((F.col("__lo") + F.col("__i") * F.col("__step") + F.col("__width") / 2)).alias("__mid"))
    by_place = Window.partitionBy(*keys).orderBy("__i")
    if remove_duplicates:
        t = t.withColumn("__next", F.lead("__f").over(by_place)).where("__next is null or __f != __next")
    for c in ("__f", "__mid"):
        w, same = Window.partitionBy(*keys).orderBy(c), Window.partitionBy(*keys, c)
        t = t.withColumn(f"__r{c}", F.rank().over(w) + (F.count("*").over(same) - 1).cast("double") / 2)
    return bounds.select(*keys).join(t.groupBy(*keys).agg(F.when(F.count("*") > 2, F.corr("__r__mid", "__r__f")).alias(name)), keys, "left")


def miller_calibration(pred: DataFrame, keys: list[str], y: str = "y", p: str = "p", eps: float = 1e-6) -> DataFrame:
    """calibration_intercept and calibration_slope of each group: y on logit(p). Counts by distinct score are what a group brings together."""
    rows = _scores(pred.withColumn(p, finite(p)), keys, y, p).withColumn("__z", logit("__s", eps))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "calibration_intercept double", "calibration_slope double"])

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        z, pos, n = t["__z"].to_numpy(float), t["__pos"].to_numpy(float), t["__n"].to_numpy(float)
        out = None
        if n.sum() >= 3 and 0 < pos.sum() < n.sum() and np.ptp(z) > 0:
            x = np.concatenate([z, z])
            out = irls_logistic(x, np.concatenate([np.ones_like(z), np.zeros_like(z)]), np.concatenate([pos, n - pos]))
        return pd.DataFrame({**{k: [t[k].iloc[0]] for k in keys}, "calibration_intercept": [out[0] if out else None], "calibration_slope": [out[1] if out else None]})

    return rows.groupBy(*keys).applyInPandas(fit, schema)


def irls_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100, tol: float = 1e-10) -> tuple[float, float] | None:
    """Intercept and slope of a weighted logistic regression by reweighted least squares; None where it is singular."""
    a, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        w = weight * np.maximum(mu * (1 - mu), 1e-12)
        try:
            step = np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (weight * (y - mu)))
        except np.linalg.LinAlgError:
            return None
        beta = beta + step
        if np.abs(step).max() < tol:
            return float(beta[0]), float(beta[1])
    return (float(beta[0]), float(beta[1])) if np.isfinite(beta).all() else None


METRICS = ("roc_auc", "pr_auc", "calibration_slope", "calibration_intercept", "brier", "log_loss", "prevalence", "boyce", "max_tss", "sensitivity", "specificity", "balanced_accuracy")
PUBLISHED = ("roc_auc", "pr_auc", "calibration_slope")


def validate_metric_names(names) -> list[str]:
    for n in names:
        if n not in METRICS:
            raise KeyError(f"unknown metric {n!r}; known: {', '.join(METRICS)}")
    return list(names)


def compute_metrics(pred: DataFrame, keys: list[str], metrics=PUBLISHED, strict: bool = False) -> DataFrame:
    """One row for each group with the asked metrics; unknown names are left out unless strict."""
    names = validate_metric_names(metrics) if strict else [m for m in metrics if m in METRICS]
    out = pred.select(*keys).distinct()
    parts = []
    if "roc_auc" in names:
        parts.append(roc_auc(pred, keys))
    if "pr_auc" in names:
        parts.append(pr_auc(pred, keys))
    if {"brier", "log_loss", "prevalence"} & set(names):
        parts.append(scoring_rules(pred, keys))
    if "boyce" in names:
        parts.append(continuous_boyce(pred, keys))
    if "max_tss" in names:
        parts.append(max_tss(pred, keys).drop("threshold"))
    if {"sensitivity", "specificity", "balanced_accuracy"} & set(names):
        parts.append(sensitivity_specificity(pred, keys))
    if {"calibration_slope", "calibration_intercept"} & set(names):
        parts.append(miller_calibration(pred, keys))
        names = list(dict.fromkeys([*names, "calibration_intercept"]))  # the slope brings its intercept
    for t in parts:
        out = out.join(t, keys, "left")
    return out.select(*keys, *names)
