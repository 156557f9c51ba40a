"""Training objectives as grouped aggregates over rows (keys, z: logit, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, d


def _ce(z: str, y: str) -> Column:
    """Cross entropy of a logit, in the form that does not overflow."""
    v = F.col(z).cast("double")
    return F.greatest(v, d(0)) - v * F.col(y) + F.ln(d(1) + F.exp(-F.abs(v)))


def bce(df: DataFrame, keys: list[str], z: str = "z", y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(_ce(z, y)).alias("loss"))


def weighted_bce(df: DataFrame, keys: list[str], z: str = "z", y: str = "y", positive: float = 1.0, negative: float = 1.0) -> DataFrame:
    w = F.when(F.col(y) == 1, d(positive)).otherwise(d(negative))
    return df.groupBy(*keys).agg((F.sum(w * _ce(z, y)) / F.sum(w)).alias("loss"))


def focal(df: DataFrame, keys: list[str], z: str = "z", y: str = "y", gamma: float = 2.0) -> DataFrame:
    loss = _ce(z, y)
    return df.groupBy(*keys).agg(F.avg(F.pow(d(1) - F.exp(-loss), gamma) * loss).alias("loss"))


def pairwise_ranking(df: DataFrame, keys: list[str], z: str = "z", y: str = "y", margin: float = 1.0) -> DataFrame:
    """Mean hinge over all pairs of a presence and a background row of a group; null where a class is missing.

    A pair counts where the background row is above the presence less the margin, so running counts and sums of sorted distinct scores give the mean
    without a pair: no row of either class is left out, and none meets another.
    """
    v = F.col(z).cast("double")
    # presences stand at their score less the margin, where what is above them in the background is what they lose to
    rows = df.select(*keys, F.when(F.col(y) == 1, v - d(margin)).otherwise(v).alias("__v"), (F.col(y) == 1).cast("long").alias("__pos"), (F.col(y) == 0).cast("long").alias("__neg"))
    at = rows.groupBy(*keys, "__v").agg(F.sum("__pos").alias("__p"), F.sum("__neg").alias("__n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__v")).rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("__c", F.coalesce(F.sum("__n").over(above), F.lit(0))).withColumn("__s", F.coalesce(F.sum(F.col("__v") * F.col("__n")).over(above), d(0)))
    lost = F.sum(F.col("__p") * (F.col("__s") - F.col("__v") * F.col("__c")))
    return at.groupBy(*keys).agg((lost / F.nullif(F.sum("__p").cast("double") * F.sum("__n"), d(0))).alias("loss"))


def maxent(df: DataFrame, keys: list[str], z: str = "z", y: str = "y", beta: float = 0.0) -> DataFrame:
    """Mean score of presences against the log mean exponential of the background."""
    top = df.where(F.col(y) == 0).groupBy(*keys).agg(F.max(z).alias("__top"))
    t = df.join(top, keys)
    lse = F.col("__t") + F.ln(F.col("__e")) - F.ln(F.col("__n"))
    g = t.groupBy(*keys).agg(F.avg(F.when(F.col(y) == 1, F.col(z))).alias("__p"), F.max("__top").alias("__t"), F.sum(F.when(F.col(y) == 0, F.exp(F.col(z) - F.col("__top")))).alias("__e"), F.count_if(F.col(y) == 0).cast("double").alias("__n"), F.avg(F.col(z) * F.col(z)).alias("__q"))
    return g.select(*keys, (-F.col("__p") + lse + d(beta) * F.col("__q")).alias("loss"))


def poisson(df: DataFrame, keys: list[str], z: str = "z", y: str = "y", area: float = 1.0) -> DataFrame:
    """Point-process likelihood with log intensity z, which is clamped at 30 inside the exponential only; quadrature weights 1e-6 at presences, area / n elsewhere. 0 without background."""
    n = df.groupBy(*keys).agg(F.count_if(F.col(y) == 0).cast("double").alias("__n"))
    q = F.when(F.col(y) == 1, d(1e-6)).otherwise(d(area) / F.nullif("__n", d(0)))
    loss = F.avg(q * F.exp(clip(z, -30, 30)) - F.col(y) * F.col(z))
    return df.join(n, keys).groupBy(*keys).agg(F.when(F.first("__n") == 0, d(0)).otherwise(loss).alias("loss"))


def deep_maxent(df: DataFrame, keys: list[str], species: str, z: str = "z", y: str = "y", penalty: float = 0.0) -> DataFrame:
    """Mean over species of the log mean exponential of the background less the mean score of presences, plus a penalty on squares.

    Scores are clamped at 30. Species of one row do not count, species without one of the classes count 0.
    """
    v = clip(z, -30, 30)
    none = F.col(y) == 0
    g = df.groupBy(*keys, species).agg(F.count("*").alias("__n"), F.ln(F.sum(F.when(none, F.exp(v))) / F.count_if(none)).alias("__l"), F.avg(F.when(F.col(y) == 1, v)).alias("__p"), F.avg(v * v).alias("__q"))
    loss = F.coalesce(F.col("__l") - F.col("__p") + d(penalty) * F.col("__q"), d(0))
    return g.where("__n >= 2").groupBy(*keys).agg(F.avg(loss).alias("loss"))


def point_probability(z: str = "z") -> Column:
    """Probability of at least one point, for the Poisson objective."""
    return d(1) - F.exp(-F.exp(clip(z, -30, 30)))


#: What an objective takes background for, and what it gives.
INFO = {
    "bce": ("absence", "probability"),
    "weighted-bce": ("absence", "probability"),
    "focal": ("absence", "score"),
    "pairwise-ranking": ("unlabelled", "rank"),
    "maxent": ("background", "relative intensity"),
    "poisson": ("quadrature", "intensity"),
    "deepmaxent": ("background", "relative intensity"),
}
