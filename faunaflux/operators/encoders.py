"""Encoders of modalities and strategies that fuse them, fitted on training rows and applied to any.

A modality is a DataFrame with a row key and its columns; what an encoder gives is (key, value: array of doubles). Kinds and rows are checked, what is trainable
must be fitted before it is applied, and what it was fitted on is on record.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import d, finite
from ..schemas import DataError
from . import features, grouped, learners, metrics, mixture, recipe
from .modalities import KINDS


class Encoder:
    """Subclasses give learn(df) and apply(df)."""

    name, accepts, trainable = "encoder", ("tabular",), False

    def __init__(self, key: str, columns: list[str], **params):
        self.key, self.columns, self.params, self.fitted_on = key, list(columns), params, "none"

    def fit(self, df: DataFrame, kind: str = "tabular") -> Encoder:
        self._check(df, kind)
        self.learn(df)
        if self.trainable:
            self.fitted_on = "train"
        return self

    def transform(self, df: DataFrame, kind: str = "tabular") -> DataFrame:
        """key, value."""
        self._check(df, kind)
        if self.trainable and self.fitted_on == "none":
            raise DataError(f"{self.name} must be fitted on training rows first")
        return self.apply(df)

    def fit_transform(self, df: DataFrame, kind: str = "tabular") -> DataFrame:
        return self.fit(df, kind).transform(df, kind)

    def describe(self) -> dict:
        return {"encoder": self.name, "accepts": list(self.accepts), "trainable": self.trainable, "fitted_on": self.fitted_on, "columns": self.columns, "params": dict(self.params)}

    def learn(self, df: DataFrame) -> None:
        """What is not trainable learns nothing."""

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _check(self, df: DataFrame, kind: str) -> None:
        if kind not in KINDS:
            raise DataError(f"unknown kind {kind!r}")
        if kind not in self.accepts:
            raise DataError(f"{self.name} takes {', '.join(self.accepts)}, not {kind}")
        if missing := [c for c in (self.key, *self.columns) if c not in df.columns]:
            raise DataError(f"missing columns: {', '.join(missing)}")

    def _array(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, F.array(*[F.coalesce(finite(c), d(0)) for c in self.columns]).alias("value"))


class Raw(Encoder):
    """The columns as they are; what is missing is 0."""

    name, accepts = "raw", ("tabular",)

    def apply(self, df):
        return self._array(df)


class Standardized(Encoder):
    """z-scores by the training rows."""

    name, trainable = "standardized", True

    def learn(self, df):
        self.moments = df.agg(*[f(finite(c)).alias(f"{n}{i}") for i, c in enumerate(self.columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()

    def apply(self, df):
        m = self.moments
        z = [F.coalesce((finite(c) - d(m[f"m{i}"] or 0.0)) / d(m[f"s{i}"] or 1.0), d(0)) for i, c in enumerate(self.columns)]
        return df.select(self.key, F.array(*z).alias("value"))


class Categorical(Encoder):
    """One 0 or 1 for each level of each column in training rows; a level that they did not have is all 0."""

    name, accepts, trainable = "categorical", ("categorical", "tabular"), True
    MOST_LEVELS = 10_000

    def learn(self, df):
        seen = recipe.levels(df, [], self.columns, self.key).orderBy("column", "level").limit(self.MOST_LEVELS + 1).collect()
        if len(seen) > self.MOST_LEVELS:
            raise DataError(f"more than {self.MOST_LEVELS} levels")
        self.levels = [(r.column, r.level) for r in seen]

    def apply(self, df):
        return df.select(self.key, F.array(*[F.coalesce((F.col(c).cast("string") == v).cast("double"), d(0)) for c, v in self.levels]).cast("array<double>").alias("value"))


class Pca(Encoder):
    """Projections on the training rows' main axes."""

    name, trainable = "pca", True

    def learn(self, df):
        from pyspark.ml.feature import PCA

        self.scale = Standardized(self.key, self.columns).fit(df)
        k = min(self.params.get("k", 10), len(self.columns))
        self.model = PCA(k=k, inputCol="v", outputCol="p").fit(self._vectors(df))
        self.explained = list(map(float, self.model.explainedVariance))

    def _vectors(self, df):
        from pyspark.ml.functions import array_to_vector

        return self.scale.transform(df).select(self.key, array_to_vector("value").alias("v"))

    def apply(self, df):
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(self._vectors(df)).select(self.key, vector_to_array("p").alias("value"))


class IdentityEmbedding(Encoder):
    """A precomputed array column."""

    name, accepts = "identity-embedding", ("embedding",)

    def apply(self, df):
        return df.select(self.key, F.transform(F.col(self.columns[0]).cast("array<double>"), lambda v: F.coalesce(finite(v), d(0))).alias("value"))


class PatchStatistics(Encoder):
    """Mean, deviation, extremes and median of each scale's patch; scales are columns, combined by mode."""

    name, accepts = "patch-statistics", ("raster",)

    def apply(self, df):
        parts = []
        for i, c in enumerate(self.columns):
            s = features.patch_statistics(df, self.key, c)
            parts.append(s.select(self.key, F.array(*[F.coalesce(x, d(0)) for x in ("mean", "sd", "min", "max", "median")]).alias(f"s{i}")))
        t = reduce(lambda a, b: a.join(b, self.key), parts)
        return t.select(self.key, features.combine_scales([F.col(f"s{i}") for i in range(len(parts))], self.params.get("mode", "concat")).alias("value"))


class TemporalSummary(Encoder):
    """Eight figures of each series: rows (key, time, value columns)."""

    name, accepts = "temporal-summary", ("sequence",)

    def apply(self, df):
        time, value = self.columns
        t = features.temporal_summary(df, self.key, time, value)
        return t.select(self.key, F.array(*[F.col(c).cast("double") for c in ("n", "mean", "sd", "min", "max", "first", "last", "slope")]).alias("value"))


class Fusion:
    """Several encoded modalities (key, value) as one; their keys must be the same in all of them, once each. Modalities keep the order of fitting; absent ones drop out, new ones come last."""

    name, trainable, supervised = "fusion", False, False

    def __init__(self, key: str, **params):
        self.key, self.params, self.fitted_on, self.order, self.weights = key, params, "none", [], {}

    def fit(self, encoded: dict[str, DataFrame], y: DataFrame | None = None) -> Fusion:
        """y: key, occ of training rows."""
        self._check(encoded)
        if self.supervised and y is None:
            raise DataError(f"{self.name} needs labels")
        self.order = sorted(encoded)
        self.learn(encoded, y)
        if self.trainable:
            self.fitted_on = "train"
        return self

    def transform(self, encoded: dict[str, DataFrame]) -> DataFrame:
        """key, value."""
        self._check(encoded)
        if self.trainable and self.fitted_on == "none":
            raise DataError(f"{self.name} must be fitted on training rows first")
        names = [n for n in self.order if n in encoded] + [n for n in sorted(encoded) if n not in self.order]
        t = reduce(lambda a, b: a.join(b, self.key), [encoded[n].select(self.key, F.col("value").alias(f"v_{n}")) for n in names])
        return self.apply(t, names)

    def learn(self, encoded, y) -> None:
        """What is not trainable learns nothing."""

    def apply(self, t: DataFrame, names: list[str]) -> DataFrame:
        return t.select(self.key, F.concat(*[F.col(f"v_{n}") for n in names]).alias("value"))

    def modality_importance(self) -> dict[str, float]:
        return dict(self.weights)

    def _check(self, encoded) -> None:
        if not encoded:
            raise DataError("fusion needs a modality")
        # one pass over all keys: each must come once from every modality
        keys = reduce(DataFrame.unionByName, [df.select(F.col(self.key).alias("k"), F.lit(n).alias("n")) for n, df in encoded.items()])
        uneven = keys.groupBy("k").agg(F.count("*").alias("rows"), F.count_distinct("n").alias("names")).where((F.col("rows") != len(encoded)) | (F.col("names") != len(encoded)) | F.col("k").isNull())
        if odd := uneven.limit(3).collect():
            raise DataError(f"modalities have other rows, or rows more than once: {', '.join(str(r.k) for r in odd)}")

    def _skill(self, encoded, y) -> dict[str, float]:
        """Area under the curve of a learner on each modality alone, on training rows."""
        out = {}
        for n, df in encoded.items():
            width = df.agg(F.max(F.size("value"))).first()[0] or 0
            flat = df.select(self.key, *[F.get("value", F.lit(i)).alias(f"f{i}") for i in range(width)]).join(y.select(self.key, "occ"), self.key).withColumn("g", F.lit(1))
            p = learners.logistic(flat, flat, ["g"], [f"f{i}" for i in range(width)], self.key).join(flat.select(self.key, F.col("occ").alias("y")), self.key)
            out[n] = metrics.roc_auc(p, ["g"]).first()["roc_auc"] or 0.5
        return out


class Concat(Fusion):
    name = "concat"


class Early(Fusion):
    """Concatenation of z-scores, by the training rows; a modality that they did not have comes as it is."""

    name, trainable = "early", True

    def learn(self, encoded, y):
        self.moments = {}
        for n, df in encoded.items():
            t = df.select(F.posexplode("value").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
            self.moments[n] = [(r.m, r.s or 1.0) for r in t.orderBy("i").collect()]  # a row for each dimension

    def apply(self, t, names):
        scaled = lambda n: F.array(*[(F.get(f"v_{n}", F.lit(i)) - d(m)) / d(s) for i, (m, s) in enumerate(self.moments[n])])
        return t.select(self.key, F.concat(*[scaled(n) if n in self.moments else F.col(f"v_{n}") for n in names]).alias("value"))


class Weighted(Fusion):
    """Concatenation of blocks, each times its skill: 0 at chance, 1 at certainty."""

    name, trainable, supervised = "weighted", True, True

    def learn(self, encoded, y):
        self.weights = features.block_weights(self._skill(encoded, y))

    def apply(self, t, names):
        return t.select(self.key, F.concat(*[F.transform(f"v_{n}", lambda x, w=self.weights.get(n, 1.0): x * d(w)) for n in names]).alias("value"))


class Late(Fusion):
    """A learner for each modality, fitted once; value is the one probability, the mean of those of the modalities that are there, weighed by skill above chance."""

    name, trainable, supervised = "late", True, True

    def learn(self, encoded, y):
        self.weights = features.modality_weights(self._skill(encoded, y))
        self.models = {}
        for n, df in encoded.items():
            width = df.agg(F.max(F.size("value"))).first()[0] or 0
            cols = [f"f{i}" for i in range(width)]
            self.models[n] = (cols, learners.logistic_fit(self._flat(df, "value", cols).join(y.select(self.key, "occ"), self.key), ["g"], cols))

    def _flat(self, t, value, cols):
        return t.select(self.key, *[F.get(value, F.lit(i)).alias(c) for i, c in enumerate(cols)]).withColumn("g", F.lit(1))

    def apply(self, t, names):
        names = [n for n in names if n in self.models]
        if not names:
            raise DataError("late fusion has no modality that it was fitted on")
        total, out = max(sum(self.weights[n] for n in names), 1e-12), None
        for n in names:
            cols, model = self.models[n]
            p = learners.logistic_apply(model, self._flat(t, f"v_{n}", cols), ["g"], cols, self.key).select(self.key, (F.col("p") * d(self.weights[n] / total)).alias("p"))
            out = p if out is None else out.unionByName(p)
        return out.groupBy(self.key).agg(F.array(F.sum("p")).alias("value"))


class Gated(Fusion):
    """A logistic expert for each modality and a softmax gate that sees all of them, row by row; value is the one probability. The importance of a modality is its mean gate."""

    name, trainable, supervised = "gated", True, True

    def views(self, widths: list[int]) -> list[list[int]]:
        ends = [sum(widths[:i]) for i in range(len(widths) + 1)]
        return [list(range(a, b)) for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, encoded, y):
        widths = [encoded[n].agg(F.max(F.size("value"))).first()[0] or 0 for n in self.order]
        self.learner = mixture.Mixture(self.views(widths), **{k: v for k, v in self.params.items() if k in ("rounds", "ridge", "seed", "tolerance")})
        self.cols = [(n, i, f"x{k}_{i}") for k, (n, w) in enumerate(zip(self.order, widths, strict=True)) for i in range(w)]
        t = reduce(lambda a, b: a.join(b, self.key), [encoded[n].select(self.key, F.col("value").alias(f"v_{n}")) for n in self.order])
        flat = self._flat(t)
        self.model = grouped.fit(flat.join(y.select(self.key, "occ"), self.key), ["g"], [c for *_, c in self.cols], self.learner)
        beta, learner, cols = list(self.model.first()["beta"]), self.learner, [c for *_, c in self.cols]

        def gates(batches):
            for b in batches:
                yield pd.DataFrame(learner.gates(np.array(beta), b[cols].to_numpy(float)), columns=[f"g{i}" for i in range(len(learner.views))])

        n = len(self.learner.views)
        means = flat.select(*cols).mapInPandas(gates, ", ".join(f"g{i} double" for i in range(n))).agg(*[F.avg(f"g{i}").alias(f"g{i}") for i in range(n)]).first()
        self.weights = self._named([means[f"g{i}"] for i in range(n)])

    def _named(self, means):
        return dict(zip(self.order, means, strict=True))

    def _flat(self, t):
        return t.select(self.key, *[F.get(f"v_{n}", F.lit(i)).alias(c) for n, i, c in self.cols]).withColumn("g", F.lit(1))

    def apply(self, t, names):
        if missing := [n for n in self.order if n not in names]:
            raise DataError(f"{self.name} needs all modalities that it was fitted on: {', '.join(missing)}")
        return grouped.apply(self.model, self._flat(t), ["g"], [c for *_, c in self.cols], self.key, self.learner).select(self.key, F.array("p").alias("value"))


class MixtureOfExperts(Gated):
    """Logistic experts that all see every modality, and a softmax gate; the importance is that of experts."""

    name = "moe"

    def views(self, widths):
        return [list(range(sum(widths)))] * self.params.get("experts", 4)

    def _named(self, means):
        return {f"expert{i}": m for i, m in enumerate(means)}


ENCODERS = {c.name: c for c in (Raw, Standardized, Categorical, Pca, IdentityEmbedding, PatchStatistics, TemporalSummary)}
FUSIONS = {c.name: c for c in (Concat, Early, Weighted, Late, Gated, MixtureOfExperts)}
