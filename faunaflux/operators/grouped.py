"""Fits of all groups at once whose every step is a sum (or greatest value) over rows: small groups side by side within tasks, large ones by sums that Spark adds.

A learner asks its data for totals of a function of rows and never sees where they are: up to ONE_TASK values (rows x features) of a group are one task's, beyond that every batch sends its part and
the rows stay in their partitions. What it gives is one array of numbers, the group's row in the model table.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import d, finite
from ..lineage import durable
from .trees import ONE_TASK, chunked, numbers

BATCH = 1 << 13  # rows at a time within a task


class Info(NamedTuple):
    """Of a group's training rows: means, deviations (population), least and greatest values of the features; rows of each class."""

    mean: np.ndarray
    sd: np.ndarray
    low: np.ndarray
    high: np.ndarray
    presences: float
    background: float


class Here:
    """Rows in memory."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, info: Info):
        self.x, self.y, self.w, self.info = x, y, w, info

    def total(self, of, greatest: bool = False) -> np.ndarray:
        """The sum, or greatest values, of of(x, y, w) over batches: a learner makes hundreds of columns of a row."""
        total = None
        for i in range(0, max(len(self.x), 1), BATCH):
            part = of(*(v[i : i + BATCH] for v in (self.x, self.y, self.w)))
            total = part if total is None else np.maximum(total, part) if greatest else total + part
        return total


class There:
    """Rows of a table (x, y, w)."""

    def __init__(self, table: DataFrame, info: Info):
        self.table, self.info, self.width = table, info, len(info.mean)

    def total(self, of, greatest: bool = False) -> np.ndarray:
        """The sum, or greatest values, of of(x, y, w) over all batches."""
        width = self.width

        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy().reshape(-1, width)
                    part = of(x, b.column("y").to_numpy(), b.column("w").to_numpy())
                    total = part if total is None else np.maximum(total, part) if greatest else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel()), pa.array([",".join(map(str, total.shape))] * total.size)], ["cell", "value", "shape"])

        found = self.table.mapInArrow(run, "cell long, value double, shape string").groupBy("cell", "shape").agg((F.max if greatest else F.sum)("value").alias("value")).collect()
        out = np.zeros([int(n) for n in found[0]["shape"].split(",") if n])
        out.ravel()[[r["cell"] for r in found]] = [r["value"] for r in found]
        return out


def _info(r, k: int) -> Info:
    return Info(*(np.array([float(r[f"__{n}{i}"] if r[f"__{n}{i}"] is not None else 0.0) for i in range(k)]) for n in ("m", "s", "l", "h")), float(r["__p"]), float(r["__b"]))


def fit(train: DataFrame, keys: list[str], features: list[str], learner, y: str = "occ", weight: Column | None = None, one_task: int | None = None) -> DataFrame:
    """keys, beta (what learner.fit(data) gives): missing and non-finite values count as the group's mean."""
    stats = [f(finite(x)).alias(f"__{n}{i}") for i, x in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("l", F.min), ("h", F.max))]
    info = durable(train.groupBy(*keys).agg(*stats, F.count_if(F.col(y) == 1).alias("__p"), F.count_if(F.col(y) != 1).alias("__b")))
    x = F.array(*[F.coalesce(finite(c), F.col(f"__m{i}"), d(0)) for i, c in enumerate(features)])
    one_task = ONE_TASK // max(1, len(features)) if one_task is None else one_task
    rows = train.join(info, keys).select(*keys, "__p", "__b", x.alias("x"), (F.col(y) == 1).cast("double").alias("y"), (weight if weight is not None else d(1)).cast("double").alias("w"))
    kinds, k = dict(train.dtypes), len(features)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "beta array<double>"])
    small = F.col("__p") + F.col("__b") <= one_task

    def one(t: pa.Table, of: pa.Table) -> pa.Table:
        x = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, k)
        beta = learner.fit(Here(x, numbers(t, "y"), numbers(t, "w"), _info(of.to_pylist()[0], k)))
        return pa.table([*(of.column(c) for c in keys), pa.array([beta.tolist()], pa.list_(pa.float64()))], [*keys, "beta"])

    parts = 4 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work on few bytes
    own = rows.where(small).select(*keys, "x", "y", "w").repartition(parts, *keys)
    of = info.na.drop(subset=keys).where(small).select(*[F.col(f"`{c}`").alias(c) for c in info.columns]).repartition(parts, *keys)
    found = own.groupBy(*keys).cogroup(of.groupBy(*keys)).applyInArrow(one, schema)
    for g in info.where(~small).toLocalIterator():  # few: each has more rows than a task takes
        own = rows
        for c in keys:
            own = own.where(F.col(c).eqNullSafe(F.lit(g[c])))
        beta = learner.fit(There(durable(own.select("x", "y", "w")), _info(g, k)))
        found = found.unionByName(train.sparkSession.createDataFrame([(*[g[c] for c in keys], [float(v) for v in beta])], schema))
    return durable(found)


def apply(model: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, learner) -> DataFrame:
    """keys, row, p of all rows of test whose group has a model."""
    t, m = chunked(test.select(*dict.fromkeys([*keys, row, *features])), model, keys)
    kinds, by = dict(test.dtypes), [*keys, "__chunk"]

    def score(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*keys, row]].iloc[: len(rows) if len(of) else 0].copy()
        if len(of):
            x = rows[features].to_numpy(float)
            x, beta = np.where(np.isfinite(x), x, np.nan), np.asarray(of["beta"].iloc[0])
            out["p"] = np.concatenate([learner.predict(beta, x[i : i + BATCH]) for i in range(0, max(len(x), 1), BATCH)])
        else:
            out["p"] = pd.Series(dtype=float)
        return out

    return t.groupBy(*by).cogroup(m.groupBy(*by)).applyInPandas(score, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"`{row}` {kinds[row]}", "p double"]))
