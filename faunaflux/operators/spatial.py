"""Distance joins, spatial folds and residual grids.

A distance semi-join turns into an equi-join: both sides are put into grid cells as wide as the distance (in three dimensions on the unit sphere for
longitude and latitude, so there is no seam and no pole), the reference side into its 3x3 or 3x3x3 neighbourhood, and the exact distance is
checked on what meets. The reference's distinct points are counted by cell only through the join itself; there is no cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_RADIUS_M, SEED, chord, d, md5_order, unit_sphere

BUFFER_M = 10_000.0
SLACK = 1e-12


def _metric(df: DataFrame, x: str, y: str, geographic: bool) -> tuple[DataFrame, list[str]]:
    if not geographic:
        return df.withColumn("__a", F.col(x).cast("double")).withColumn("__b", F.col(y).cast("double")), ["__a", "__b"]
    a, b, c = unit_sphere(x, y)
    return df.withColumn("__a", a).withColumn("__b", b).withColumn("__c", c), ["__a", "__b", "__c"]


def within_distance(query: DataFrame, reference: DataFrame, distance_m: float, *, on: list[str] | None = None, x: str = "x", y: str = "y", geographic: bool = False, radius_m: float = EARTH_RADIUS_M, how: str = "left_semi") -> DataFrame:
    """Rows of query with (left_semi) or without (left_anti) a reference row within the distance, inclusive, among rows that agree on `on`."""
    if how not in ("left_semi", "left_anti"):
        raise ValueError(f"unknown join {how!r}")
    on = on or []
    reach = chord(distance_m, radius_m) if geographic else float(distance_m)
    q, axes = _metric(query, x, y, geographic)
    r, _ = _metric(reference.select(*on, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct(), x, y, geographic)
    size = max(reach, 1e-9) * (1 + 1e-9)
    cells = [f"__g{i}" for i in range(len(axes))]
    for g, a in zip(cells, axes, strict=True):
        q = q.withColumn(g, F.floor(F.col(a) / size))
        r = r.withColumn(g, F.explode(F.array(*[F.floor(F.col(a) / size) + k for k in (-1, 0, 1)])))
    r = r.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[F.col(a).alias(f"__r{a}") for a in axes], *[F.col(g).alias(f"__r{g}") for g in cells])
    same = [F.col(c) == F.col(f"__r_{c}") for c in on] + [F.col(g) == F.col(f"__r{g}") for g in cells]
    far = sum(((F.col(a) - F.col(f"__r{a}")) ** 2 for a in axes), d(0))
    condition = F.sqrt(far) <= reach * (1 + SLACK)
    for c in same:
        condition = condition & c
    return q.join(r, condition, how).drop(*axes, *cells)


def apply_buffer(train: DataFrame, test: DataFrame, keys: list[str], buffer_m: float = BUFFER_M, geographic: bool = False) -> DataFrame:
    """Training rows that are farther than the buffer from every test row of their group."""
    return within_distance(train, test, buffer_m, on=keys, geographic=geographic, how="left_anti")


def buffer_diagnostics(train: DataFrame, test: DataFrame, keys: list[str], buffer_m: float = BUFFER_M, geographic: bool = False) -> DataFrame:
    """Counts before and after the buffer, of rows and of presences, and whether one class is left."""
    count = lambda df, tag: df.groupBy(*keys).agg(F.count("*").alias(f"n_{tag}"), F.count_if(F.col("occ") == 1).alias(f"presence_{tag}"))
    out = count(train, "before").join(count(apply_buffer(train, test, keys, buffer_m, geographic), "after"), keys, "left").na.fill(0, ["n_after", "presence_after"])
    return out.withColumn("n_excluded", F.col("n_before") - F.col("n_after")).withColumn("single_class", (F.col("presence_after") == 0) | (F.col("presence_after") == F.col("n_after")))


def spatial_folds(df: DataFrame, keys: list[str], n_folds: int = 5, block_size: float | None = None, seed: int = SEED, x: str = "x", y: str = "y") -> DataFrame:
    """Adds fold: grid blocks of each group, in a seeded order, dealt in turn. Only the distinct blocks are ordered."""
    if n_folds < 2:
        raise ValueError("at least two folds are needed")
    g = df.groupBy(*keys).agg(F.min(x).alias("__x"), F.max(x).alias("__x1"), F.min(y).alias("__y"), F.max(y).alias("__y1"))
    extent = F.greatest(F.col("__x1") - F.col("__x"), F.col("__y1") - F.col("__y")) / (4.0 * n_folds)
    g = g.withColumn("__s", d(block_size) if block_size else F.when(extent > 0, extent).otherwise(d(1)))
    t = df.join(g, keys).withColumn("block", F.concat_ws(":", F.floor((F.col(x) - F.col("__x")) / F.col("__s")).cast("string"), F.floor((F.col(y) - F.col("__y")) / F.col("__s")).cast("string"))).drop("__x", "__x1", "__y", "__y1", "__s")
    order = Window.partitionBy(*keys).orderBy(md5_order(seed, F.col("block")), "block")
    deal = t.select(*keys, "block").distinct().withColumn("fold", ((F.row_number().over(order) - 1) % n_folds).cast("int"))
    return t.join(deal, [*keys, "block"])


def spatial_residuals(df: DataFrame, keys: list[str], n_bins: int = 10, x: str = "x", y: str = "y", obs: str = "y_true", prob: str = "p") -> DataFrame:
    """Mean residual, observed and predicted of grid cells, counted from the group's corner."""
    g = df.groupBy(*keys).agg(F.min(x).alias("__x"), F.max(x).alias("__x1"), F.min(y).alias("__y"), F.max(y).alias("__y1"))
    t = df.join(g, keys)
    cell = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * n_bins), F.lit(n_bins - 1))).otherwise(0).cast("int")
    t = t.withColumn("cell_x", cell(x, "__x", "__x1")).withColumn("cell_y", cell(y, "__y", "__y1"))
    return t.groupBy(*keys, "cell_x", "cell_y").agg(F.count("*").alias("n"), F.avg(F.col(obs) - F.col(prob)).alias("mean_residual"), F.avg(F.col(obs).cast("double")).alias("mean_observed"), F.avg(prob).alias("mean_predicted"))
