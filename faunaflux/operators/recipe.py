"""Preprocessing that is fitted on training rows only, as a table of parameters by group and column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import d, finite, yeo_johnson
from ..lineage import durable
from ..schemas import DataError

LAMBDA_LOW, LAMBDA_HIGH = -5.0, 5.0


def long_form(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """ids, column, v: one row for each value; not finite is null."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("v")) for c in columns])
    return df.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.column", "c.v")


def zero_variance(df: DataFrame, keys: list[str], columns: list[str], threshold: float = 0.0) -> DataFrame:
    """keys, column, n, n_distinct, variance, dropped."""
    t = long_form(df, keys, columns).groupBy(*keys, "column").agg(F.count("v").alias("n"), F.count_distinct("v").alias("n_distinct"), F.var_pop("v").alias("variance"))
    return t.withColumn("dropped", (F.col("n") == 0) | (F.col("n_distinct") <= 1) | (F.coalesce(F.col("variance"), d(0)) <= threshold))


def _likelihood(cells: DataFrame, by: list[str]) -> DataFrame:
    """Profile log-likelihood of each lam for (by, v, lam) rows: one aggregate."""
    t = cells.withColumn("t", yeo_johnson("v", F.col("lam")))
    jac = F.sum(F.signum("v") * F.ln(F.abs("v") + 1))
    n, var = F.count("v"), F.var_pop("t")
    return t.groupBy(*by, "lam").agg(F.when(var > 0, -n / 2 * F.ln(var) + (F.col("lam") - 1) * jac).alias("llf"))


def lambda_grid(df: DataFrame, keys: list[str], columns: list[str], grid: list[float]) -> DataFrame:
    """keys, column, lam: the likeliest of the grid, the least for ties."""
    cells = long_form(df, keys, columns).where("v is not null").withColumn("lam", F.explode(F.array(*[d(g) for g in grid])))
    best = _likelihood(cells, [*keys, "column"]).groupBy(*keys, "column").agg(F.max_by("lam", F.struct("llf", -F.col("lam"))).alias("lam"))
    return best


def lambda_mle(df: DataFrame, keys: list[str], columns: list[str], rounds: int = 5, points: int = 11) -> DataFrame:
    """keys, column, lam by likelihood on [-5, 5]: each round evaluates a grid within the last one's best interval, for all columns in one aggregate.

    The profile likelihood has one peak. A column with fewer than two values gets 1.
    """
    cells = long_form(df, keys, columns).where("v is not null")
    by = [*keys, "column"]
    span = cells.groupBy(*by).agg(F.count_distinct("v").alias("m")).withColumn("lo", d(LAMBDA_LOW)).withColumn("hi", d(LAMBDA_HIGH))
    few = span.where("m < 2").select(*by, d(1).alias("lam"))
    span = span.where("m >= 2").drop("m")
    for _ in range(rounds):
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        tried = cells.join(span, by).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("lam", F.col("lo") + F.col("i") * step)
        best = _likelihood(tried, by).groupBy(*by).agg(F.max_by("lam", F.struct("llf", -F.col("lam"))).alias("lam"))
        span = span.drop("lam").join(best, by).withColumn("step", step).select(*by, F.greatest(F.col("lam") - F.col("step"), d(LAMBDA_LOW)).alias("lo"), F.least(F.col("lam") + F.col("step"), d(LAMBDA_HIGH)).alias("hi"), "lam")
        span = durable(span)  # a row for each group and column; the next round reads it twice
    return span.select(*by, "lam").unionByName(few)


def levels(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """keys, column, level, code: levels of training rows in order of first appearance."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    t = df.select(*keys, order, F.explode(cells).alias("c")).select(*keys, order, "c.*").where("level is not null")
    first = t.groupBy(*keys, "column", "level").agg(F.min(order).alias("__o"))
    return first.withColumn("code", (F.row_number().over(Window.partitionBy(*keys, "column").orderBy("__o", "level")) - 1).cast("int")).drop("__o")


def apply_levels(df: DataFrame, codes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Adds <column>_code: -1 for a level that training did not have."""
    one = codes.where(F.col("column") == column).select(*keys, F.col("level").alias(column), F.col("code").alias(f"{column}_code"))
    return df.withColumn(column, F.col(column).cast("string")).join(one, [*keys, column], "left").fillna(-1, [f"{column}_code"])


def one_hot(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Columns <column>=<level> of 0 and 1; an unseen level has only zeros."""
    return df.select("*", *[F.coalesce((F.col(column).cast("string") == n).cast("int"), F.lit(0)).alias(f"{column}={n}") for n in names])


class SdmRecipe:
    """Drop columns without variance, transform to normality, standardise; categories to levels of training rows."""

    def __init__(self, keys: list[str], numeric: list[str], categorical: list[str] = (), transform: bool = True, threshold: float = 0.0):
        self.keys, self.numeric, self.categorical, self.power, self.threshold = keys, list(numeric), list(categorical), transform, threshold

    def fit(self, train: DataFrame, order: str | None = None) -> SdmRecipe:
        by = [*self.keys, "column"]
        p = zero_variance(train, self.keys, self.numeric, self.threshold).select(*by, "dropped")
        lam = lambda_mle(train, self.keys, self.numeric) if self.power else long_form(train, self.keys, self.numeric).select(*by).distinct().withColumn("lam", d(1))
        p = p.join(lam, by, "left")
        cells = long_form(train, self.keys, self.numeric).join(p, by).withColumn("t", yeo_johnson("v", F.col("lam")))
        s = cells.groupBy(*by).agg(F.avg("t").alias("mean"), F.stddev_samp("t").alias("std"))
        self.params = durable(p.join(s, by).withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(d(1))).withColumn("fitted_on", F.lit("train")))
        self.levels = levels(train, self.keys, self.categorical, order) if self.categorical else None
        return self

    def transform(self, data: DataFrame) -> DataFrame:
        missing = [c for c in [*self.numeric, *self.categorical] if c not in data.columns]
        if missing:
            raise DataError(f"missing columns: {', '.join(missing)}")
        # the parameters of a group, one row, wide
        wide = self.params.groupBy(*self.keys).agg(*[F.max(F.when(F.col("column") == c, F.struct("dropped", "lam", "mean", "std"))).alias(f"__{c}") for c in self.numeric])
        t = data.join(wide, self.keys) if self.keys else data.join(F.broadcast(wide))
        for c in self.numeric:
            z = (yeo_johnson(c, F.col(f"__{c}.lam")) - F.col(f"__{c}.mean")) / F.col(f"__{c}.std")
            t = t.withColumn(c, F.when(~F.col(f"__{c}.dropped"), z))
        t = t.drop(*[f"__{c}" for c in self.numeric])
        for c in self.categorical:
            t = apply_levels(t, self.levels, self.keys, c).withColumn(c, F.when(F.col(f"{c}_code") >= 0, F.col(c)))
        return t


def standard_scale(df: DataFrame, keys: list[str], columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """z-scores by the mean and sample deviation of fit_on (df itself if none); deviation 0 counts as 1."""
    s = (fit_on if fit_on is not None else df).groupBy(*keys).agg(*[f(finite(c)).alias(f"__{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))])
    t = df.join(s, keys) if keys else df.join(F.broadcast(s))
    out = {c: (finite(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(d(1)) for c in columns}
    return t.withColumns(out).drop(*[f"__{n}_{c}" for c in columns for n in "ms"])


def pca(df: DataFrame, columns: list[str], k: int = 10, whiten: bool = False) -> tuple[DataFrame, list[float]]:
    """Adds array pc of centred projections; and the explained shares."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    k = min(k, len(columns))
    t = VectorAssembler(inputCols=columns, outputCol="__v").transform(df)
    t = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(t).transform(t)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(t)
    t = model.transform(t).withColumn("pc", vector_to_array("__p")).drop("__v", "__c", "__p")
    if whiten:
        sd = t.agg(*[F.stddev_samp(F.get("pc", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
        t = t.withColumn("pc", F.array(*[F.get("pc", F.lit(i)) / (s or 1.0) for i, s in enumerate(sd)]))
    return t, list(map(float, model.explainedVariance))


