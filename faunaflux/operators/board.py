"""Leaderboards, coverage, ablation and Pareto reports over a table of job results."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import d, finite
from ..functions.stats import t_critical
from ..lineage import durable
from .metrics import DIRECTIONS


def successful(results: DataFrame) -> DataFrame:
    return results.where("status = 'OK'") if "status" in results.columns else results


def in_scenario(results: DataFrame, scenario: str | None) -> DataFrame:
    return results if scenario is None else results.where(F.col("scenario") == scenario)


TABLED = 300  # degrees of freedom whose critical values are in a table; beyond, four terms of the expansion about the normal one are exact to 1e-11


def critical_value(n: Column, confidence: float) -> Column:
    """Critical t of n - 1 degrees of freedom; null below 1. An expression, so no job runs to plan it."""
    df = (n - 1).cast("double")
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    far = d(z)
    for k, c in enumerate(terms):
        far = far + d(c) / F.pow(df, d(k + 1))
    table = F.array(*[d(t_critical(k, confidence)) for k in range(1, TABLED + 1)])
    return F.when(n < 2, None).when(n <= TABLED + 1, F.get(table, (n - 2).cast("int"))).otherwise(far)


def summarise(df: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """n, mean, median, sd, se and the t interval of finite values; only mean and median for one value."""
    x = df.select(*by, finite(value).alias("v")).groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.stddev_samp("v").alias("sd"))
    x = x.withColumn("t_crit", critical_value(F.col("n"), confidence)).withColumn("se", F.col("sd") / F.sqrt("n"))
    return x.select(*by, "n", "mean", "median", "sd", "se", (F.col("mean") - F.col("t_crit") * F.col("se")).alias("ci_low"), (F.col("mean") + F.col("t_crit") * F.col("se")).alias("ci_high"))


def direction_key(column: Column, metric: str) -> Column:
    """A key that sorts ascending from best to worst."""
    kind = DIRECTIONS.get(metric, "higher")
    return {"higher": -column, "lower": column, "closest_to_one": F.abs(column - 1)}[kind]


def ranked(board: DataFrame, key: Column) -> DataFrame:
    return board.withColumn("rank", F.row_number().over(Window.orderBy(key.asc_nulls_last(), "model_name")))


def leaderboard(results: DataFrame, metric: str = "roc_auc", scenario: str | None = None, extra: tuple[str, ...] = (), min_species: int = 1, sort_by: str | None = None) -> DataFrame:
    """One row for each model: counts of jobs and species, mean and median of metrics over successful jobs, and the rank.

    A species counts once in each region. A model without a successful job stays, unless min_species is more than 1.
    """
    rows = in_scenario(results, scenario)
    ok = F.col("status") == "OK"
    aggs = [F.count_distinct(F.when(ok, F.struct("region", "species_id"))).alias("n_species"), F.count_distinct(F.when(ok, F.col("region"))).alias("n_regions"), F.count("*").alias("n_jobs"), F.count_if(ok).alias("n_ok"), F.count_if(F.col("status") == "FAILED").alias("n_failed"), F.count_if(F.col("status").startswith("SKIPPED")).alias("n_skipped")]
    for m in dict.fromkeys([metric, *extra]):
        v = F.when(ok, finite(m))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.percentile(v, F.lit(0.5)).alias(f"{m}_median"), F.stddev_samp(v).alias(f"{m}_sd")]
    board = rows.groupBy("model_name").agg(*aggs)
    if min_species > 1:
        board = board.where(F.col("n_species") >= min_species)
    by = sort_by or metric
    return ranked(board, direction_key(F.col(f"{by}_mean"), by))


def per_species(results: DataFrame, metric: str = "roc_auc", scenario: str | None = None, models: list[str] | None = None) -> DataFrame:
    """Mean metric by (region, species) and model, models as columns."""
    rows = successful(in_scenario(results, scenario)).withColumn("v", finite(metric))
    return rows.groupBy("region", "species_id").pivot("model_name", models).agg(F.avg("v"))


def _species_means(results: DataFrame, metric: str, scenario: str | None) -> DataFrame:
    rows = successful(in_scenario(results, scenario)).withColumn("v", finite(metric)).where("v is not null")
    return rows.groupBy("region", "species_id", "model_name").agg(F.avg("v").alias("v"))


def common_species(results: DataFrame, metric: str = "roc_auc", scenario: str | None = None) -> DataFrame:
    """Summary and rank over the species for which every model has a value."""
    means = durable(_species_means(results, metric, scenario))  # read three times below, and small: a row for each species and model
    n = means.select(F.count_distinct("model_name").alias("models"))
    whole = means.groupBy("region", "species_id").agg(F.count("*").alias("have")).join(F.broadcast(n), F.col("have") == F.col("models"), "left_semi")
    return ranked(summarise(means.join(whole, ["region", "species_id"], "left_semi"), ["model_name"], "v"), direction_key(F.col("mean"), metric))


def coverage(results: DataFrame, statuses: tuple[str, ...] = ("OK", "FAILED", "SKIPPED_DATA", "SKIPPED_DEPENDENCY")) -> DataFrame:
    return results.groupBy("model_name", "scenario").pivot("status", list(statuses)).count().na.fill(0)


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def metric_distribution(results: DataFrame, metric: str = "roc_auc", scenario: str | None = None) -> DataFrame:
    """Quartiles by model, in ascending order of the median."""
    rows = successful(in_scenario(results, scenario)).withColumn("v", finite(metric))
    q = [F.percentile("v", F.lit(x)).alias(n) for x, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    t = rows.groupBy("model_name").agg(F.count("v").alias("n"), *q)
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.col("median").asc_nulls_last(), "model_name")))


def pareto_front(board: DataFrame, metric: str, cost: str) -> DataFrame:
    """Rows that no other beats strictly in both. Sorted by cost, a row is on the front if nothing strictly cheaper is strictly better: one running maximum."""
    better = direction_key(F.col(metric), metric.removesuffix("_mean"))
    rows = board.where(F.col(metric).isNotNull() & F.col(cost).isNotNull()).withColumn("__k", better)
    cheapest = rows.groupBy(cost).agg(F.min("__k").alias("__best"))
    w = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    before = cheapest.withColumn("__before", F.min("__best").over(w)).drop("__best")
    return rows.join(before, cost).where("__before is null or __before >= __k").drop("__k", "__before")


def modality_ablation(results: DataFrame, baseline: str, metric: str = "roc_auc", scenario: str | None = None) -> DataFrame:
    """Variants named <baseline>-minus-<m> or <baseline>-only-<m> against the baseline, paired by species."""
    means = _species_means(results, metric, scenario)
    base = means.where(F.col("model_name") == baseline).select("region", "species_id", F.col("v").alias("base"))
    kind = F.when(F.col("model_name").contains("-minus-"), "leave_one_out").when(F.col("model_name").contains("only-"), "alone")
    modality = F.coalesce(F.nullif(F.regexp_extract("model_name", r"-minus-(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract("model_name", r"only-(.+)$", 1), F.lit("")))
    t = means.withColumn("ablation", kind).withColumn("modality", modality).where("ablation is not null").join(base, ["region", "species_id"]).withColumn("diff", F.col("v") - F.col("base"))
    return t.groupBy("ablation", "modality").agg(F.avg("base").alias("baseline_mean"), F.avg("v").alias("variant_mean"), F.avg("diff").alias("mean_difference"), F.stddev_samp("diff").alias("sd_difference"), F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"))


def scale_ablation(results: DataFrame, modality: str, metric: str = "roc_auc", scenario: str | None = None) -> DataFrame:
    """Models named ...-<modality>@<scale>, summarised by scale."""
    means = _species_means(results, metric, scenario).where(F.col("model_name").contains(f"-{modality}@"))
    return summarise(means.withColumn("scale", F.substring_index("model_name", "@", -1)), ["scale"], "v")


def markdown(board: DataFrame, metric: str = "roc_auc") -> str:
    """A leaderboard, which has a row for each model, as a markdown table."""
    columns = ["rank", "model_name", "n_species", f"{metric}_mean", f"{metric}_median", "n_ok", "n_jobs"]
    rows = board.select(*columns).orderBy("rank").collect()
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def render(board: DataFrame, columns: list[str], max_width: int = 24) -> str:
    """Fixed-width text of a small table: the first column to the left, others to the right."""
    rows = [[("-" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v))[:max_width] for v in r] for r in board.select(*columns).collect()]
    wide = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(columns)]
    return "\n".join("  ".join(v.ljust(w) if i == 0 else v.rjust(w) for i, (v, w) in enumerate(zip(r, wide, strict=True))) for r in [columns, *rows])


def unequal_coverage(board: DataFrame) -> bool:
    """Whether models are compared on different numbers of species."""
    low, high = board.agg(F.min("n_species"), F.max("n_species")).first()
    return low != high


