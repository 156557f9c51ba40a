"""Paired comparison of models over species: one grouped job for all pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SEED, d, finite, md5_int
from ..functions.stats import paired_t_p, wilcoxon_p
from ..lineage import durable
from .board import in_scenario, successful

PAIR = ["model_a", "model_b"]
BLOCKS = 32  # blocks of replicates that a group's values are sent to


def paired(results: DataFrame, metric: str = "roc_auc", scenario: str | None = None, reference: str | None = None) -> DataFrame:
    """model_a, model_b, region, species_id, diff (a - b): all pairs of models by name, or each against a reference."""
    rows = successful(in_scenario(results, scenario)).withColumn("v", finite(metric)).where("v is not null")
    means = rows.groupBy("region", "species_id", "model_name").agg(F.avg("v").alias("v"))
    a = means.select("region", "species_id", F.col("model_name").alias("model_a"), F.col("v").alias("a"))
    b = means.select("region", "species_id", F.col("model_name").alias("model_b"), F.col("v").alias("b"))
    which = (F.col("model_a") < F.col("model_b")) if reference is None else (F.col("model_a") != F.col("model_b")) & (F.col("model_b") == reference)
    return a.join(b, ["region", "species_id"]).where(which).withColumn("diff", F.col("a") - F.col("b"))


def paired_summary(pairs: DataFrame, tie_tolerance: float = 0.0) -> DataFrame:
    x = F.col("diff")
    sd = F.stddev_samp("diff")
    return pairs.groupBy(*PAIR).agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("mean_difference"), F.percentile("diff", F.lit(0.5)).alias("median_difference"), sd.alias("sd_difference"), F.when(sd > 0, F.avg("diff") / sd).alias("cohen_dz"), F.count_if(x > tie_tolerance).alias("wins"), F.count_if(x < -tie_tolerance).alias("losses"), F.count_if(F.abs(x) <= tie_tolerance).alias("ties"))


def bootstrap_ci(values: DataFrame, by: list[str], value: str, order: list[str], n_boot: int = 10_000, confidence: float = 0.95, seed: int = SEED, statistic: str = "mean") -> DataFrame:
    """Percentile interval of the mean or median over resamples of each group; null for fewer than two values.

    Draw i of replicate r is row md5(seed|r|i) mod n of the group in the given order, so every engine draws the same rows. The values of a group are
    an array, which is sent once to each of BLOCKS blocks of replicates and looked up there by position: what is shuffled does not grow with n_boot.
    """
    if statistic not in ("mean", "median"):
        raise ValueError(f"unknown statistic {statistic!r}")
    rows = values.select(*by, *[F.col(c) for c in order], finite(value).alias("v")).where("v is not null")
    g = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "v"))), lambda s: s["v"]).alias("vs"))
    g = g.withColumn("n", F.size("vs"))
    blocks = min(BLOCKS, n_boot)
    spread = g.where("n > 1").withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(*by, "__b")
    first, last = F.floor(F.col("__b") * n_boot / blocks) + 1, F.floor((F.col("__b") + 1) * n_boot / blocks)
    reps = spread.withColumn("rep", F.explode(F.sequence(first, last)))
    draw = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("vs", (md5_int(F.lit(seed), F.col("rep"), i) % F.col("n")).cast("int")))
    if statistic == "mean":
        stat = F.aggregate(draw, d(0), lambda a, x: a + x) / F.col("n")
    else:
        s = F.array_sort(draw)
        stat = (F.get(s, F.floor((F.col("n") - 1) / 2).cast("int")) + F.get(s, F.floor(F.col("n") / 2).cast("int"))) / 2
    tail = (1 - confidence) / 2
    ci = reps.select(*by, stat.alias("s")).groupBy(*by).agg(F.percentile("s", F.lit(tail)).alias("ci_low"), F.percentile("s", F.lit(1 - tail)).alias("ci_high"))
    return g.select(*by, F.col("n").cast("long").alias("n")).join(ci, by, "left")


def wilcoxon_w(pairs: DataFrame) -> DataFrame:
    """Signed-rank statistic of each pair, zeros left out, average ranks for ties."""
    x = pairs.where("diff != 0").withColumn("size", F.abs("diff"))
    rank, same = Window.partitionBy(*PAIR).orderBy("size"), Window.partitionBy(*PAIR, "size")
    x = x.withColumn("r", F.rank().over(rank) + (F.count("*").over(same) - 1).cast("double") / 2)
    up, down = (F.coalesce(F.sum(F.when(F.col("diff") * s > 0, F.col("r"))), d(0)) for s in (1, -1))
    return x.groupBy(*PAIR).agg(F.count("*").alias("n_nonzero"), F.least(up, down).alias("wilcoxon_w"))


def p_values(pairs: DataFrame) -> DataFrame:
    """wilcoxon_p and ttest_p of each pair, for at least three species and a difference that is not zero. A group is one pair of models: a row for each species."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        x = t["diff"].tolist()
        ok = len(x) >= 3 and any(x)
        return pd.DataFrame({"model_a": t["model_a"].iloc[:1], "model_b": t["model_b"].iloc[:1], "wilcoxon_p": [wilcoxon_p(x)[1] if ok else None], "ttest_p": [paired_t_p(x) if ok else None]})

    return pairs.select(*PAIR, "diff").groupBy(*PAIR).applyInPandas(one, "model_a string, model_b string, wilcoxon_p double, ttest_p double")


def adjust(df: DataFrame, p: str, method: str = "holm", name: str = "p_adjusted", tiebreak: list[str] = PAIR) -> DataFrame:
    """Family-wise adjustment over all rows; nulls stay null. There is a row for each comparison."""
    if method not in ("holm", "bonferroni", "none"):
        raise ValueError(f"unknown correction {method!r}")
    if method == "none":
        return df.withColumn(name, F.col(p))
    n = F.count(p).over(Window.partitionBy())
    if method == "bonferroni":
        return df.withColumn(name, F.least(F.col(p) * n, d(1)))
    order = Window.orderBy(F.col(p).asc_nulls_last(), *tiebreak)
    df = df.withColumn("__h", (n - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn(name, F.when(F.col(p).isNotNull(), F.least(d(1), F.max("__h").over(order.rowsBetween(Window.unboundedPreceding, 0))))).drop("__h")


def verdict(n, low, high, p, mean, alpha: float = 0.05):
    """Needs three species, an interval without 0 and a p below alpha."""
    low, high, p, mean, n = (F.col(c) if isinstance(c, str) else c for c in (low, high, p, mean, n))
    clear = F.coalesce((low > 0) | (high < 0), F.lit(False)) & F.coalesce(p < alpha, F.lit(False))
    return F.when(n < 3, "INSUFFICIENT_DATA").when(~clear, "NO_RELIABLE_DIFFERENCE").when(mean > 0, F.concat(F.col("model_a"), F.lit("_BETTER"))).otherwise(F.concat(F.col("model_b"), F.lit("_BETTER")))


def compare_models(results: DataFrame, metric: str = "roc_auc", scenario: str | None = None, reference: str | None = None, correction: str = "holm", n_boot: int = 10_000, tie_tolerance: float = 0.0) -> DataFrame:
    """All of the above for all pairs, or all against a reference, sorted by mean difference."""
    pairs = durable(paired(results, metric, scenario, reference))  # four branches read it
    out = paired_summary(pairs, tie_tolerance).join(bootstrap_ci(pairs, PAIR, "diff", ["region", "species_id"], n_boot).drop("n"), PAIR, "left").join(wilcoxon_w(pairs), PAIR, "left").join(p_values(pairs), PAIR, "left")
    out = adjust(out, "wilcoxon_p", correction)
    return out.withColumn("verdict", verdict("n", "ci_low", "ci_high", "wilcoxon_p", "mean_difference")).orderBy(F.desc("mean_difference"), *PAIR)
