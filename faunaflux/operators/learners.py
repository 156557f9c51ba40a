"""Learners: set-based ones over all groups at once, MLlib ones for one large group, and typed skips for what is not here."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, d, finite
from ..lineage import durable
from ..schemas import DataError, SkippableError
from . import neighbours, newton, penalised, trees
from .features import modality_weights
from .metrics import compute_metrics, roc_auc
from .resample import average_logits, stratified_folds

SEED = 32639
MOST_GROUPS = 10_000
ONE_PARTITION = 100_000  # training rows of a group below which it is fitted in one partition


def dummy(train: DataFrame, test: DataFrame, keys: list[str], y: str = "occ") -> DataFrame:
    """test with p: the training prevalence of the group."""
    return test.join(train.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("p")), keys)


def gaussian_nb(train: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, y: str = "occ", smoothing: float = 1e-9) -> DataFrame:
    """keys, row, p: naive Bayes with normal features, from means and variances by class; one aggregate and one join."""
    s = train.groupBy(*keys, F.col(y).alias("c")).agg(F.count("*").alias("n"), *[f(F.col(x)).alias(f"{t}_{x}") for x in features for f, t in ((F.avg, "m"), (F.var_pop, "v"))])
    floor = train.groupBy(*keys).agg((F.greatest(*[F.var_pop(x) for x in features], d(0)) * smoothing).alias("eps"), F.count("*").alias("total"))
    t = test.select(*keys, row, *features).join(s.join(floor, keys), keys)
    log = F.ln(F.col("n") / F.col("total"))
    for x in features:
        var = F.greatest(F.col(f"v_{x}") + F.col("eps"), d(1e-300))
        log = log - F.ln(var * (2 * np.pi)) / 2 - F.pow(F.col(x) - F.col(f"m_{x}"), 2) / (var * 2)
    t = t.select(*keys, row, "c", log.alias("l")).groupBy(*keys, row).agg(F.max(F.when(F.col("c") == 1, F.col("l"))).alias("l1"), F.max(F.when(F.col("c") == 0, F.col("l"))).alias("l0"))
    return t.select(*keys, row, F.when(F.col("l1").isNull(), d(0)).when(F.col("l0").isNull(), d(1)).otherwise(d(1) / (d(1) + F.exp(F.col("l0") - F.col("l1")))).alias("p"))


def knn(train: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, y: str = "occ", k: int = 5, metric: str = "manhattan") -> DataFrame:
    """keys, row, p: share of presences among the k nearest training rows, ties to the lesser row; missing features count as the group's training mean."""
    means = train.groupBy(*keys).agg(*[F.avg(finite(f)).alias(f"__m_{f}") for f in features])
    fill = lambda t: t.join(means, keys).withColumns({f: F.coalesce(finite(f), F.col(f"__m_{f}"), d(0)) for f in features})
    labels = train.select(*keys, F.col(row).alias("__near"), F.col(y).cast("double").alias("__y"))
    near = neighbours.of_rows(fill(train), fill(test), keys, row, features, k, metric == "manhattan")
    t = near.select(*keys, row, F.explode("near.row").alias("__near")).join(labels, [*keys, "__near"])
    return t.groupBy(*keys, row).agg(F.avg("__y").alias("p"))


def scale_pos_weight(df: DataFrame, y: str = "occ") -> float:
    pos, neg = df.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    return neg / pos if pos else 1.0


def mllib(name: str, **options):
    """An estimator by name; labels in column label, features in column features."""
    from pyspark.ml import classification as c

    n = options.pop("n_train", None)
    if name == "logistic-regression":
        return c.LogisticRegression(maxIter=200, elasticNetParam=0.0, standardization=False, regParam=1.0 / n if n else 0.0, **options)
    if name == "mlp-mllib":
        return c.MultilayerPerceptronClassifier(seed=SEED, **options)
    raise KeyError(f"unknown estimator {name!r}")


def logistic_fit(train: DataFrame, keys: list[str], features: list[str], y: str = "occ", c: float = 1.0) -> DataFrame:
    """keys, moments of the features and beta: logistic regression of each group on features scaled by its training rows, least (slopes squared) / 2 + c x log-loss, by grouped Newton steps.

    Missing values of a feature count as the group's training mean; a feature that does not vary counts 0. Groups of one class predict close to it.
    """
    moments = train.groupBy(*keys).agg(*[f(finite(x)).alias(f"__{n}_{x}") for x in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    beta = newton.fit(train.join(moments, keys), keys, _scaled(features), F.col(y), ridge=1 / c)
    return durable(moments.join(beta.drop("gradient"), keys))


def _scaled(features: list[str]) -> list:
    return [F.when(F.col(f"__s_{f}") > 0, F.coalesce((finite(f) - F.col(f"__m_{f}")) / F.col(f"__s_{f}"), d(0))).otherwise(d(0)) for f in features]


def logistic_apply(model: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str) -> DataFrame:
    """keys, row, p by a model of logistic_fit()."""
    return test.join(model, keys).select(*keys, row, (d(1) / (d(1) + F.exp(-clip(newton.score(_scaled(features)), -500, 500)))).alias("p"))


def logistic(train: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, y: str = "occ", c: float = 1.0) -> DataFrame:
    """keys, row, p: logistic regression of each group, fitted on train and applied to test."""
    return logistic_apply(logistic_fit(train, keys, features, y, c), test, keys, features, row)


def imputed(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with missing and non-finite values of features as the training mean, so that no row is lost; 0 where training has no value."""
    means = train.agg(*[F.avg(finite(f)).alias(f) for f in features]).first()
    fill = lambda t: t.withColumns({f: F.coalesce(finite(f), d(means[f] or 0.0)) for f in features})
    return fill(train), fill(test)


def fit_predict(name: str, train: DataFrame, test: DataFrame, features: list[str], row: str, y: str = "occ", **options) -> DataFrame:
    """row, p of all test rows by one MLlib estimator; missing values count as the training mean; scores of a margin go through a sigmoid."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    train, test = imputed(train, test, features)
    pack = VectorAssembler(inputCols=features, outputCol="__raw")
    a = pack.transform(train.withColumn("label", F.col(y).cast("double")))
    scaler = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(a)
    a = scaler.transform(a).select("features", "label")
    if name == "logistic-regression":
        options.setdefault("n_train", a.count())
    if name == "mlp-mllib":
        options.setdefault("layers", [len(features), 16, 2])
    model = mllib(name, **options).fit(a)
    out = model.transform(scaler.transform(pack.transform(test)))
    if "probability" in out.columns:
        return out.select(row, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    return out.select(row, (d(1) / (d(1) + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))).alias("p"))


def per_group(name: str, train: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, y: str = "occ", threads: int = 8, **options) -> DataFrame:
    """keys, row, p: an MLlib estimator for each group, fitted side by side; each fit is distributed, the driver only starts them.

    Meant for tens to thousands of species; more than MOST_GROUPS is an error, and the set-based learners take any number. Groups of one class get its label.
    """
    own = [*keys, *features]
    a, b = (durable(t.select(*dict.fromkeys([*own, *more]))) for t, more in ((train, [y]), (test, [row])))
    groups = a.groupBy(*keys).agg(F.min(y).alias("__low"), F.max(y).alias("__high"), F.count("*").alias("__n")).limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise DataError(f"more than {MOST_GROUPS} groups")

    def one(g) -> DataFrame:
        of = lambda t: t.where(reduce(lambda m, k: m & F.col(k).eqNullSafe(F.lit(g[k])), keys, F.lit(True)))
        # a small group is one partition: its many short rounds would be mostly scheduling
        here = lambda t: of(t).coalesce(1) if g["__n"] <= ONE_PARTITION else of(t)
        p = here(b).select(row, d(float(g["__low"])).alias("p")) if g["__low"] == g["__high"] else fit_predict(name, here(a), here(b), features, row, y, **options)
        return p.select(*[F.lit(g[k]).alias(k) for k in keys], row, "p")

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, groups))
    if not parts:
        return b.select(*keys, row, d(0).alias("p")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def predict(name: str, train: DataFrame, test: DataFrame, keys: list[str], features: list[str], row: str, **options) -> DataFrame:
    """keys, row, p by any model that is available; options are the learner's own."""
    require_available(name)
    if name == "dummy":
        return dummy(train, test, keys).select(*keys, row, "p")
    if name in trees.SPECS:
        return trees.fit_predict(name, train, test, keys, features, row, **options)
    if name in penalised.LEARNERS:
        return penalised.fit_predict(name, train, test, keys, features, row, **options)
    fit = {"gaussian-nb": gaussian_nb, "knn": knn, "logistic-regression": logistic}.get(name)
    return fit(train, test, keys, features, row, **options) if fit else per_group(name, train, test, keys, features, row, **options)


def ensemble(members: DataFrame, test: DataFrame, keys: list[str], row: str, fit) -> DataFrame:
    """Mean of logits over members of p from fit(member training rows, member test rows, keys with member_id)."""
    k = members.select(*keys, "member_id").distinct()
    return average_logits(fit(members, test.join(k, keys), [*keys, "member_id"]), [*keys, row])


def graph_smoothed(df: DataFrame, edges: DataFrame, keys: list[str], node: str, features: list[str], hops: int = 2) -> DataFrame:
    """df with features averaged over the neighbourhood, hop by hop, each weighed by degrees: the propagation of a simple graph convolution."""
    loops = df.select(*keys, F.col(node).alias("src"), F.col(node).alias("dst"))
    e = edges.select(*keys, "src", "dst").unionByName(loops)
    deg = e.groupBy(*keys, "src").agg(F.sqrt(F.count("*").cast("double")).alias("w"))
    e = e.join(deg.withColumnRenamed("w", "ws"), [*keys, "src"]).join(deg.select(*keys, F.col("src").alias("dst"), F.col("w").alias("wd")), [*keys, "dst"])
    t = df.select(*keys, node, *[F.col(f).cast("double").alias(f) for f in features])
    for _ in range(hops):
        h = e.join(t.withColumnRenamed(node, "dst"), [*keys, "dst"])
        t = h.groupBy(*keys, F.col("src").alias(node)).agg(*[F.sum(F.col(f) / (F.col("ws") * F.col("wd"))).alias(f) for f in features])
    return df.drop(*features).join(t, [*keys, node])


#: Models that need what is not in this environment, and why.
UNAVAILABLE = {
    **dict.fromkeys(["xgboost", "lightgbm", "catboost", "residual-mlp", "wide-and-deep", "ft-transformer", "autoencoder", "vae", "contrastive", "gcn", "graphsage", "gatv2", "graph-transformer", "autogluon", "h2o", "flaml", "maxent-java", "mlp"], "SKIPPED_DEPENDENCY"),
    **dict.fromkeys(["tabpfn", "tabpfn-real", "tabpfn-balanced", "tabpfn-subsample", "tabpfn-sdm", "tabpfn-sdm-spatial"], "SKIPPED_LICENSE"),
}
AVAILABLE = ("dummy", "gaussian-nb", "knn", "adaboost", "logistic-regression", "decision-tree", "random-forest-mllib", "random-forest", "extra-trees", "gradient-boosting", "brt", "maxnet", "gam", "svm", "linear-svc", "mlp-mllib")


def require_available(name: str) -> None:
    if name in UNAVAILABLE:
        raise SkippableError(f"{name} is not available here", UNAVAILABLE[name])
    if name not in AVAILABLE:
        raise KeyError(f"unknown model {name!r}")


def skip_rows(jobs: DataFrame) -> DataFrame:
    """Rows with status and error for jobs (with model_name) of models that are not available; no metrics."""
    pairs = F.create_map(*[F.lit(v) for kv in UNAVAILABLE.items() for v in kv])
    return jobs.withColumn("status", pairs[F.col("model_name")]).where("status is not null").withColumn("error", F.concat("model_name", F.lit(" is not available here")))


def tune(train: DataFrame, keys: list[str], row: str, grid: list[dict], fit, n_folds: int = 5, folds=None, metric: str = "roc_auc") -> DataFrame:
    """keys, place (in the grid), score: mean score over folds of training rows; fit(train, test, keys, **options) gives keys, row, p.

    folds adds column fold; stratified by default. Every setting of the grid runs over all groups and folds at once.
    """
    t = (folds or (lambda df: stratified_folds(df, keys, row, k=n_folds)))(train)
    by = [*keys, "fold"]
    held = t.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    a, b = held.where("own != fold").drop("own"), held.where("own = fold").drop("own")
    parts = []
    for i, options in enumerate(grid):
        p = fit(a, b, by, **options).join(b.select(*by, row, F.col("occ").alias("y")), [*by, row])
        score = compute_metrics(p, by, [metric])
        parts.append(score.groupBy(*keys).agg(F.avg(metric).alias("score")).withColumn("place", F.lit(i)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def best_setting(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, score: the best score, the first of equals."""
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("place")).alias("p"))))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.p")).alias("place"), F.col("b.score").alias("score"))


def linear_shapley(df: DataFrame, coefficients: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """feature, mean_abs, mean of the exact Shapley values of a linear model: coefficient times the distance from the mean."""
    names = list(coefficients)
    means = df.groupBy(*keys).agg(*[F.avg(n).alias(f"__m_{n}") for n in names])
    t = df.join(means, list(keys)) if keys else df.join(F.broadcast(means))
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), ((F.col(n) - F.col(f"__m_{n}")) * d(coefficients[n])).alias("phi")) for n in names])
    return t.select(*keys, F.explode(cells).alias("c")).groupBy(*keys, "c.feature").agg(F.avg(F.abs("c.phi")).alias("mean_abs"), F.avg("c.phi").alias("mean"))


def late_fusion(train: DataFrame, test: DataFrame, modalities: dict[str, list[str]], row: str, fit=None, y: str = "occ") -> DataFrame:
    """row, p: a learner for each modality, weighed by its skill on training rows; fit(train, test, features) gives row, p."""
    fit = fit or (lambda a, b, f: fit_predict("logistic-regression", a, b, f, row, y))
    auc, out = {}, None
    for m in sorted(modalities):
        own = fit(train, train, modalities[m]).join(train.select(row, F.col(y).alias("y")), row).withColumn("g", F.lit(1))
        auc[m] = roc_auc(own, ["g"]).first()["roc_auc"] or 0.5
    for m, w in modality_weights(auc).items():
        p = fit(train, test, modalities[m]).select(row, (F.col("p") * d(w)).alias("p"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(row).agg(F.sum("p").alias("p"))
