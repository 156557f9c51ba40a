"""Support vectors, maximum entropy and additive models: conditions of their optima, rows in tasks against rows in partitions, and functions they must find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faunaflux.operators import grouped, penalised

KEYS, FEATURES = ["region", "spid"], ["a", "b"]


def rows_of(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, size=(n, 2))
    return x, (rng.random(n) < 1 / (1 + np.exp(-2 * np.tanh(2 * x[:, 0]) - x[:, 1] ** 2 + 2))).astype(float)


def here(x, y, w=None):
    info = grouped.Info(x.mean(0), x.std(0), x.min(0), x.max(0), float(y.sum()), float((1 - y).sum()))
    return grouped.Here(x, y, np.ones(len(y)) if w is None else w, info)


def table(spark, n=200):
    rows = []
    for g, seed in (("u", 3), ("v", 4)):
        x, y = rows_of(n, seed)
        rows += [("r", g, f"{g}{i}", *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "region string, spid string, siteid string, a double, b double, occ int")


@pytest.mark.parametrize("name,options", [("svm", {"cosines": 32}), ("linear-svc", {}), ("maxnet", {}), ("gam", {})])
def test_large_groups_in_partitions_give_the_same_model(spark, name, options):
    t, learner = table(spark).repartition(3), penalised.LEARNERS[name](**options)
    small, large = ({(r.spid): np.array(r.beta) for r in grouped.fit(t, KEYS, FEATURES, learner, one_task=k).collect()} for k in (1000, 0))
    a, b = ({r.siteid: r.p for r in grouped.apply(grouped.fit(t, KEYS, FEATURES, learner, one_task=k), t, KEYS, FEATURES, "siteid", learner).collect()} for k in (1000, 0))
    assert small.keys() == large.keys() and len(a) == 400 and max(abs(a[k] - b[k]) for k in a) < 1e-4


def test_missing_values_count_as_the_mean(spark):
    t = table(spark, 80).withColumn("a", F.when(F.col("siteid").endswith("3"), float("nan")).when(F.col("siteid").endswith("4"), None).otherwise(F.col("a")))
    for name in ("svm", "maxnet", "gam"):
        got = penalised.fit_predict(name, t, t, KEYS, FEATURES, "siteid").collect()
        assert len(got) == 160 and all(0 <= r.p <= 1 for r in got)


def test_support_vectors_rest_at_the_optimum_and_cosines_approach_the_kernel():
    x, y = rows_of()
    s = penalised.Svm(cosines=64)
    m = s.fit(here(x, y))
    beta, f, sign = m[4:], s.design(x, m[:2], m[2:4]), 2 * y - 1
    gap = np.maximum(1 - sign * (f @ beta), 0)
    gradient = -2 * f.T @ (gap * sign) + np.r_[penalised.RIDGE, np.ones(64)] * beta
    assert np.abs(gradient).max() < 1e-6
    z = (x - x.mean(0)) / x.std(0)
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / 2)
    errors = [np.abs((g := penalised.Svm(cosines=n).features(z)) @ g.T - kernel).mean() for n in (64, 1024, 8192)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.02
    # a ring: no line parts it, the kernel does
    ring = (np.hypot(*x.T) < 1.2).astype(float)
    right = lambda kernel: np.mean((penalised.Svm(c=10, kernel=kernel).predict(penalised.Svm(c=10, kernel=kernel).fit(here(x, ring)), x) > 0.5) == ring)
    assert right(True) > 0.95 > right(False)


@pytest.mark.parametrize("classes", ["l", "lq", "lqp", "lqph", "lqpht"])
def test_maxnet_meets_the_conditions_of_its_optimum(classes):
    x, y = rows_of()
    learner = penalised.Maxnet(classes)
    m = learner.fit(here(x, y))
    f, beta = learner.design(m, x), learner.parts(m, 2)[5]
    q = 1 / (1 + np.exp(-f @ beta))
    moments = np.stack([f[y == 1].sum(0), (f[y == 1] ** 2).sum(0)])[:, 1:]
    assert penalised.kkt(beta, f.T @ (y - (y + 100) * q), np.r_[0, learner.penalties(moments, y.sum())]) < 1e-5 * y.sum()
    assert 1 <= (beta[1:] != 0).sum() < len(beta) / 2 or classes in ("l", "lq", "lqp")
    # the entropy and the sum over the background, plainly
    z = f @ beta
    share = np.exp(z) / np.exp(z).sum()
    cloglog = 1 - np.exp(-np.exp(-(share * np.log(share)).sum() + z - np.log(np.exp(z).sum())))
    assert np.allclose(learner.predict(m, x), cloglog)
    assert cloglog[y == 1].mean() > cloglog[y == 0].mean()


def test_stronger_penalties_keep_fewer_features():
    x, y = rows_of()
    kept = [(lambda m, l: (l.parts(m, 2)[5][1:] != 0).sum())((l := penalised.Maxnet(multiplier=v)).fit(here(x, y)), l) for v in (0.5, 2, 50)]
    assert kept[0] > kept[1] > kept[2]


def test_additive_model_rests_at_the_optimum_and_finds_the_functions():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, size=(6000, 2))
    truth = 2 * np.tanh(2 * x[:, 0]) + 0.5 * x[:, 1] - 0.5
    y = (rng.random(6000) < 1 / (1 + np.exp(-truth))).astype(float)
    g = penalised.Gam()
    m = g.fit(here(x, y))
    ends, strength, beta = g.parts(m, 2)
    f = g.design(x, ends)
    q = 1 / (1 + np.exp(-f @ beta))
    assert np.abs(f.T @ (y - q) - np.tensordot(strength, g.penalty(2), 1) @ beta).max() < 1e-4
    assert np.corrcoef(f @ beta, truth)[0, 1] > 0.99
    at = np.linspace(-1.9, 1.9, 40)
    up = g.predict(m, np.column_stack([at, np.zeros(40)]))
    assert (np.diff(up) > -0.01).all() and up[-1] - up[0] > 0.5
    straight = g.predict(m, np.column_stack([np.zeros(40), at]))
    logit = np.log(straight / (1 - straight))
    assert np.abs(logit - np.polyval(np.polyfit(at, logit, 1), at)).max() < 0.25


def test_splines_sum_to_one_and_go_on_straight():
    g = penalised.Gam()
    z = np.linspace(0, 1, 101)
    assert np.allclose(g.basis(z).sum(1), 1) and (g.basis(z) >= -1e-12).all()
    beyond = g.basis(np.array([1.0, 1.5, 2.0]))
    assert np.allclose(beyond[2] - beyond[1], beyond[1] - beyond[0])


@pytest.mark.parametrize("classes", ["lqpht", "lqh", "ht", "lt"])
def test_pieces_stand_for_all_features(classes):
    """Scores and Gram matrices of intervals equal those of the features themselves; a constant variable, values on knots."""
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.uniform(-2, 5, 3000), np.round(rng.uniform(0, 1, 3000) * 49) / 49, rng.normal(size=3000) * 1e4])
    learner, low, high = penalised.Maxnet(classes), x.min(0), x.max(0)
    f = learner.expand(x, low, high)
    least, wide = f.min(0), np.where(f.max(0) > f.min(0), f.max(0) - f.min(0), 1)
    f = np.column_stack([np.ones(len(x)), (f - least) / wide])
    pieces = penalised.Pieces(learner, low, high, least, wide)
    beta, v, r = rng.normal(size=f.shape[1]), rng.random(3000), rng.normal(size=3000)
    assert np.abs(pieces.score(x, beta) - f @ beta).max() < 1e-9 * np.abs(beta).sum()
    assert np.abs(pieces.lift(pieces.gram(x, v, r)) - np.column_stack([f.T @ (f * v[:, None]), f.T @ r])).max() < 1e-8


def test_a_group_of_many_rows_is_one_task(spark, monkeypatch):
    """Beyond 200 000 rows every step was a Spark job, and every row hundreds of columns."""
    monkeypatch.setattr(grouped, "There", None)
    t = spark.range(250_000).select(F.lit("r").alias("region"), F.lit("s").alias("spid"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    t = t.withColumn("occ", (F.col("a") + F.rand(4) > 1).cast("int"))
    for learner in (penalised.Svm(cosines=16, rounds=3), penalised.Maxnet(rounds=2)):
        assert np.isfinite(grouped.fit(t, ["region", "spid"], ["a", "b"], learner).first().beta).all()
