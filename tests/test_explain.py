"""Shapley values of trees against the enumeration of all sets of features; mixtures whose likelihood must not fall."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from faunaflux.operators import encoders, explain, grouped, mixture, trees
from faunaflux.schemas import DataError

from .test_trees import FEATURES, KEYS, table


def known_only(tree, node, x, known):
    """A node's value where features outside of known are averaged over by the weights of both sides."""
    f = tree["feature"][node]
    if f < 0:
        return tree["value"][node]
    left, right = tree["left"][node], tree["right"][node]
    if f in known:
        return known_only(tree, right if x[f] > tree["threshold"][node] else left, x, known)
    a, b = tree["cover"][left], tree["cover"][right]
    return (a * known_only(tree, left, x, known) + b * known_only(tree, right, x, known)) / (a + b)


@pytest.mark.parametrize("spec", [trees.Spec(depth=3), trees.Spec(trees=4, depth=3, boost=True, rate=0.5)])
def test_values_equal_all_sets_and_add_up(spark, spec):
    t = table(spark, 120).withColumn("b", F.when(F.col("siteid").endswith("5"), None).otherwise(F.col("b")))
    model = trees.fit(t, KEYS, FEATURES, "siteid", spec)
    got = {r.siteid: r for r in explain.tree_shapley(model, t, KEYS, FEATURES, "siteid").collect()}
    p = {r.siteid: r.p for r in trees.apply(model, t, KEYS, FEATURES, "siteid", spec).collect()}
    grown = {g: [r.asDict() for r in model.where(F.col("spid") == g).orderBy("tree").collect()] for g in ("u", "v")}
    assert len(got) == 240
    for r in t.collect():
        total = got[r.siteid].mean + sum(got[r.siteid].phi)
        assert p[r.siteid] == pytest.approx(1 / (1 + np.exp(-total)) if spec.boost else total, abs=1e-9)
    for r in t.limit(25).collect():
        x = [-np.inf if v is None else v for v in (r.a, r.b, r.c)]
        for i in range(3):
            want, others = 0.0, [j for j in range(3) if j != i]
            for n in range(3):
                for s in combinations(others, n):
                    gain = sum(known_only(tree, 0, x, {*s, i}) - known_only(tree, 0, x, set(s)) for tree in grown[r.spid])
                    want += factorial(n) * factorial(2 - n) / 6 * gain
            assert got[r.siteid].phi[i] == pytest.approx(want, abs=1e-9)


def halves(n=1500, seed=2):
    """Where the third column is above 0 the first decides, else the second."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, (rng.random(n) < 1 / (1 + np.exp(-4 * np.where(x[:, 2] > 0, x[:, 0], x[:, 1])))).astype(float)


def here(x, y):
    return grouped.Here(x, y, np.ones(len(y)), grouped.Info(x.mean(0), x.std(0), x.min(0), x.max(0), y.sum(), (1 - y).sum()))


@pytest.mark.parametrize("views", [[[0], [1]], [[0, 1, 2]] * 3])
def test_likelihood_never_falls_and_the_gate_finds_the_halves(views):
    x, y = halves()
    m = mixture.Mixture(views)
    model = m.fit(here(x, y))
    assert (np.diff(m.likelihoods) >= -1e-7).all() and m.likelihoods[-1] > m.likelihoods[0] + 50
    p = m.predict(model, x)
    one = mixture.Mixture([[0, 1, 2]])
    assert ((p > 0.5) == y).mean() > ((one.predict(one.fit(here(x, y)), x) > 0.5) == y).mean() + 0.03
    assert np.allclose(m.gates(model, x).sum(1), 1)
    if len(views) == 2:
        g = m.gates(model, x)[:, 0]
        assert g[x[:, 2] > 0.5].mean() > 0.7 > 0.3 > g[x[:, 2] < -0.5].mean()


def test_gated_fusion_of_modalities(spark):
    x, y = halves(400)
    t = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, occ int")
    enc = {"first": encoders.Raw("id", ["a"]).fit_transform(t), "second": encoders.Raw("id", ["b", "c"]).fit_transform(t)}
    for fusion, names in ((encoders.Gated("id"), {"first", "second"}), (encoders.MixtureOfExperts("id", experts=2), {"expert0", "expert1"})):
        got = {r.id: r.value[0] for r in fusion.fit(enc, t).transform(enc).collect()}
        assert len(got) == 400 and all(0 <= p <= 1 for p in got.values())
        assert np.mean([(got[i] > 0.5) == y[i] for i in got]) > 0.7
        w = fusion.modality_importance()
        assert set(w) == names and sum(w.values()) == pytest.approx(1)
        with pytest.raises(DataError):
            fusion.transform({"first": enc["first"]})
