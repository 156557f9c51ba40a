"""Queries without SQL run at the settings of their operators."""

from collections import defaultdict

import numpy as np
import pytest

from faunaflux.operators import compare, learners
from faunaflux.plans import catalogue, views

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
QUERIES, _ = catalogue.load()


@pytest.mark.parametrize("name", ["adaboost", "decision-tree", "random-forest-mllib", "random-forest", "extra-trees", "gradient-boosting", "brt", "maxnet", "gam", "svm", "linear-svc", "mlp-mllib"])
def test_learners(spark, monkeypatch, name):
    seen = {}
    monkeypatch.setattr(learners, "predict", lambda n, train, test, keys, *a, **options: seen.update({n: (keys, options)}) or test)
    QUERIES[f"model_{name.replace('-', '_')}"](spark, SMALL)
    assert seen == {name: (["region", "spid"], {})}


@pytest.mark.parametrize("name", ["bootstrap_ci", "compare_models"])
def test_replicates(spark, monkeypatch, name):
    seen, real = [], compare.bootstrap_ci
    monkeypatch.setattr(compare, "bootstrap_ci", lambda values, by, value, order, n_boot=10_000, **more: seen.append(n_boot) or real(values, by, value, order, 2, **more))
    QUERIES[name](spark, SMALL)
    assert seen == [10_000]


def test_pairs(spark):
    sides = defaultdict(lambda: ([], []))
    for r in views.pred(spark, SF).where("scenario = 'nonspatial'").collect():
        sides[r.region, r.species_id, r.model_name][r.y].append(np.log(r.p / (1 - r.p)))
    got = {(r.region, r.species_id, r.model_name): r.loss for r in QUERIES["loss_pairwise"](spark, SF).collect()}
    want = {k: np.maximum(1 - (np.array(p)[:, None] - np.array(b)), 0).mean() for k, (b, p) in sides.items() if b and p}
    assert got == pytest.approx(want, abs=2e-6)
