"""Trees against a plain recursive search, rows in tasks against rows in partitions, and what boosting and forests must do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faunaflux.operators import trees

KEYS, FEATURES = ["region", "spid"], ["a", "b", "c"]


def table(spark, n=240, groups=("u", "v"), seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        x = np.round(rng.normal(size=(n, 3)), 1)
        p = 1 / (1 + np.exp(-3 * (x[:, 0] > 0.2) * (x[:, 1] < 0.5) + 1 - x[:, 2]))
        rows += [("r", g, f"{g}{i}", *map(float, x[i]), int(rng.random() < p[i])) for i in range(n)]
    return spark.createDataFrame(rows, "region string, spid string, siteid string, a double, b double, c double, occ int")


def plain(x, y, depth, leaf=1):
    """Mean of each row's leaf, by trying every value of every feature."""
    out = np.full(len(y), y.mean())
    if depth == 0 or len(set(y)) == 1:
        return out
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= v
            if low.sum() < leaf or (~low).sum() < leaf:
                continue
            gain = y[low].sum() ** 2 / low.sum() + y[~low].sum() ** 2 / (~low).sum() - y.sum() ** 2 / len(y)
            if gain > 1e-9 and (best is None or round(gain, 9) > round(best[0], 9)):
                best = (gain, low)
    if best is None:
        return out
    low = best[1]
    out[low], out[~low] = plain(x[low], y[low], depth - 1), plain(x[~low], y[~low], depth - 1)
    return out


def predictions(t, spec, **more):
    model = trees.fit(t, KEYS, FEATURES, "siteid", spec, **more)
    return {r.siteid: r.p for r in trees.apply(model, t, KEYS, FEATURES, "siteid", spec).collect()}


def test_depth_three_equals_a_search_of_all_cuts(spark):
    t = table(spark)
    got = predictions(t, trees.Spec(depth=3, bins=256))
    for g in ("u", "v"):
        rows = t.where(F.col("spid") == g).collect()
        want = plain(np.array([[r.a, r.b, r.c] for r in rows]), np.array([r.occ for r in rows], float), 3)
        assert [got[r.siteid] for r in rows] == pytest.approx(want.tolist(), abs=1e-12)


@pytest.mark.parametrize("spec", [trees.Spec(depth=4), trees.Spec(trees=6, depth=4, draw="balanced", features=1), trees.Spec(trees=5, depth=3, draw="poisson", extra=True, features=2), trees.Spec(trees=7, splits=3, boost=True, rate=0.3, folds=2, step=3, draw="bag", leaf=5.0), trees.SPECS["adaboost"]._replace(trees=6)])
def test_large_groups_in_partitions_give_the_same_trees(spark, spec):
    t = table(spark, 150).repartition(3)
    small, large = predictions(t, spec), predictions(t, spec, one_task=0)
    assert small.keys() == large.keys() and max(abs(small[k] - large[k]) for k in small) < 1e-9


def test_missing_values_go_low_and_rows_stay(spark):
    t = table(spark, 100).withColumn("a", F.when(F.col("siteid").endswith("7"), None).when(F.col("siteid").endswith("8"), float("nan")).otherwise(F.col("a")))
    got = predictions(t, trees.Spec(depth=3))
    assert len(got) == 200 and all(0 <= p <= 1 for p in got.values())


def test_boosting_learns_and_held_out_rows_choose_its_length(spark):
    t = table(spark, 600, ("u",))
    labels = {r.siteid: r.occ for r in t.collect()}
    fit = lambda n: predictions(t, trees.Spec(trees=n, depth=2, boost=True))
    loss = [-np.mean([np.log(p[k] if labels[k] else 1 - p[k]) for k in labels]) for p in (fit(1), fit(10), fit(60))]
    assert loss[0] > loss[1] > loss[2]
    # labels that nothing explains: more trees only fit noise, and the least held-out deviance comes early
    noise = t.withColumn("occ", (F.xxhash64("siteid") % 2 == 0).cast("int"))
    spec = trees.Spec(trees=400, splits=5, boost=True, rate=0.2, folds=5, step=5, draw="bag")
    assert trees.fit(noise, KEYS, FEATURES, "siteid", spec).count() < 60
    assert trees.fit(t, KEYS, FEATURES, "siteid", spec).count() > trees.fit(noise, KEYS, FEATURES, "siteid", spec).count()


def test_votes_equal_plain_adaptive_boosting(spark):
    t = table(spark, 150, ("u",))
    rows = t.collect()
    x, y = np.array([[r.a, r.b, r.c] for r in rows]), np.array([r.occ for r in rows], float)
    w, score, votes = np.ones(len(y)), np.zeros(len(y)), 0.0
    for _ in range(8):
        best = None
        for f in range(3):
            for v in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= v
                gain = (w * y)[low].sum() ** 2 / w[low].sum() + (w * y)[~low].sum() ** 2 / w[~low].sum()
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, low)
        says = np.where(best[1], (w * y)[best[1]].sum() / w[best[1]].sum() > 0.5, (w * y)[~best[1]].sum() / w[~best[1]].sum() > 0.5) * 2.0 - 1
        wrong = w[says != 2 * y - 1].sum() / w.sum()
        if wrong >= 0.5 - 1e-12:
            break
        vote = 0.5 * np.log((1 - wrong) / wrong)
        w, score, votes = w * np.exp(-vote * says * (2 * y - 1)), score + vote * says, votes + vote
    got = predictions(t, trees.SPECS["adaboost"]._replace(trees=8, bins=256))
    want = 1 / (1 + np.exp(-2 * score / votes))
    assert [got[r.siteid] for r in rows] == pytest.approx(want.tolist(), abs=1e-9)


def test_balanced_draws_take_as_much_background_as_presences():
    rng = np.random.default_rng(0)
    h, y = rng.integers(0, trees.PRIME, 20_000), np.arange(20_000) % 20 == 0
    spec = trees.Spec(trees=5, draw="balanced")
    sums = [(w[y].sum(), w[~y].sum()) for w in (trees.drawn(spec, t, h, y, 1000, 19_000) for t in range(5))]
    assert all(abs(a - 1000) < 150 and abs(b - 1000) < 150 for a, b in sums) and len({a for a, _ in sums}) > 1
    bag = trees.drawn(trees.Spec(draw="bag", bag=0.75), 3, h, y, 0, 0)
    assert abs(bag.mean() - 0.75) < 0.02 and set(bag) == {0.0, 1.0}


def test_one_class_and_constant_features(spark):
    t = table(spark, 40, ("u",)).withColumn("occ", F.lit(1)).withColumn("b", F.lit(2.0))
    assert set(predictions(t, trees.Spec(depth=3)).values()) == {1.0}
    boosted = predictions(t, trees.Spec(trees=3, depth=2, boost=True))
    assert all(p > 0.9 for p in boosted.values())


def test_protocol_settings():
    assert trees.SPECS["brt"].trees == 10_000 and trees.SPECS["brt"].rate == 0.001 and trees.SPECS["brt"].bag == 0.75 and trees.SPECS["brt"].folds == 5
    assert trees.SPECS["random-forest"].trees == 1000 and trees.SPECS["random-forest"].draw == "balanced"
