"""Trees of large groups: cells and grids against rows, draws by whole numbers, exact quantiles, and that no group of a few hundred thousand rows is spread over jobs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faunaflux.operators import trees


def rows(n=3000, seed=1, weighted=False):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random((n, 3)) < 0.02] = np.nan
    y = rng.random(n) < 1 / (1 + np.exp(-np.nan_to_num(x[:, 0]) - (np.nan_to_num(x[:, 1]) > 0.5)))
    t = pa.table({**{f"x{i}": x[:, i] for i in range(3)}, "y": y.astype(float), "h": rng.integers(0, trees.PRIME, n)})
    return t.append_column("w", pa.array(np.where(y, 1.0, 0.37))) if weighted else t


def plain(t, spec):
    """The same trees from rows one by one."""
    x = [trees.numbers(t, f"x{i}") for i in range(3)]
    edges = [trees.cuts_of(v, spec.bins) for v in x]
    w = trees.numbers(t, "w") if "w" in t.column_names else np.ones(t.num_rows)
    source = lambda models: trees.Local(trees.digits(x, edges), trees.numbers(t, "y"), w, t.column("h").to_numpy(), spec, models)
    return trees.grown(source, spec, t.num_rows, 3, edges)


@pytest.mark.parametrize(
    "spec,weighted",
    [
        (trees.Spec(depth=6), False),
        (trees.Spec(trees=7, depth=8, extra=True, features=1), False),
        (trees.Spec(trees=5, depth=6, draw="balanced", features=2), False),
        (trees.Spec(trees=5, depth=6, draw="poisson", features=1), True),
        (trees.Spec(trees=9, depth=4, boost=True, rate=0.3), False),
        (trees.Spec(trees=80, depth=2, boost=True, rate=0.9, draw="bag"), True),
        (trees.Spec(trees=8, splits=4, boost=True, rate=0.2, folds=3, step=4, draw="bag", leaf=10.0), True),
        (trees.SPECS["adaboost"]._replace(trees=12), False),
    ],
)
def test_cells_and_grids_give_the_trees_of_rows(monkeypatch, spec, weighted):
    monkeypatch.setattr(trees, "FEW_ROWS", 0)
    monkeypatch.setattr(trees, "GRID", 1 << 30)
    t = rows(20_000, weighted=weighted)
    source, edges, n = trees._source(t, ["x0", "x1", "x2"], spec)
    assert isinstance(source(spec.folds + 1), trees.Grid if spec.boost or spec.adaptive else trees.Cells)
    got, base = trees.grown(source, spec, n, 3, edges)
    want, want_base = plain(t, spec)
    assert base == pytest.approx(want_base, abs=1e-12) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a["feature"] == b["feature"] and a["left"] == b["left"] and a["right"] == b["right"] and a["threshold"] == b["threshold"]
        assert a["value"] == pytest.approx(b["value"], abs=1e-10) and a["cover"] == pytest.approx(b["cover"], abs=1e-6)


def test_draws_equal_those_of_plain_numbers():
    rng = np.random.default_rng(3)
    h, y = np.r_[rng.integers(0, trees.PRIME, 50_000), 0, 1, trees.PRIME - 1], rng.random(50_003) < 0.3
    for draw in ("bag", "poisson", "balanced"):
        spec = trees.Spec(draw=draw)
        draws = trees.Draws(spec, h, y, 900.0, 2900.0)
        for tree in (0, 1, 17, 999):
            assert (draws(tree) == trees.drawn(spec, tree, h, y, 900.0, 2900.0)).all()


def test_cuts_are_exact_quantiles_of_more_than_ten_thousand_values(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(45_000, 2))
    x[:, 1] = np.round(x[:, 1], 2)
    x[::50, 0] = np.nan
    t = spark.createDataFrame([("r", "s", i, float(a), float(b), i % 2) for i, (a, b) in enumerate(x)], "region string, spid string, ord long, a double, b double, occ int").repartition(5)
    want = []
    for v in x.T:
        v = np.sort(v[np.isfinite(v)])
        cuts = sorted({v[-(-k * len(v) // 64) - 1] for k in range(1, 64)})
        want.append([c for c in cuts if c < v[-1]])
    got = trees.edges_of(t, ["region", "spid"], ["a", "b"], 64).first()["__e"]
    assert [list(e) for e in got] == want == [trees.cuts_of(v, 64).tolist() for v in x.T]


def test_a_group_of_many_rows_is_one_task(spark, monkeypatch):
    """360 000 rows were beyond a task's 200 000: a job for each level of each tree."""
    monkeypatch.setattr(trees, "Spread", None)
    t = spark.range(300_000).select(F.lit("r").alias("region"), F.lit("s").alias("spid"), F.col("id").alias("ord"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    t = t.withColumn("occ", (F.col("a") + F.rand(4) > 1).cast("int"))
    for name, n in (("extra-trees", 3), ("random-forest", 3), ("gradient-boosting", 3), ("adaboost", 3), ("brt", 3)):
        p = trees.fit_predict(name, t, t.where("ord % 3 = 0"), ["region", "spid"], ["a", "b", "c"], "ord", trees=n)
        r = p.agg(F.count("*").alias("n"), F.min("p").alias("a"), F.max("p").alias("b")).first()
        assert r.n == 100_000 and 0 <= r.a < r.b <= 1


def test_scores_of_a_task_are_those_of_the_written_model(spark):
    t = spark.range(3000).select(F.lit("r").alias("region"), F.lit("s").alias("spid"), F.col("id").alias("ord"), F.round(F.rand(1), 2).alias("a"), F.when(F.rand(2) > 0.05, F.rand(3)).alias("b"))
    t = t.withColumn("occ", (F.col("a") + F.rand(4) > 1).cast("int")).localCheckpoint()
    for name, n in (("extra-trees", 4), ("gradient-boosting", 4), ("adaboost", 4)):
        own = {r.ord: r.p for r in trees.fit_predict(name, t, t, ["region", "spid"], ["a", "b"], "ord", trees=n).collect()}
        far = {r.ord: r.p for r in trees.fit_predict(name, t, t, ["region", "spid"], ["a", "b"], "ord", one_task=0, trees=n).collect()}
        assert len(own) == 3000 and own == pytest.approx(far, abs=1e-9)
