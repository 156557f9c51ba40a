"""Neighbours by a k-d partition against comparing all pairs: ties, equal points, missing values, small groups, long groups of many leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faunaflux.operators import graphs, learners, neighbours


def brute(ids, x, k, manhattan=False, asks=None, ask_ids=None):
    out = {}
    for i, v in zip(ids if asks is None else ask_ids, x if asks is None else asks):
        gap = x - v
        dist = np.abs(gap).sum(1) if manhattan else np.sqrt((gap * gap).sum(1))
        order = sorted((d, j) for d, j in zip(dist.tolist(), ids) if asks is not None or j != i)[:k]
        out[i] = order
    return out


@pytest.mark.parametrize("width,k", [(2, 8), (5, 3)])
def test_rows_equal_all_pairs(spark, monkeypatch, width, k):
    """Groups of many leaves and of two rows; half of a group at one point, points on a grid that tie."""
    monkeypatch.setattr(neighbours, "LEAF", 16)
    rng = np.random.default_rng(4)
    groups = {"grid": np.array([[i % 20, i // 20, *[0] * (width - 2)] for i in range(300)], float), "hot": np.where(np.arange(200)[:, None] % 2 == 0, 1.0, rng.normal(size=(200, width))), "two": rng.normal(size=(2, width)), "wide": rng.normal(size=(500, width)) ** 3}
    rows, want = [], {}
    for g, x in groups.items():
        ids = list(range(len(rows), len(rows) + len(x)))
        rows += [(g, i, *map(float, v)) for i, v in zip(ids, x)]
        want |= brute(ids, x, k)
    axes = [f"a{i}" for i in range(width)]
    df = spark.createDataFrame(rows, "g string, node long, " + ", ".join(f"{a} double" for a in axes))
    lost = df.limit(1).withColumn("node", F.lit(-1).cast("long")).withColumn("a0", F.lit(None).cast("double"))
    got = {}
    for r in graphs.knn_edges(df.unionByName(lost), ["g"], "node", axes, k).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dist, r.dst))
    assert {i: [(d, j) for _, d, j in sorted(v)] for i, v in got.items()} == {i: v for i, v in want.items() if v}


def test_names_as_rows_and_groups_without_points(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 8)
    rng = np.random.default_rng(1)
    x, z = rng.integers(0, 6, size=(120, 3)).astype(float), rng.integers(0, 6, size=(50, 3)).astype(float)
    train = [("r", "s", f"t{i}", *map(float, v), int(i % 3 == 0)) for i, v in enumerate(x)]
    test = [("r", "s", f"q{i}", *map(float, v), 0) for i, v in enumerate(z)] + [("r", "nothing", "lone", 0.0, 0.0, 0.0, 1)]
    schema = "region string, spid string, siteid string, a double, b double, c double, occ int"
    keys = ["region", "spid"]
    got = {r.siteid: r.p for r in learners.knn(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), keys, ["a", "b", "c"], "siteid", k=7).collect()}
    near = brute([t[2] for t in train], x, 7, True, z, [t[2] for t in test[:50]])
    occ = {t[2]: t[6] for t in train}
    assert got == pytest.approx({q: np.mean([occ[j] for _, j in v]) for q, v in near.items()})


def test_few_leaves_are_asked(monkeypatch):
    """In a plane, balls reach a few leaves, however many there are."""
    rng = np.random.default_rng(2)
    for n in (2_000, 32_000):
        x = rng.uniform(size=(n, 2))
        tree = {k: np.asarray(v) for k, v in neighbours.kd_tree(x, n // 64).items()}
        own = neighbours.leaf_of(x, tree)
        assert np.bincount(own).max() <= 130
        radius = np.full(n, np.sqrt(8 / n / np.pi) * 1.3)
        rows, leaves = neighbours.reached(x, radius, own, tree, False)
        assert len(rows) < 2 * n and (leaves != own[rows]).all()
