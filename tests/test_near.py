"""Pairs within a radius, their counts and sums against all pairs; counts and smoothing build no edges."""

import numpy as np
import pytest

from faunaflux.operators import graphs, learners, near
from faunaflux.plans import catalogue


def table(spark, n=900, seed=2):
    """Two groups, points on a grid whose distances meet the radius, many rows at one point, far points, lost coordinates."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in ("u", "v"):
        x = np.r_[rng.uniform(-3, 3, (n // 2, 2)), np.stack(np.meshgrid(range(12), range(12)), 2).reshape(-1, 2) / 2, np.full((40, 2), 0.25), [[1e7, -1e7], [1e7 + 0.5, -1e7]]]
        rows += [(g, len(rows) + i, float(a), float(b), float(rng.normal())) for i, (a, b) in enumerate(x)]
    rows += [("u", -1, None, 1.0, 2.0), ("v", -2, float("nan"), 1.0, None)]
    return spark.createDataFrame(rows, "g string, node long, x double, y double, z double").repartition(3), rows


def brute(rows, r):
    out = set()
    for g in ("u", "v"):
        own = [(n, x, y) for k, n, x, y, _ in rows if k == g and x is not None and x == x]
        x, n = np.array([[a, b] for _, a, b in own]), [i for i, _, _ in own]
        far = np.sqrt((x[:, None, 0] - x[None, :, 0]) ** 2 + (x[:, None, 1] - x[None, :, 1]) ** 2) <= r * (1 + 1e-12)
        out |= {(g, n[i], n[j]) for i, j in zip(*np.nonzero(far), strict=True) if i != j}
    return out


@pytest.mark.parametrize("radius", [0.5, 2.0])
def test_pairs_degrees_and_smoothing_equal_all_pairs(spark, radius):
    t, rows = table(spark)
    want = brute(rows, radius)
    found = [(r.g, r.src, r.dst) for r in graphs.radius_edges(t, ["g"], "node", radius).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    edges = spark.createDataFrame(sorted(want), "g string, src long, dst long")
    stats = lambda x: {r.g: r.asDict() for r in x.collect()}
    assert stats(graphs.radius_degrees(t, ["g"], "node", radius)) == stats(graphs.degree_stats(edges, t, ["g"], "node"))
    smooth = lambda x: {r.node: r.z for r in x.collect()}
    got, own = smooth(graphs.radius_smoothed(t, ["g"], "node", ["z"], radius)), smooth(learners.graph_smoothed(t, edges, ["g"], "node", ["z"]))
    assert got.keys() == own.keys() and all(got[k] == (own[k] if own[k] is None else pytest.approx(own[k], abs=1e-9)) for k in own)


def test_cells_of_a_crowded_block():
    """Many rows: small cells, of which most are taken or left as a whole."""
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 6, (6000, 2))
    b = near.Block(x, np.ones(6000, bool), 1.0, False)
    looked = 0
    for own, whole, some in b:
        got = b.near(own, some).sum(1) + b.count[whole].sum()
        looked += len(own) * len(some)
        far = np.sqrt(((b.x[own][:, None] - b.x[None]) ** 2).sum(2)) <= 1 + 1e-12
        assert (got == far.sum(1)).all()
    assert looked < 0.1 * 6000 * 6000


def test_queries_build_no_edges(spark, monkeypatch):
    """graph_degree_stats and graph_smoothing made every edge of the graph and joined them."""
    monkeypatch.setattr(graphs, "radius_edges", None)
    for name in ("graph_degree_stats", "graph_smoothing"):
        assert catalogue.load()[0][name](spark, "/root/testdata/sf0.001").count()
