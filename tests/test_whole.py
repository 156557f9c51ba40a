"""Queries over the whole occurrence view, against brute force on the smallest tables."""

from collections import defaultdict

import numpy as np
import pytest

from faunaflux.plans import catalogue, views

SF = "/root/testdata/sf0.001"
QUERIES, _ = catalogue.load()


@pytest.fixture(scope="module")
def groups(spark):
    out = defaultdict(list)
    for r in views.occ(spark, SF).select("region", "spid", "ord", "x", "y", "age", "price", "part", "occ", "prio").collect():
        out[r.region, r.spid].append(r)
    return {g: sorted(rows, key=lambda r: r.ord) for g, rows in out.items()}


def points(rows, columns, scaled=False, weights=None):
    v = np.array([[float(r[c]) for c in columns] for r in rows])
    if scaled and len(v) > 1:
        v = (v - v.mean(0)) / v.std(0, ddof=1)
    return v * np.sqrt(weights) if weights else v


def edges(spark, name):
    return {((r.region, r.spid), r.src, r.dst) for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name,k,columns,scaled,weights", [("graph_knn_geo", 8, ["x", "y"], False, None), ("graph_knn_env", 5, ["age", "price"], True, None), ("graph_hybrid", 5, ["x", "y", "age", "price"], True, [0.5] * 4)])
def test_nearest(spark, groups, name, k, columns, scaled, weights):
    got = edges(spark, name)
    want = set()
    for g, rows in groups.items():
        v = points(rows, columns, scaled, weights)
        for i, r in enumerate(rows):
            dist = np.sqrt(((v - v[i]) ** 2).sum(1))
            dist[i] = np.inf
            for j in np.argsort(dist, kind="stable")[: min(k, len(rows) - 1)]:
                want |= {(g, r.ord, rows[j].ord), (g, rows[j].ord, r.ord)}
    assert got == want


def test_radius_and_degrees(spark, groups):
    want, isolated = set(), {}
    for g, rows in groups.items():
        v = points(rows, ["x", "y"])
        near = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= 9000
        np.fill_diagonal(near, False)
        want |= {(g, rows[i].ord, rows[j].ord) for i, j in zip(*np.nonzero(near), strict=True)}
        isolated[g] = (len(rows), int(near.sum()), int((~near.any(1)).sum()))
    assert edges(spark, "graph_radius") == want
    stats = QUERIES["graph_degree_stats"](spark, SF).collect()
    assert {(r.region, r.spid): (r.n_nodes, r.n_edges, r.isolated_nodes) for r in stats} == isolated


def test_gate_and_union(spark, groups):
    classes, background = defaultdict(set), defaultdict(int)
    for (region, _), rows in groups.items():
        for r in rows:
            classes[region, r.spid, r.prio, r.x // 4000].add(r.occ)
            background[region] += r.part == "train" and r.occ == 0
    got = {tuple(r[c] for c in ("region", "spid", "prio", "zone")) for r in QUERIES["both_classes_gate"](spark, SF).collect()}
    assert got == {k for k, v in classes.items() if v == {0, 1}}
    for r in QUERIES["task_train_union"](spark, SF).where("occ = 0").collect():
        assert r.n == background[r.region]


def test_every_node_and_group(spark, groups):
    nodes = {r.ord for rows in groups.values() for r in rows}
    assert {r.ord for r in QUERIES["graph_smoothing"](spark, SF).collect()} == nodes
    tuned = {(r.region, r.spid) for r in QUERIES["inner_cv_tuning"](spark, SF).collect()}
    assert {s for _, s in tuned} == {s for _, s in groups}
    assert QUERIES["graph_patch"](spark, SF).agg({"src": "max"}).first()[0] == len(nodes) // 20 - 1
