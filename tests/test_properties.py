"""Queries without SQL, against brute force or what must hold of their results."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faunaflux.operators import compare, features, learners, report
from faunaflux.plans import catalogue, views

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.load()
CHECKED = set()


def rows(spark, name):
    CHECKED.add(name)
    return QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def occ(spark):
    return views.occ(spark, SF).collect()


def t_tail(t, df):
    """Two-sided tail of Student's t, by the trapezoid rule."""
    x = np.linspace(-abs(t), abs(t), 200_001)
    log = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return 1 - np.trapezoid(np.exp(log - (df + 1) / 2 * np.log1p(x * x / df)), x)


MODELS = ["model_adaboost", "model_brt", "model_decision_tree", "model_extra_trees", "model_gam", "model_gradient_boosting", "model_linear_svc", "model_logistic_regression", "model_maxnet", "model_mlp_mllib", "model_random_forest", "model_random_forest_mllib", "model_subsample_ensemble", "model_svm", "late_fusion", "fusion_gated", "fusion_moe"]


#: Few rounds and trees, as each of 25 groups has a model of its own here.
CHEAP = {"random-forest": {"trees": 3}, "extra-trees": {"trees": 3}, "brt": {"trees": 50}, "mlp-mllib": {"maxIter": 3}}


@pytest.mark.parametrize("name", MODELS)
def test_every_test_row_gets_a_probability(spark, occ, monkeypatch, name):
    real = learners.predict
    monkeypatch.setattr(learners, "predict", lambda model, *a, **o: real(model, *a, **(CHEAP.get(model, {}) | o)))
    got = rows(spark, name)
    both = {g for g in {(r.region, r.spid) for r in occ} if {r.part for r in occ if (r.region, r.spid) == g} == {"train", "test"}}
    want = {r.ord for r in occ if r.part == "test" and ("fusion" in name or (r.region, r.spid) in both)}
    assert {r.ord for r in got} == want and len(got) == len(want)
    assert all(r.p is not None and 0 <= r.p <= 1 for r in got)


def test_shapley_values_of_trees_add_up(spark):
    """Mean values of a group's features are its mean margin less that of the model."""
    from faunaflux.operators import explain, trees

    t = views.occ(spark, SF)
    a, b = t.where("part = 'train'"), t.where("part = 'test'")
    model = trees.fit(a, ["region", "spid"], views.PREDICTORS, "ord", trees.SPECS["gradient-boosting"])
    mean = {(r.region, r.spid): r.m for r in explain.tree_shapley(model, b, ["region", "spid"], views.PREDICTORS, "ord").groupBy("region", "spid").agg({"mean": "avg"}).withColumnRenamed("avg(mean)", "m").collect()}
    p = trees.apply(model, b, ["region", "spid"], views.PREDICTORS, "ord", trees.SPECS["gradient-boosting"]).collect()
    margin = defaultdict(list)
    for r in p:
        margin[r.region, r.spid].append(math.log(r.p / (1 - r.p)))
    sums = defaultdict(float)
    got = rows(spark, "tree_shapley")
    assert len(got) == 3 * len(mean) and all(r.mean_abs >= abs(r.mean) - 1e-6 for r in got)
    for r in got:
        sums[r.region, r.spid] += r.mean
    assert all(sums[k] + mean[k] == pytest.approx(np.mean(margin[k]), abs=1e-5) for k in mean)


def test_compute_metrics(spark):
    got = {(r.region, r.species_id, r.model_name): r for r in rows(spark, "compute_metrics") if getattr(r, "scenario", "nonspatial") == "nonspatial"}
    sides = defaultdict(list)
    for r in views.pred(spark, SF).where("scenario = 'nonspatial'").collect():
        sides[r.region, r.species_id, r.model_name].append((r.y, r.p))
    for k, pairs in sides.items():
        y, p = (np.array(v, float) for v in zip(*pairs, strict=True))
        if k in got and "brier" in got[k].__fields__:
            assert got[k].brier == pytest.approx(((p - y) ** 2).mean(), abs=2e-6)
        if k in got and 0 < y.sum() < len(y):
            wins = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
            assert got[k].roc_auc == pytest.approx(wins, abs=2e-6)


def test_interval_of_means(spark):
    for r in rows(spark, "summarise_interval"):
        if r.n > 1 and r.se:
            assert t_tail((r.ci_high - r.mean) / r.se, r.n - 1) == pytest.approx(0.05, abs=1e-3)
            assert r.ci_high - r.mean == pytest.approx(r.mean - r.ci_low, abs=3e-6)


def test_critical_values_beyond_the_table(spark):
    from faunaflux.operators import board
    from faunaflux.functions.stats import t_critical

    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in (1, 2, 5, 301, 302, 500, 10_000)], "n long").select("n", board.critical_value(F.col("n"), 0.95).alias("t")).collect()}
    assert got.pop(1) is None and all(t == pytest.approx(t_critical(n - 1), abs=1e-9) for n, t in got.items())


def differences(spark):
    out = defaultdict(list)
    for r in compare.paired(views.results(spark, SF), scenario="nonspatial").collect():
        out[r.model_a, r.model_b].append(r["diff"])
    return out


def test_p_values(spark):
    diffs = differences(spark)
    got = {(r.model_a, r.model_b): r for r in rows(spark, "p_values")}
    assert set(got) == set(diffs)
    for k, x in diffs.items():
        x = np.array(x)
        if len(x) >= 3 and x.any() and x.std() > 0:
            t = x.mean() / (x.std(ddof=1) / math.sqrt(len(x)))
            assert got[k].ttest_p == pytest.approx(t_tail(t, len(x) - 1), abs=1e-4)
            assert 0 <= got[k].wilcoxon_p <= 1


def test_comparison(spark):
    diffs = differences(spark)
    for r in rows(spark, "compare_models"):
        x = diffs[r.model_a, r.model_b]
        assert r.n == len(x) and r.mean_difference == pytest.approx(np.mean(x), abs=2e-6) and r.wins + r.losses + r.ties == r.n
        if r.n > 1:
            assert min(x) - 1e-6 <= r.ci_low <= r.ci_high <= max(x) + 1e-6
        clear = r.n >= 3 and (r.ci_low > 0 or r.ci_high < 0) and r.p_adjusted is not None and r.wilcoxon_p < 0.05
        assert (r.verdict.endswith("_BETTER")) == bool(clear)


def test_roles_and_schema(spark):
    roles = {r.column: r.role for r in rows(spark, "inspect_columns")}
    assert roles["occ"] == "target" and roles["x"] == "longitude" and roles["y"] == "latitude" and roles["prio"] == "categorical"
    draft = {r.role: r.column for r in rows(spark, "draft_schema")}
    assert draft["target"] == "occ" and draft["longitude"] == "x" and draft["latitude"] == "y"
    found = [(r.level, r.message) for r in rows(spark, "validate_table")]
    assert any(level == "error" and "absent" in m for level, m in found)


def test_pca(spark, occ):
    x = np.array([[r.price, r.acct, r.age] for r in sorted(occ, key=lambda r: r.ord)])
    x = x - x.mean(0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    got = np.array([r.pc for r in sorted(rows(spark, "pca"), key=lambda r: r.ord)])
    for k in range(2):
        want = x @ axes[k]
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-3 * np.abs(want).max()


def test_ica_gives_uncorrelated_sources(spark, occ):
    """By the operator, as the query rounds weights of large columns away."""
    assert len(rows(spark, "fast_ica")) == 2 * 3 * len({r.region for r in occ})
    weights = defaultdict(dict)
    for r in features.fast_ica(views.occ(spark, SF), ["region"], ["price", "acct", "age"], 2).collect():
        weights[r.region][r.component, r.column] = r.weight
    for region, w in weights.items():
        x = np.array([[r.price, r.acct, r.age] for r in occ if r.region == region])
        s = (x - x.mean(0)) @ np.array([[w[k, c] for k in range(2)] for c in ("price", "acct", "age")])
        assert np.abs(np.cov(s.T, bias=True) - np.eye(2)).max() < 1e-6


def test_recipe(spark, occ):
    got = rows(spark, "recipe_fit_transform")
    assert {r.ord for r in got} == {r.ord for r in occ if r.part == "test"}
    assert all(abs(v) < 50 for r in got for v in (r.price, r.acct, r.age) if v is not None) and all(r.prio_code >= -1 for r in got)


def test_patches(spark, occ):
    e = {(r.src, r.dst) for r in rows(spark, "graph_patch")}
    assert e == {(b, a) for a, b in e} and all(a != b for a, b in e)
    assert max(a for a, _ in e) == max(2, len(occ) // 20) - 1


def test_smoothing(spark, occ):
    got = {r.ord: r.age for r in rows(spark, "graph_smoothing")}
    groups = defaultdict(list)
    for r in occ:
        groups[r.region, r.spid].append(r)
    for g in groups.values():
        xy = np.array([[r.x, r.y] for r in g])
        a = (np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) <= 9000).astype(float)
        a /= np.sqrt(np.outer(a.sum(1), a.sum(1)))
        want = a @ a @ np.array([r.age for r in g])
        assert all(got[r.ord] == pytest.approx(v, abs=1e-3) for r, v in zip(g, want, strict=True))


def test_tuning(spark):
    got = rows(spark, "inner_cv_tuning")
    assert got and all(r.place in (0, 1) and 0 <= r.score <= 1 for r in got if r.place is not None)


def test_content_hash(spark):
    t = views.table(spark, SF, "customer")
    (row,) = rows(spark, "content_hash")
    again = report.content_hash(t.repartition(5).select(*reversed(t.columns))).first().digest
    assert row.digest == again != report.content_hash(t.withColumn("c_name", F.concat("c_name", F.lit("x")))).first().digest


def test_plans(spark):
    got = rows(spark, "plan_all")
    by = defaultdict(list)
    for r in got:
        by[r.stage].append(r)
    assert set(by) == {"information", "scale", "representation", "fusion", "spatial", "objective", "model"}
    assert all(len({r.key for r in rs}) == len(rs) for s, rs in by.items() if s != "scale") and [r.place for r in by["model"]] == list(range(11))


def test_benchmark_run(spark, occ):
    got = rows(spark, "benchmark_run")
    by = defaultdict(set)
    for r in got:
        by[r.job_id.rsplit("__", 1)[-1]].add(r.status)
    assert by["xgboost"] == {"SKIPPED_DEPENDENCY"} and all("OK" in by[m] for m in ("dummy", "gaussian-nb", "logistic-regression", "knn"))
    assert all(r.roc_auc == 0.5 for r in got if r.job_id.endswith("__dummy") and r.roc_auc is not None)
    assert all(r.roc_auc is None for r in got if r.status != "OK")


def test_nothing_is_left_out():
    assert set(QUERIES) - set(ORACLES) <= CHECKED
