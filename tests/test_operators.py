import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faunaflux.functions import scalar, stats
from faunaflux.operators import audit, board, compare, graphs, learners, metrics, recipe, report, resample, spatial, tasks
from faunaflux.plans import planner, registry
from faunaflux.runner import Benchmark
from faunaflux.schemas import DataError, empty_results
from faunaflux.sources import survey
from faunaflux.streaming import results as stream


def pred(spark, rows):
    return spark.createDataFrame([(k, int(y), float(p)) for k, ys, ps in rows for y, p in zip(ys, ps, strict=True)], "k string, y int, p double")


def test_discrimination_on_planted_vectors(spark):
    t = pred(spark, [("separable", [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), ("inverted", [0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1]), ("constant", [0, 1, 0, 1], [0.5] * 4), ("single", [1] * 5, [0.1, 0.3, 0.5, 0.7, 0.9])])
    got = {r.k: r for r in metrics.compute_metrics(t, ["k"], metrics.METRICS).collect()}
    assert [got[k].roc_auc for k in ("separable", "inverted", "constant", "single")] == [1.0, 0.0, 0.5, None]
    assert got["separable"].sensitivity == got["separable"].specificity == 1.0
    assert got["single"].pr_auc is None and got["constant"].calibration_slope is None and got["single"].calibration_slope is None


def test_calibration_slopes(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 8000)
    y = (rng.uniform(size=8000) < p).astype(int)
    z = np.log(p / (1 - p))
    t = pred(spark, [("calibrated", y, p), ("over", y, 1 / (1 + np.exp(-2 * z))), ("under", y, 1 / (1 + np.exp(-z / 2)))])
    got = {r.k: r.calibration_slope for r in metrics.miller_calibration(t, ["k"]).collect()}
    assert abs(got["calibrated"] - 1) < 0.1 and got["over"] < 0.9 and got["under"] > 1.1


def test_boyce_sees_skill(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(size=3000)
    t = pred(spark, [("good", rng.uniform(size=3000) < p, p), ("random", rng.uniform(size=3000) < 0.5, p)])
    got = {r.k: r.boyce for r in metrics.continuous_boyce(t, ["k"]).collect()}
    assert got["good"] > 0.7 and abs(got["random"]) < 0.7


def test_unknown_names_raise(spark):
    with pytest.raises(KeyError):
        metrics.validate_metric_names(["nonsense"])
    with pytest.raises(ValueError):
        metrics.pr_auc(pred(spark, []), ["k"], method="x")
    with pytest.raises(ValueError):
        compare.adjust(pred(spark, []), "p", "x")


def test_distances(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 9999.0, 0.0), (3, 10001.0, 0.0), (4, 10000.0, 0.0)], "id long, x double, y double")
    r = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    assert {i.id for i in spatial.within_distance(q, r, 10_000).collect()} == {1, 2, 4}
    assert {i.id for i in spatial.within_distance(q, r, 10_000, how="left_anti").collect()} == {3}
    g = spark.createDataFrame([(1, 179.99, 0.0), (2, 0.0, 0.2), (3, -10.0, 89.99)], "id long, x double, y double")
    s = spark.createDataFrame([(-179.99, 0.0), (0.0, 0.0), (170.0, 89.99)], "x double, y double")
    assert {i.id for i in spatial.within_distance(g, s, 10_000, geographic=True).collect()} == {1, 3}
    assert spatial.within_distance(q, r.limit(0), 10_000).count() == 0


def test_distance_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform((-180, -90), (180, 90), (200, 2)), rng.uniform((-180, -90), (180, 90), (50, 2))
    u = lambda c: np.stack([np.cos(np.radians(c[:, 1])) * np.cos(np.radians(c[:, 0])), np.cos(np.radians(c[:, 1])) * np.sin(np.radians(c[:, 0])), np.sin(np.radians(c[:, 1]))], 1)
    near = (np.linalg.norm(u(a)[:, None] - u(b)[None], axis=2) <= scalar.chord(1_000_000)).any(1)
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id long, x double, y double")
    r = spark.createDataFrame([tuple(map(float, p)) for p in b], "x double, y double")
    assert {i.id for i in spatial.within_distance(q, r, 1_000_000, geographic=True).collect()} == set(np.flatnonzero(near).tolist())


def occurrences(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for sp in ("sp01", "sp02"):
        for i in range(n):
            x, y = rng.uniform(0, 100_000, 2)
            bio = y / 20_000 + rng.normal()
            rows.append(("TEST", sp, f"s{i}", float(x), float(y), int(rng.uniform() < 1 / (1 + math.exp(-(bio - 3)))), float(bio), float(rng.normal()), str(rng.integers(1, 4)), "test" if i % 4 == 0 else "train", i))
    return spark.createDataFrame(rows, "region string, spid string, siteid string, x double, y double, occ int, bio01 double, bio12 double, vegsys string, part string, ord long")


def test_recipe_is_fitted_on_training_rows(spark):
    df = occurrences(spark)
    train, test = df.where("part = 'train'"), df.where("part = 'test'").withColumn("bio01", F.col("bio01") + 1000)
    r = recipe.SdmRecipe(["spid"], ["bio01", "bio12"], ["vegsys"]).fit(train, "ord")
    z = r.transform(train).groupBy("spid").agg(F.avg("bio01").alias("m"), F.stddev_samp("bio01").alias("s")).collect()
    assert all(abs(i.m) < 1e-6 and abs(i.s - 1) < 1e-6 for i in z)
    assert r.transform(test).agg(F.avg("bio01")).first()[0] > 3
    unseen = r.transform(test.withColumn("vegsys", F.lit("9"))).select("vegsys", "vegsys_code").distinct().collect()
    assert [tuple(u) for u in unseen] == [(None, -1)]
    with pytest.raises(DataError):
        r.transform(test.drop("bio12"))


def test_lambda_is_the_likeliest(spark):
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(size=500))
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")

    def llf(lam):
        t = np.log1p(x) if abs(lam) < 1e-8 else ((x + 1) ** lam - 1) / lam
        return -len(x) / 2 * np.log(t.var()) + (lam - 1) * np.log1p(x).sum()

    got = recipe.lambda_mle(df, ["k"], ["v"]).first().lam
    assert llf(got) >= max(llf(v) for v in np.linspace(-5, 5, 501)) - 1e-4


def test_audit_finds_planted_leaks(spark):
    df = occurrences(spark)
    train, test = df.where("part = 'train'"), df.where("part = 'test'")
    keys, f = ["region", "spid"], ["bio01", "bio12"]
    assert {r.status for r in audit.audit(train, test, keys, f).collect()} == {"PASS"}
    leak = train.unionByName(test.where("spid = 'sp01'").limit(1))
    assert {r.spid: r.status for r in audit.audit(leak, test, keys, f).collect()} == {"sp01": "FAIL", "sp02": "PASS"}
    assert {r.status for r in audit.audit(train, test, keys, f, buffer_m=50_000).collect()} == {"FAIL"}
    buffered = spatial.apply_buffer(train, test, keys, 3000)
    assert {r.status for r in audit.audit(buffered, test, keys, f, buffer_m=3000).collect()} == {"PASS"}
    same = audit.target_copies(df.withColumn("c", F.col("occ").cast("double")), ["c", "bio01"])
    assert {r.feature: r.is_copy for r in same.collect()} == {"c": True, "bio01": False}


def test_resampling_invariants(spark):
    df = occurrences(spark)
    part = {(r.spid, r.occ, r.part): r.n for r in resample.stratified_holdout(df.drop("part"), ["spid"], "ord").groupBy("spid", "occ", "part").agg(F.count("*").alias("n")).collect()}
    assert all(part[s, o, "test"] == round(0.2 * (part[s, o, "test"] + part[s, o, "train"])) for s in ("sp01", "sp02") for o in (0, 1))
    members = resample.member_counts(resample.balanced_members(df, ["spid"], "ord", k=3), ["spid"]).collect()
    assert len(members) == 6 and all(m.n_presence == m.n_background for m in members if m.n_background < 100)
    parts = resample.partition_members(df, ["spid"], "ord", k=3)
    assert parts.where("occ = 0").groupBy("spid", "ord").count().where("count > 1").count() == 0
    folds = spatial.spatial_folds(df, ["spid"], 4)
    assert folds.groupBy("spid", "block").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        spatial.spatial_folds(df, ["spid"], 1)


def test_statistics_against_known_values():
    assert abs(stats.t_critical(9) - 2.2621571) < 1e-6 and abs(stats.t_two_sided(2.0, 5) - 0.1019395) < 1e-6
    w, p = stats.wilcoxon_p([1.0, 2.0, 3.0, 4.0, 5.0])
    assert w == 0 and abs(p - 0.0625) < 1e-12
    assert stats.wilcoxon_p([0.0, 0.0])[1] is None and stats.paired_t_p([1.0, 1.0]) is None


def results(spark):
    rng = np.random.default_rng(0)
    rows = []
    for region in ("A", "B"):
        for s in range(15):
            hard = rng.normal(0.75, 0.05)
            for model, shift in (("model-a", 0.03), ("model-b", 0.0), ("model-c", -0.05)):
                rows.append(("nonspatial", region, f"s{s}", model, "OK", float(hard + shift + rng.normal(0, 0.01)), 1.0))
    return spark.createDataFrame(rows, "scenario string, region string, species_id string, model_name string, status string, roc_auc double, runtime double")


def test_board_and_comparison_find_the_planted_order(spark):
    r = results(spark)
    assert [x.model_name for x in board.leaderboard(r).orderBy("rank").collect()] == ["model-a", "model-b", "model-c"]
    assert {x.n_species for x in board.leaderboard(r).collect()} == {30}
    t = {(x.model_a, x.model_b): x for x in compare.compare_models(r, n_boot=200).collect()}
    assert t["model-a", "model-c"].verdict == "model-a_BETTER" and t["model-a", "model-c"].wins == 30
    assert t["model-a", "model-b"].ci_low <= t["model-a", "model-b"].mean_difference <= t["model-a", "model-b"].ci_high
    assert board.markdown(board.leaderboard(r)).count("\n") == 4
    none = board.leaderboard(r.withColumn("status", F.lit("FAILED")))
    assert none.count() == 3 and board.leaderboard(r.withColumn("status", F.lit("FAILED")), min_species=2).count() == 0


def test_calibration_ranks_by_distance_from_one(spark):
    b = spark.createDataFrame([("under", 0.5), ("good", 1.02), ("over", 1.6)], "model_name string, m double")
    assert board.ranked(b, board.direction_key(F.col("m"), "calibration_slope")).orderBy("rank").first().model_name == "good"


def test_graphs(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(60, 2))
    df = spark.createDataFrame([("g", i, *map(float, p)) for i, p in enumerate(x)], "k string, id long, x double, y double")
    got = {(r.src, r.dst) for r in graphs.knn_edges(df, ["k"], "id", ["x", "y"], 3).collect()}
    dist = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 60)
    assert got == {(i, int(j)) for i in range(60) for j in np.argsort(dist[i])[:3]}
    near = {(r.src, r.dst) for r in graphs.radius_edges(df, ["k"], "id", 0.2).collect()}
    assert near == {(int(i), int(j)) for i, j in zip(*np.nonzero(dist <= 0.2), strict=True)}
    with pytest.raises(ValueError):
        graphs.user_graph(spark.createDataFrame([(0, 9)], "src long, dst long"), 5)


def test_runner_and_store(spark, tmp_path):
    df = occurrences(spark)
    b = Benchmark(df.where("part = 'train'"), df.where("part = 'test'"), ["bio01", "bio12"], "unit", buffer_m=2000)
    out = b.run(["dummy", "gaussian-nb", "xgboost"], ("nonspatial", "spatial"))
    report.write_results(out, f"{tmp_path}/results")
    back = report.read_results(spark, f"{tmp_path}/results")
    rows = back.collect()
    assert len(rows) == 12 and {r.status for r in rows if r.model_name == "xgboost"} == {"SKIPPED_DEPENDENCY"}
    assert all(r.roc_auc == 0.5 for r in rows if r.model_name == "dummy") and all(r.roc_auc > 0.6 for r in rows if r.model_name == "gaussian-nb")
    assert b.run(["dummy"], done=back).count() == 0
    assert empty_results(spark).count() == 0
    assert learners.skip_rows(spark.createDataFrame([("knn",)], "model_name string")).count() == 0


def test_survey_layout_and_csv(spark, tmp_path):
    df = occurrences(spark).drop("part", "ord")
    s = survey.SurveyDataset(spark, f"{tmp_path}/survey")
    for t in survey.TABLES:
        s.write(df, t)
    assert s.summary().first().n_species == 2 and s.table("po", "test").count() == 480
    assert s.training().where("occ = 0").count() == 960
    with pytest.raises(DataError):
        s.table("xx")
    df.select(F.col("x").alias("longitude"), F.col("y").alias("latitude"), "bio01", F.when(F.col("occ") == 1, "yes").otherwise("no").alias("presence")).coalesce(1).write.csv(f"{tmp_path}/t.csv", header=True)
    t = survey.read_csv(spark, f"{tmp_path}/t.csv")
    assert t.where("occ is null").count() == 0 and "bio01" in t.columns
    assert tasks.validate_table(t, "occ", "x", "y", ["bio01", "zz"]) == [("error", "predictor 'zz' is missing"), ("warning", "coordinates beyond 180 degrees"), ("warning", "coordinates beyond 90 degrees")]
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, -9999.0)], "row int, col int, b double")
    pts = spark.createDataFrame([(1, 5.0, 95.0), (2, 15.0, 95.0)], "id long, x double, y double")
    assert {r.id: r.b for r in survey.extract_at_points(cells, pts, 0, 100, 10, 10, ["b"], -9999.0).collect()} == {1: 1.0, 2: None}


def test_stream_board(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"job_id": j, "model_name": "m", "status": "OK", "roc_auc": a, "created_at": "2024-01-01T00:00:00Z"} for j, a in (("a", 0.6), ("b", 0.8), ("a", 0.6))]
    (tmp_path / "in/r.json").write_text("\n".join(map(json.dumps, rows)))
    q = stream.start_board(stream.read_stream(spark, f"{tmp_path}/in"), "running", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.table("running").first().n_jobs == 3
    once = stream.once_per_job(stream.read_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_planner_and_registry():
    m = planner.Methodology("m", (planner.Modality("climate"), planner.Modality("soil")))
    p = planner.StagedPlanner(m, n_species=10, n_scenarios=2)
    assert [x.name for x in p.information()] == ["all-modalities", "only-climate", "only-soil"] and p.estimated_jobs(p.model()) == 220  # leaving one of two out is the other alone
    two = planner.StagedPlanner(m, top_k=2)
    nxt = two.next_stage("objective", [m, m.only("soil"), m.only("climate")])
    assert len(nxt.plans) == 12 and nxt.baseline == m and not two.next_stage("fusion", [m.only("soil")]).plans
    with pytest.raises(ValueError):
        two.next_stage("model", [])
    assert m.validate() == [] and planner.Methodology("x", (planner.Modality("a", "raster", "pca", ()),), fusion="moe").validate()
    g = planner.experiment_graph(m, "d", "s", prefix="a/")
    planner.experiment_graph(m.only("climate"), "d", "s", g, "b/")
    assert g.savings()["duplicates_avoided"] == 3
    with pytest.raises(ValueError):
        g.add("a/split", "split", {})
    assert registry.resolve_models("classical, knn") == ["logistic-regression", "knn", "decision-tree", "gaussian-nb"]
    with pytest.raises(KeyError):
        registry.MODELS.get("nonsense")
    r = registry.Registry("thing")
    r.add("a", None, "b")
    with pytest.raises(ValueError):
        r.add("b")
