"""Encoders and fusion, rasters, provenance, results and inference of schemas."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from faunaflux import provenance
from faunaflux.operators import encoders, graphs, learners, report, tasks
from faunaflux.plans import registry
from faunaflux.runner import Benchmark
from faunaflux.schemas import RESULT_COLUMNS, DataError, SkippableError
from faunaflux.sources import survey
from faunaflux.sources.raster import RasterDataset, RasterStack


def table(spark, n=60):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + rng.normal(scale=0.5, size=n) > 0).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), float(c), "uv"[i % 2], int(o)) for i, ((a, b, c), o) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, kind string, occ int")


def values(df):
    return {r.id: r.value for r in df.collect()}


def test_encoders_fit_on_training_rows(spark):
    t = table(spark)
    train, test = t.where("id < 40"), t.where("id >= 40")
    with pytest.raises(DataError):
        encoders.Standardized("id", ["a"]).transform(test)
    with pytest.raises(DataError):
        encoders.Raw("id", ["a"]).fit(train, "raster")
    e = encoders.Standardized("id", ["a", "b"]).fit(train)
    x = np.array([(r.a, r.b) for r in train.orderBy("id").collect()])
    got = values(e.transform(test))
    want = {r.id: (np.array([r.a, r.b]) - x.mean(0)) / x.std(0, ddof=1) for r in test.collect()}
    assert all(np.allclose(got[i], want[i]) for i in want) and e.describe()["fitted_on"] == "train"
    assert values(encoders.Raw("id", ["a"]).fit_transform(t))[3] == [t.where("id = 3").first().a]
    c = encoders.Categorical("id", ["kind"]).fit(train.where("kind = 'u'"))
    assert values(c.transform(test.limit(4).withColumn("kind", F.lit("zz")))) and all(v == [0.0] for v in values(c.transform(test.withColumn("kind", F.lit("zz")))).values())
    p = encoders.Pca("id", ["a", "b", "c"], k=2).fit(train)
    assert len(next(iter(values(p.transform(test)).values()))) == 2 and len(p.explained) == 2
    patch = spark.createDataFrame([(1, [1.0, 2.0, float("nan")], [4.0])], "id long, s array<double>, l array<double>")
    assert len(values(encoders.PatchStatistics("id", ["s", "l"]).fit_transform(patch, "raster"))[1]) == 10
    assert values(encoders.IdentityEmbedding("id", ["s"]).fit_transform(patch, "embedding"))[1] == [1.0, 2.0, 0.0]
    series = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "id long, t int, v double")
    assert values(encoders.TemporalSummary("id", ["t", "v"]).fit_transform(series, "sequence"))[1] == [2.0, 3.0, 1.0, 2.0, 4.0, 2.0, 4.0, 2.0]


def test_fusion(spark):
    t = table(spark)
    train, test = t.where("id < 40"), t.where("id >= 40")
    enc = {m: encoders.Standardized("id", cols).fit(train) for m, cols in (("skill", ["a"]), ("noise", ["b", "c"]))}
    a, b = ({m: e.transform(x) for m, e in enc.items()} for x in (train, test))
    assert len(next(iter(values(encoders.Concat("id").fit(a).transform(b)).values()))) == 3
    with pytest.raises(DataError):
        encoders.Late("id").fit(a)
    with pytest.raises(DataError):
        encoders.Concat("id").fit({"skill": a["skill"], "noise": b["noise"]})
    with pytest.raises(DataError):
        encoders.Early("id").transform(b)
    assert len(values(encoders.Early("id").fit(a).transform(b))) == 20
    w = encoders.Weighted("id").fit(a, train)
    assert w.modality_importance()["skill"] > w.modality_importance()["noise"]
    late = encoders.Late("id").fit(a, train)
    p = values(late.transform(b))
    y = {r.id: r.occ for r in test.collect()}
    up, down = (np.mean([p[i][0] for i in p if y[i] == k]) for k in (1, 0))
    assert up > down and abs(sum(late.modality_importance().values()) - 1) < 1e-9


def test_fusion_of_other_rows_absent_and_new_modalities(spark):
    t = table(spark)
    train, test = t.where("id < 40"), t.where("id >= 40")
    one, two = (encoders.Raw("id", c).fit(train) for c in (["a"], ["b", "c"]))
    a, b = ({"x": one.transform(s), "y": two.transform(s)} for s in (train, test))
    shifted = a["y"].withColumn("id", F.col("id") + 1)  # as many rows, one key of them another
    for odd in (shifted, a["y"].unionByName(a["y"].limit(1)), a["y"].where("id > 0").unionByName(a["y"].where("id = 1"))):
        with pytest.raises(DataError):
            encoders.Concat("id").fit({"x": a["x"], "y": odd})
    # early: what was not fitted comes last, as it is
    early = encoders.Early("id").fit({"y": a["y"]})
    both, alone, plain = values(early.transform(b)), values(early.transform({"y": b["y"]})), values(b["x"])
    assert all(both[i] == [*alone[i], *plain[i]] for i in both)
    # late: one modality alone is its own learner, whatever its weight was among two
    late = encoders.Late("id").fit(a, train)
    both = values(late.transform(b))
    parts = {m: values(late.transform({m: b[m]})) for m in b}
    w = late.modality_importance()
    assert all(both[i][0] == pytest.approx(sum(w[m] * parts[m][i][0] for m in b)) for i in both)
    only = values(encoders.Late("id").fit({"x": a["x"]}, train).transform({"x": b["x"]}))
    assert all(parts["x"][i][0] == pytest.approx(only[i][0], abs=1e-9) for i in only)
    with pytest.raises(DataError):
        late.transform({"z": b["x"]})


def test_finished_jobs_are_not_fitted_again_and_options_reach_the_model(spark, monkeypatch):
    t = rows_of(spark, 80)
    b = Benchmark(t.where("x < 60"), t.where("x >= 60"), ["a", "b"])
    fits, real = [], learners.predict
    monkeypatch.setattr(learners, "predict", lambda name, train, test, *a, **o: fits.append((name, sorted({r.spid for r in train.select("spid").distinct().collect()}), o)) or real(name, train, test, *a, **o))
    first = b.run(["dummy", "random-forest-mllib"], options={"random-forest-mllib": {"trees": 3}})
    rows = first.collect()
    assert fits == [("dummy", ["u", "v"], {}), ("random-forest-mllib", ["u", "v"], {"trees": 3})]
    assert {json.loads(r.params).get("trees") for r in rows} == {None, 3}
    fits.clear()
    done = spark.createDataFrame([r for r in rows if (r.model_name, r.species_id) != ("dummy", "v")], first.schema)
    again = b.run(["dummy", "random-forest-mllib"], done=done).collect()
    assert [(r.model_name, r.species_id) for r in again] == [("dummy", "v")] and fits == [("dummy", ["v"], {})]
    fits.clear()
    assert b.run(["dummy"], done=first).count() == 0 and fits == []
    # the forest has as many trees as it was told
    from faunaflux.operators import trees

    assert trees.fit(t, ["region", "spid"], ["a", "b"], "siteid", trees.SPECS["random-forest-mllib"]._replace(trees=3, features=1)).groupBy("spid").count().where("count != 3").count() == 0


def test_registries_name_classes():
    assert registry.ENCODERS.get("pca").make is encoders.Pca and registry.FUSIONS.get("late").make is encoders.Late
    assert {m.encoder for m in registry.STANDARD_MODALITIES.values()} <= set(registry.ENCODERS)


def stack(spark):
    rows = [(r, c, float(r * 10 + c), float(c) if (r, c) != (3, 3) else None) for r in range(20) for c in range(20)]
    t = spark.createDataFrame(rows, "row long, col long, a double, b double")
    return RasterStack.of({n: t.select("row", "col", F.col(n).alias("value")) for n in ("a", "b")}, 0.0, 20.0, 1.0, 1.0)


def test_rasters(spark):
    s = stack(spark)
    assert s.geographic and s.profile().first().n_valid == 399
    points = spark.createDataFrame([(1, 2.5, 17.5), (2, 99.0, 99.0)], "k long, x double, y double")
    d = RasterDataset(s, points, "k", n_background=50)
    t = {r.siteid: r for r in d.training_frame().collect()}
    assert len(t) == 52 and t["occ1"].a == 22.0 and t["occ2"].a is None and sum(r.occ for r in t.values()) == 2
    train, test = d.to_task(0.25)
    assert train.count() + test.count() == 52 and test.count() > 0
    with pytest.raises(DataError):
        RasterDataset(s, points.drop("x"), "k").training_frame()


def test_hashes_and_checksums(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"abc")
    (tmp_path / "in/b.txt").write_bytes(b"d")
    assert provenance.hash_file(spark, f"{tmp_path}/in/a.txt") == hashlib.sha256(b"abc").hexdigest()
    provenance.write_checksums(spark, f"{tmp_path}/in", f"{tmp_path}/sums", "survey", extra={"by": 1})
    assert provenance.changed_files(spark, f"{tmp_path}/in", f"{tmp_path}/sums").count() == 0
    (tmp_path / "in/b.txt").write_bytes(b"e")
    (tmp_path / "in/c.txt").write_bytes(b"f")
    assert {(r.name, r.state) for r in provenance.changed_files(spark, f"{tmp_path}/in", f"{tmp_path}/sums").collect()} == {("b.txt", "changed"), ("c.txt", "new")}
    x = np.arange(6)
    assert provenance.hash_array(x) == provenance.hash_array(x.copy()) != provenance.hash_array(x.reshape(2, 3))
    t = spark.range(50).withColumn("v", F.col("id") * 2)
    h = lambda df, o="id": provenance.hash_ordered(df, [o]).first().digest
    assert h(t) == h(t.select("v", "id").repartition(7)) != h(t.withColumn("id", 49 - F.col("id")))


def test_configuration_and_dependencies(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": 1, "evaluation": {"seed": 2, "metric": "x"}}))
    assert provenance.load_config(spark, f"{tmp_path}/c.json", {"evaluation": {"seed": 3, "metric": None}, "b": None}) == {"a": 1, "evaluation": {"seed": 3, "metric": "x"}}
    assert provenance.load_config(spark) == {} and provenance.require("json") is json
    with pytest.raises(SkippableError):
        provenance.require("no_such_module_here", "install it")
    assert provenance.cache_root(spark).endswith("faunaflux-cache")


def test_results_in_batch(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"job_id": "a", "scenario": "s", "roc_auc": 0.5}\nnot json\n{"roc_auc": 1}\n')
    got = report.scan_results(spark, f"{tmp_path}/r.json")
    assert got.columns == RESULT_COLUMNS and [(r.job_id, r.roc_auc) for r in got.collect()] == [("a", 0.5)]
    report.write_leakage(spark.createDataFrame([("s", "j", "x")], "scenario string, job_id string, finding string"), f"{tmp_path}/leaks")
    assert spark.read.json(f"{tmp_path}/leaks").count() == 1


def test_schema_inference(spark):
    t = table(spark).withColumn("few", (F.col("id") % 3).cast("int")).withColumn("lon", F.col("a"))
    assert tasks.infer_categorical(t, ["a", "kind", "few", "id"]) == ["kind", "few"]
    assert tasks.categorical_indices(["a", "few", "kind"], ["kind", "few", "gone"]) == [1, 2]
    _, warnings = tasks.inspect(tasks.table_profile(t.drop("occ")))
    assert any("coordinate" in w for w in warnings) and any("target" in w for w in warnings)


def test_csv_rows_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("longitude,latitude,presence,v\n" + "".join(f"{i},{i},{i % 2},{i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.siteid: r.v for r in survey.read_csv(spark, f"{tmp_path}/t.csv").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"row{i}": i for i in range(500)}


def test_geographic_radius(spark):
    p = spark.createDataFrame([(1, 179.99, 0.0), (2, -179.99, 0.0), (3, 0.0, 89.99), (4, 180.0, 89.99), (5, 10.0, 10.0)], "n long, x double, y double")
    assert {(r.src, r.dst) for r in graphs.geographic_radius(p, [], "n", 10_000).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}


def rows_of(spark, n=300):
    rng = np.random.default_rng(9)
    out = []
    for s in ("u", "v"):
        x = rng.normal(size=(n, 2))
        y = rng.uniform(size=n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
        out += [("r", s, f"{s}{i}", float(i), float(i), int(o), float(a) if i % 50 else None, float(b)) for i, ((a, b), o) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(out, "region string, spid string, siteid string, x double, y double, occ int, a double, b double")


def test_grouped_logistic_regression(spark):
    """The penalised likelihood's least point of each group, by gradient descent on one machine; rows with a missing value are predicted too."""
    t = rows_of(spark)
    got = {r.siteid: r.p for r in learners.logistic(t, t, ["region", "spid"], ["a", "b"], "siteid").collect()}
    assert len(got) == 600
    for s in ("u", "v"):
        rows = t.where(F.col("spid") == s).collect()
        x, y = np.array([[np.nan if r.a is None else r.a, r.b] for r in rows]), np.array([r.occ for r in rows])
        x = np.nan_to_num((x - np.nanmean(x, 0)) / np.nanstd(x, 0))
        x, w = np.c_[np.ones(len(x)), x], np.zeros(3)
        for _ in range(4000):
            w += 0.003 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - np.r_[0, w[1:]])
        p = 1 / (1 + np.exp(-x @ w))
        assert max(abs(got[r.siteid] - q) for r, q in zip(rows, p, strict=True)) < 1e-4


def test_models_by_species_keep_all_rows(spark):
    t = rows_of(spark, 80)
    got = learners.per_group("mlp-mllib", t, t, ["region", "spid"], ["a", "b"], "siteid", maxIter=3)
    assert got.count() == 160 and got.where("p is null").count() == 0


def test_a_model_that_fails_gives_failed_rows(spark, monkeypatch):
    t = rows_of(spark, 80)

    def broken(*_, **__):
        raise ValueError("no")

    monkeypatch.setattr(learners, "gaussian_nb", broken)
    b = Benchmark(t.where("x < 60"), t.where("x >= 60"), ["a", "b"])
    got = {(r.model_name, r.status) for r in b.run(["dummy", "gaussian-nb", "xgboost", "logistic-regression"]).collect()}
    assert got == {("dummy", "OK"), ("gaussian-nb", "FAILED"), ("xgboost", "SKIPPED_DEPENDENCY"), ("logistic-regression", "OK")}
    row = b.run(["logistic-regression"]).where("species_id = 'u'").first()
    assert row.n_train == 60 and row.n_presence + row.n_background == 60 and len(row.split_hash) == 64 and row.n_test_presence + row.n_test_absence == 20 and json.loads(row.metrics_json)
    assert b.n_tasks() == 2 and b.n_tasks(most=1) == 1 and b.model_options("knn") == {"k": 5}


def survey_rows():
    """Two regions with predictors of their own; siteid, place and species as text."""
    po = {"AWT": "siteid,x,y,spid,occ,bc01\na1,1.5,2,awt1,1,20\na2,3,4,awt2,1,NA\n", "NSW": "siteid,x,y,spid,occ,rain,vegsys\nn1,1,2,nsw1,1,5.5,7\n"}
    return {f"{r}_po.csv": t for r, t in po.items()} | {"AWT_bg.csv": "siteid,x,y,spid,occ,bc01\nb1,5,6,awt1,0,21\n", "AWT_other.csv": "a\n1\n", "XYZ_po.csv": "a\n1\n", "notes.csv": "a\n1\n"}


def test_folder_of_survey_files_is_taken_in_and_flat_files_are_read(spark, tmp_path):
    from faunaflux.sources.survey import SurveyDataset

    raw = tmp_path / "raw"
    raw.mkdir()
    for name, text in survey_rows().items():
        (raw / name).write_text(text)
    s = SurveyDataset(spark, f"{tmp_path}/kept")
    assert s.ingest_folder(str(raw)) == [("AWT", "bg"), ("AWT", "po"), ("NSW", "po")]
    assert sorted((r.region, r.siteid, r.bc01) for r in s.table("po").select("region", "siteid", "bc01").collect()) == [("AWT", "a1", 20.0), ("AWT", "a2", None), ("NSW", "n1", None)]
    assert s.table("po", "nsw").first().vegsys == "7" and s.table("bg").count() == 1
    with pytest.raises(DataError):
        s.ingest_folder(str(tmp_path))
    # the same tables as one file for each region and table
    flat = f"{tmp_path}/flat"
    for region in ("AWT", "NSW"):
        s.table("po", region).write.parquet(f"{flat}/{region}_po.parquet")
    f = SurveyDataset(spark, flat)
    assert sorted(r.siteid for r in f.table("po").collect()) == ["a1", "a2", "n1"] and [r.siteid for r in f.table("po", "NSW").collect()] == ["n1"]
    assert not f.is_available()


def test_labels_of_a_users_table_that_cannot_be_read_are_errors(spark, tmp_path):
    from faunaflux.sources.survey import read_csv

    for text, good in (("yes", True), ("absent", True), ("maybe", False), ("", False)):
        path = tmp_path / f"t{len(text)}{text}.csv"
        path.write_text(f"longitude,latitude,presence,a\n1,2,no,3\n1,2,{text},3\n")
        rows = read_csv(spark, str(path))
        if good:
            assert len(rows.collect()) == 2
        else:
            with pytest.raises(Exception, match="neither presence nor absence"):
                rows.collect()
