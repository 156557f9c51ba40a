"""Verbs of the command line, on a small survey."""

import numpy as np
import pytest

from faunaflux import cli
from faunaflux.sources.survey import SurveyDataset


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("survey"))
    rng = np.random.default_rng(2)
    s = SurveyDataset(spark, root)
    names = "region string, group string, siteid string, spid string, x double, y double, occ int, bio double, wet double"
    row = lambda i, sp, o, t: ("AWT", "g", f"{t}{i}", sp, float(rng.uniform(0, 9)), float(rng.uniform(0, 9)), o, float(rng.normal(o)), float(rng.normal()))
    s.write(spark.createDataFrame([row(i, sp, 1, "p" + sp) for sp in ("a", "b") for i in range(40)], names), "po")
    s.write(spark.createDataFrame([row(i, None, 0, "bg") for i in range(120)], names), "bg")
    pa = [row(i, sp, int(i % 3 == 0), "t") for sp in ("a", "b") for i in range(60)]
    s.write(spark.createDataFrame([r[:7] for r in pa], names.rsplit(", bio", 1)[0]), "pa")
    s.write(spark.createDataFrame([(r[0], r[2], i, float(rng.normal(r[6])), r[8]) for i, r in enumerate(pa[:60])], "region string, siteid string, _ord int, bio double, wet double"), "env")
    return root


def test_survey_is_there(spark, survey):
    s = SurveyDataset(spark, survey)
    assert s.is_available() and not SurveyDataset(spark, survey + "-no").is_available()
    assert s.n_tasks() == 2 and s.n_tasks(most=1) == 1 and [r.spid for r in s.species_of(["awt"], ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        s.species_of(["nowhere"])


def test_small_verbs(spark, capsys):
    for verb in ("models", "plan", "benchmarks", "provenance", "env"):
        assert cli.main([verb]) == 0
    out = capsys.readouterr().out
    assert "multi-region" in out and "buffer_m" in out and "information 3" in out


def test_benchmark_and_what_reads_it(spark, survey, tmp_path, capsys):
    (tmp_path / "c.json").write_text('{"models": "knn", "scenarios": ["nonspatial"], "metrics": ["roc_auc"]}')
    run = f"{tmp_path}/run"
    base = ["benchmark", "--root", survey, "--config", f"{tmp_path}/c.json", "--models", "dummy,gaussian-nb", "--predictors", "bio,wet", "--run-dir", run]
    assert cli.main(base) == 0
    first = spark.read.parquet(f"{run}/results")
    assert first.count() == 4 and {r.model_name for r in first.collect()} == {"dummy", "gaussian-nb"}
    assert cli.main([*base[:6], "dummy,logistic-regression", *base[7:]]) == 0  # what is done is not done again
    again = spark.read.parquet(f"{run}/results")
    assert again.count() == 6 and again.select("job_id").distinct().count() == 6
    assert spark.read.json(f"{run}/manifest").count() == 2
    for verb in (["leaderboard", "--run-dir", run], ["leaderboard", "--run-dir", run, "--common-species"], ["report", "--run-dir", run], ["data-info", "--root", survey], ["reproduce", "--root", survey, "--models", "dummy", "--predictors", "bio", "--most", "1"]):
        assert cli.main(verb) == 0
    assert "gaussian-nb" in capsys.readouterr().out
