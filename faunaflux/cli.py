"""Command line: python -m faunaflux.cli <verb> ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def _spark() -> SparkSession:
    return SparkSession.builder.appName("faunaflux").getOrCreate()


def _benchmark(spark: SparkSession, a):
    """Runs a benchmark over a survey. The file's settings come first, then the options that were given; results and manifest go to the run directory, whose finished jobs are not done again."""
    from pyspark.errors import AnalysisException

    from .operators import report
    from .plans.benchmarks import RunConfig
    from .provenance import load_config
    from .sources.survey import SurveyDataset

    many = lambda x: [v.strip() for v in x.split(",")] if x else None
    given = {"benchmark": a.benchmark, "models": a.models, "scenarios": many(a.scenarios), "predictors": many(a.predictors), "regions": many(a.regions), "species": many(a.species), "most": int(a.most) if a.most else None, "root": a.root}
    values = {"benchmark": "multi-region", "models": "standard"} | load_config(spark, a.config, given)
    config = RunConfig.from_dict(values)
    data = SurveyDataset(spark, config.extra["root"])
    train, test = data.iter_tasks(config.extra.get("regions"), config.extra.get("species"), config.extra.get("most"))
    predictors = config.extra.get("predictors") or [c for c, t in train.dtypes if t in ("double", "float", "int", "bigint") and c in test.columns and c not in ("x", "y", "occ")]
    if not a.run_dir:
        return config.run(train, test, predictors)
    try:
        done = report.read_results(spark, f"{a.run_dir}/results")
    except AnalysisException:
        done = None
    report.write_results(config.run(train, test, predictors, done), f"{a.run_dir}/results")
    rows = report.read_results(spark, f"{a.run_dir}/results")
    report.manifest(spark, rows.agg({"run_id": "max"}).first()[0], config.benchmark, {k: str(v) for k, v in values.items()}, {r.status: r["count"] for r in rows.groupBy("status").count().collect()}).write.mode("append").json(f"{a.run_dir}/manifest")
    return rows


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="faunaflux")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, options in {
        "leaderboard": ("--results", "--metric", "--scenario", "--output"),
        "compare": ("--results", "--metric", "--scenario", "--reference", "--correction"),
        "report": ("--results",),
        "inspect": ("--csv",),
        "benchmark-csv": ("--csv", "--target", "--models", "--output"),
        "benchmark": ("--root", "--config", "--benchmark", "--models", "--scenarios", "--predictors", "--regions", "--species", "--most", "--run-dir"),
        "reproduce": ("--root", "--config", "--benchmark", "--models", "--scenarios", "--predictors", "--regions", "--species", "--most", "--run-dir"),
        "benchmarks": (),
        "provenance": (),
        "data-info": ("--root",),
        "models": (),
        "plan": (),
        "env": (),
    }.items():
        v = verbs.add_parser(verb)
        for o in options:
            v.add_argument(o)
        if verb in ("leaderboard", "compare", "report"):
            v.add_argument("--run-dir")
        if verb == "leaderboard":
            v.add_argument("--common-species", action="store_true")
    a = p.parse_args(argv)
    from .operators import board, compare, report, resample, tasks
    from .plans import benchmarks, planner, registry

    if a.verb == "models":
        for n in registry.MODELS:
            print(n, registry.MODELS.get(n).note or "available")
        return 0
    if a.verb == "plan":
        base = planner.Methodology("base", (planner.Modality("climate"), planner.Modality("soil")))
        for stage, plans in planner.StagedPlanner(base).everything().items():
            print(stage, len(plans))
        return 0
    if a.verb == "benchmarks":
        for n in benchmarks.BENCHMARKS:
            r = benchmarks.BENCHMARKS.get(n).make
            print(n, ",".join(r.scenarios), f"buffer {r.buffer_m:g} m", f"{r.n_folds} folds" if r.n_folds else "given test rows")
        return 0
    spark = _spark()
    if getattr(a, "run_dir", None) and a.verb in ("leaderboard", "compare", "report") and not a.results:
        a.results = f"{a.run_dir}/results"
    if a.verb == "provenance":
        print(board.render(benchmarks.provenance(spark).orderBy("key"), ["key", "value", "provenance", "verified"], 30))
    elif a.verb in ("benchmark", "reproduce"):
        rows = _benchmark(spark, a)
        if a.verb == "reproduce":
            print(board.render(report.reproduction(benchmarks.BENCHMARKS.get(a.benchmark or "multi-region").make.published(spark), rows), ["model_name", "scenario", "metric", "published", "reproduced", "status"]))
        else:
            print(board.markdown(board.leaderboard(rows)))
    elif a.verb == "env":
        print("spark", spark.version, "python", spark.sparkContext.pythonVer, "master", spark.sparkContext.master)
    elif a.verb == "leaderboard":
        rows, metric = report.read_results(spark, a.results), a.metric or "roc_auc"
        if a.common_species:
            print(board.render(board.common_species(rows, metric, a.scenario), ["model_name", "n", "mean", "rank"]))
        else:
            b = board.leaderboard(rows, metric, a.scenario)
            print(board.markdown(b, metric))
            if a.output:
                report.write_csv(b, a.output)
    elif a.verb == "compare":
        t = compare.compare_models(report.read_results(spark, a.results), a.metric or "roc_auc", a.scenario, a.reference, a.correction or "holm")
        print(board.render(t, ["model_a", "model_b", "n", "mean_difference", "ci_low", "ci_high", "p_adjusted", "verdict"], 40))
    elif a.verb == "report":
        print(board.render(report.reproduction(report.published(spark), report.read_results(spark, a.results)), ["model_name", "scenario", "metric", "published", "reproduced", "status"]))
    elif a.verb == "inspect":
        raw = spark.read.option("header", "true").option("inferSchema", "true").csv(a.csv)
        print(board.render(tasks.guess_roles(tasks.table_profile(raw)), ["column", "type", "role", "confidence"]))
    elif a.verb == "benchmark-csv":
        from .runner import Benchmark
        from .sources.survey import read_csv

        df = resample.stratified_holdout(read_csv(spark, a.csv, a.target or "presence"), ["region", "spid"], "siteid")
        numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in ("x", "y", "occ", "_ord")]
        out = Benchmark(df.where("part = 'train'"), df.where("part = 'test'"), numeric, "csv").run(registry.resolve_models(a.models or "dummy,gaussian-nb,knn"))
        if a.output:
            report.write_results(out, a.output)
        print(board.markdown(board.leaderboard(out)))
    elif a.verb == "data-info":
        from .sources.survey import SurveyDataset

        print(board.render(SurveyDataset(spark, a.root).summary().orderBy("region"), ["region", "n_species", "n_po", "n_bg", "n_pa", "n_env"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
