"""Runs models over all species at once and gives result rows."""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalar import SEED, job_id
from .lineage import durable
from .operators import audit, learners, metrics, recipe, report, spatial, tasks
from .schemas import SkippableError, as_results

KEYS = ["region", "spid"]
#: Families of models, and settings that the protocol gives them.
FAMILIES = {
    **dict.fromkeys(["dummy"], "baseline"),
    **dict.fromkeys(["gaussian-nb", "knn", "logistic-regression", "decision-tree", "svm", "linear-svc"], "classical"),
    **dict.fromkeys(["random-forest", "random-forest-mllib", "extra-trees"], "ensemble"),
    **dict.fromkeys(["gradient-boosting", "adaboost", "brt"], "boosting"),
    **dict.fromkeys(["maxnet", "gam"], "statistical"),
    "mlp-mllib": "neural",
}
MODEL_OPTIONS = {"random-forest-mllib": {"trees": 100}, "random-forest": {"trees": 1000}, "extra-trees": {"trees": 1000}, "gradient-boosting": {"trees": 50}, "brt": {"trees": 10_000, "rate": 0.001, "bag": 0.75, "folds": 5}, "maxnet": {"classes": "lqpht", "multiplier": 1.0}, "gam": {"k": 10}, "adaboost": {"trees": 50}, "knn": {"k": 5}}


class Benchmark:
    """train and test tables (region, spid, siteid, x, y, occ, predictors) under a benchmark's name."""

    def __init__(self, train: DataFrame, test: DataFrame, predictors: list[str], name: str = "benchmark", geographic: bool = False, buffer_m: float = spatial.BUFFER_M):
        self.train, self.test, self.predictors, self.name, self.geographic, self.buffer_m = train, test, predictors, name, geographic, buffer_m

    def prepare(self, scenario: str) -> tuple[DataFrame, DataFrame]:
        """Split rule, gate on both classes, then the recipe, fitted on what is left of the training rows."""
        if scenario not in ("nonspatial", "spatial"):
            raise ValueError(f"unknown scenario {scenario!r}")
        train = spatial.apply_buffer(self.train, self.test, KEYS, self.buffer_m, self.geographic) if scenario == "spatial" else self.train
        whole = tasks.both_classes(train, KEYS).join(tasks.both_classes(self.test, KEYS), KEYS, "left_semi")
        train, test = (t.join(whole, KEYS, "left_semi") for t in (train, self.test))
        # values that are missing count as the training mean, which is 0 once scaled
        r = recipe.SdmRecipe(KEYS, self.predictors).fit(train)
        return r.transform(train).na.fill(0.0, self.predictors), r.transform(test).na.fill(0.0, self.predictors)

    def audit(self, scenario: str) -> DataFrame:
        train = spatial.apply_buffer(self.train, self.test, KEYS, self.buffer_m, self.geographic) if scenario == "spatial" else self.train
        return audit.audit(train, self.test, KEYS, self.predictors, self.buffer_m if scenario == "spatial" else None, self.geographic)

    def predict(self, model: str, train: DataFrame, test: DataFrame, **options) -> DataFrame:
        """KEYS, siteid, p of a model for each region and species."""
        return learners.predict(model, train, test, KEYS, self.predictors, "siteid", **options)

    def tasks(self, species: list[str] | None = None, most: int | None = None) -> DataFrame:
        """The (region, spid) that would run, in order: all, those asked for, or the first so many."""
        out = self.test.select(*KEYS).distinct()
        out = out if species is None else out.where(F.col("spid").isin(species))
        return out.orderBy(*KEYS) if most is None else out.orderBy(*KEYS).limit(most)

    def n_tasks(self, species: list[str] | None = None, most: int | None = None) -> int:
        return self.tasks(species, most).count()

    @staticmethod
    def model_options(model: str) -> dict:
        """Settings that the protocol gives a model; none for most."""
        return dict(MODEL_OPTIONS.get(model, {}))

    def run(self, models: list[str], scenarios: tuple[str, ...] = ("nonspatial",), wanted=metrics.PUBLISHED, done: DataFrame | None = None, include_failed: bool = True, options: dict[str, dict] | None = None) -> DataFrame:
        """A result row for each job that is not done: models that are not available give typed skips, models that raise an error FAILED rows.

        Jobs of done are taken away before anything is fitted: a model sees the rows of species it still has to do, and is not started if there are none. options: of models by name, over
        those of the protocol. A model's predictions are written before they are scored, so fit_seconds is the time to fit and predict all species, and an error stays with its model.
        """
        run_id, parts = f"run-{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}", []
        species = self.test.select(*KEYS).distinct()
        finished = None if done is None else durable(report.completed(done, include_failed).select("job_id"))
        for scenario in scenarios:
            train, test = (durable(t) for t in self.prepare(scenario))
            state = durable(self.audit(scenario).select(*KEYS, F.col("status").alias("audit_status")).join(self._sizes(train, test, scenario), KEYS, "left"))
            for model in models:
                settings = {**self.model_options(model), **(options or {}).get(model, {})}
                todo, a, b = species, train, test
                if finished is not None:
                    job = job_id(F.lit(self.name), F.lit(scenario), "region", "spid", F.lit(model))
                    todo = durable(species.withColumn("job_id", job).join(finished, "job_id", "left_anti").drop("job_id"))
                    if todo.isEmpty():
                        continue
                    a, b = (t.join(todo, KEYS, "left_semi") for t in (train, test))
                began = time.time()
                try:
                    p = durable(self.predict(model, a, b, **settings).select(*KEYS, "siteid", "p").join(b.select(*KEYS, "siteid", F.col("occ").alias("y")), [*KEYS, "siteid"]))
                    rows = todo.join(metrics.compute_metrics(p, KEYS, wanted), KEYS, "left").join(p.groupBy(*KEYS).agg(F.count("*").alias("n_test")), KEYS, "left")
                    rows = rows.withColumn("status", F.when(F.col("n_test").isNull(), "SKIPPED_DATA").otherwise("OK"))
                    rows = rows.withColumn("metrics_json", F.when(F.col("status") == "OK", F.to_json(F.struct(*wanted))))
                except SkippableError as why:
                    rows = todo.withColumn("status", F.lit(why.status)).withColumn("error", F.lit(str(why)))
                except Exception as why:  # one model's failure is its own row, not the end of the run
                    rows = todo.withColumn("status", F.lit("FAILED")).withColumn("error", F.lit(f"{type(why).__name__}: {str(why)[:500]}")).withColumn("error_class", F.lit(type(why).__name__))
                took = time.time() - began
                rows = rows.join(state, KEYS, "left").withColumn("model_name", F.lit(model)).withColumn("scenario", F.lit(scenario)).withColumn("fit_seconds", F.lit(took)).withColumn("total_seconds", F.lit(took))
                rows = rows.withColumn("family", F.lit(FAMILIES.get(model, "other"))).withColumn("device", F.lit("cpu")).withColumn("seed", F.lit(SEED)).withColumn("split_id", F.lit(scenario)).withColumn("model_version", F.lit(rows.sparkSession.version))
                rows = rows.withColumn("params", F.lit(json.dumps(settings))).withColumn("model_config_hash", F.lit(report.hash_json([model, settings, self.predictors])))
                parts.append(as_results(rows.withColumnRenamed("spid", "species_id").withColumn("run_id", F.lit(run_id)).withColumn("benchmark_id", F.lit(self.name)).withColumn("job_id", job_id(F.lit(self.name), "scenario", "region", "species_id", "model_name")).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))))
        out = parts[0] if parts else as_results(self._nothing(species))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _nothing(species: DataFrame) -> DataFrame:
        return species.limit(0).withColumnRenamed("spid", "species_id")

    @staticmethod
    def _sizes(train: DataFrame, test: DataFrame, scenario: str) -> DataFrame:
        """Row counts by class, and a hash of the training sites that does not depend on their order; sums only, so no group is gathered."""
        h = F.xxhash64("siteid", "occ")
        digest = F.sha2(F.concat_ws("|", F.lit(scenario), F.count("*").cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")), 256)
        a = train.groupBy(*KEYS).agg(F.count("*").alias("n_train"), F.count_if(F.col("occ") == 1).alias("n_presence"), F.count_if(F.col("occ") == 0).alias("n_background"), digest.alias("split_hash"))
        b = test.groupBy(*KEYS).agg(F.count_if(F.col("occ") == 1).alias("n_test_presence"), F.count_if(F.col("occ") == 0).alias("n_test_absence"))
        return a.join(b, KEYS, "full")
