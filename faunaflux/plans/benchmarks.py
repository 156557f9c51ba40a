"""Benchmark recipes by name, run configurations, and the sources of protocol constants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_RADIUS_M, SEED
from ..operators import report, spatial
from ..operators.resample import CAP, MEMBERS
from ..runner import KEYS, Benchmark
from ..schemas import DataError
from .registry import Registry, resolve_models

BENCHMARKS = Registry("benchmark", "faunaflux.benchmarks")

#: Constants of the protocol, where each is from, and whether that was checked.
CONSTANTS = (
    ("seed", str(SEED), "protocol", True),
    ("buffer_m", str(spatial.BUFFER_M), "protocol", True),
    ("earth_radius_m", str(EARTH_RADIUS_M), "geometry library default", True),
    ("ensemble_members", str(MEMBERS), "protocol", True),
    ("ensemble_cap", str(CAP), "protocol", True),
    ("species_nonspatial", "226", "protocol", True),
    ("species_spatial", "185", "protocol", True),
    ("calibration_clip", "1e-6", "protocol", True),
    ("ensemble_clip", "1e-7", "implementation", False),
    ("boyce_windows", "101", "package default", False),
)


@dataclass(frozen=True)
class Recipe:
    """What a benchmark fixes: its scenarios, split rule and published values."""

    name: str
    scenarios: tuple[str, ...]
    buffer_m: float = spatial.BUFFER_M
    n_folds: int = 0

    def validate_scenario(self, scenario: str) -> str:
        if scenario not in self.scenarios:
            raise DataError(f"{self.name} has no scenario {scenario!r}; it has {', '.join(self.scenarios)}")
        return scenario

    def bind(self, train: DataFrame, test: DataFrame, predictors: list[str], geographic: bool = False) -> Benchmark:
        if self.n_folds:
            # spatial folds of the training rows; the first is held out
            t = spatial.spatial_folds(train, KEYS, self.n_folds)
            train, test = t.where("fold != 0").drop("fold", "block"), t.where("fold = 0").drop("fold", "block")
        return Benchmark(train, test, predictors, self.name, geographic, self.buffer_m)

    def published(self, spark: SparkSession) -> DataFrame:
        return report.published(spark).where(F.col("scenario").isin(*self.scenarios))


for _r in (Recipe("multi-region", ("nonspatial", "spatial")), Recipe("spatial-cv", ("nonspatial",), n_folds=5)):
    BENCHMARKS.add(_r.name, _r)


def provenance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONSTANTS), "key string, value string, provenance string, verified boolean")


@dataclass(frozen=True)
class RunConfig:
    benchmark: str
    models: tuple[str, ...]
    scenarios: tuple[str, ...] = ("nonspatial",)
    metrics: tuple[str, ...] = ("roc_auc", "pr_auc", "calibration_slope")
    seed: int = SEED
    include_failed: bool = True
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, values: dict, **overrides) -> RunConfig:
        """Models may be a comma list, a list, or lists by group; keys that are not known are kept in extra; overrides that are None do not count."""
        known = {f for f in cls.__dataclass_fields__ if f != "extra"}
        merged = values | {k: v for k, v in overrides.items() if v is not None}
        models = merged.get("models", "standard")
        if isinstance(models, dict):
            models = [m for group in models.values() for m in (group if isinstance(group, list) else str(group).split(","))]
        taken = {k: tuple(v) if isinstance(v, list) else v for k, v in merged.items() if k in known}
        return cls(**taken | {"models": tuple(resolve_models(models)), "extra": {k: v for k, v in merged.items() if k not in known}})

    def run(self, train: DataFrame, test: DataFrame, predictors: list[str], done: DataFrame | None = None) -> DataFrame:
        recipe = BENCHMARKS.get(self.benchmark).make
        for s in self.scenarios:
            recipe.validate_scenario(s)
        return recipe.bind(train, test, predictors).run(list(self.models), self.scenarios, self.metrics, done, self.include_failed)


