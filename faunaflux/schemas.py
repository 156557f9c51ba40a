"""Schemas, states and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

STATUSES = ("OK", "FAILED", "SKIPPED_DEPENDENCY", "SKIPPED_NO_GPU", "SKIPPED_LICENSE", "SKIPPED_DATA", "SKIPPED_EXISTING")


class DataError(ValueError):
    """The data cannot be used as asked."""


class SkippableError(RuntimeError):
    """A job that can't run here; its row carries the status."""

    def __init__(self, message: str, status: str = "SKIPPED_DEPENDENCY"):
        super().__init__(message)
        self.status = status


METRIC_COLUMNS = ("roc_auc", "pr_auc", "calibration_slope", "calibration_intercept", "brier", "log_loss", "boyce", "balanced_accuracy", "sensitivity", "specificity")
#: Columns of a full result row that the boards do not use; text where nothing else is said.
_MORE = ("benchmark_version", "group", "split_id", "model_version", "error_class", "metrics_json", "compute_budget_json", "dataset_hash", "model_config_hash", "package_versions_json", "git_commit", "upstream_commit")
_TEXT = ("job_id", "run_id", "benchmark_id", "scenario", "region", "species_id", "model_name", "family", "status", "error", "audit_status", "device", "params", "split_hash", "created_at")
RESULT_SCHEMA = StructType([StructField(c, StringType()) for c in _TEXT] + [StructField(c, LongType()) for c in ("n_train", "n_test", "n_presence", "n_background", "n_test_presence", "n_test_absence", "seed")] + [StructField("repeat_id", IntegerType())] + [StructField(c, DoubleType()) for c in (*METRIC_COLUMNS, "fit_seconds", "predict_seconds", "total_seconds", "peak_memory_mb")] + [StructField(c, StringType()) for c in _MORE])
RESULT_COLUMNS = RESULT_SCHEMA.fieldNames()


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)


def as_results(df: DataFrame) -> DataFrame:
    """All result columns in order, with nulls for those that are not there; others go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields])
