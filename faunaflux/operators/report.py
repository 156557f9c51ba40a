"""Published against reproduced values, pending jobs, result stores and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalar import finite, reproduction_status
from ..schemas import RESULT_COLUMNS, RESULT_SCHEMA, as_results

#: Published mean ROC-AUC and calibration slope by model and scenario.
PUBLISHED = (
    ("tabpfn-sdm", "nonspatial", "roc_auc", 0.762, 226),
    ("maxnet", "nonspatial", "roc_auc", 0.732, 226),
    ("random-forest", "nonspatial", "roc_auc", 0.727, 226),
    ("brt", "nonspatial", "roc_auc", 0.724, 226),
    ("gam", "nonspatial", "roc_auc", 0.717, 226),
    ("tabpfn-sdm-spatial", "spatial", "roc_auc", 0.699, 185),
    ("tabpfn-sdm", "nonspatial", "calibration_slope", 1.110, 226),
)
MATCH, CLOSE = 0.010, 0.025


def published(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PUBLISHED), "model_name string, scenario string, metric string, published double, n_species_published long")


def reproduction(reference: DataFrame, results: DataFrame, match: float = MATCH, close: float = CLOSE) -> DataFrame:
    """Each published row with what the successful jobs give for it; never filled from what was published."""
    metrics = [m for m in ("roc_auc", "pr_auc", "calibration_slope", "brier") if m in results.columns]
    long = results.where("status = 'OK'").unpivot(["scenario", "model_name", "region", "species_id"], metrics, "metric", "v").where(finite("v").isNotNull())
    got = long.groupBy("scenario", "model_name", "metric").agg(F.avg("v").alias("reproduced"), F.count_distinct("region", "species_id").alias("n_species_reproduced"))
    states = results.groupBy("scenario", "model_name").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "OK").alias("n_ok"))
    t = reference.join(got, ["scenario", "model_name", "metric"], "left").join(states, ["scenario", "model_name"], "left")
    t = t.withColumn("difference", F.col("reproduced") - F.col("published")).withColumn("status", reproduction_status("difference", match, close))
    note = F.when(F.col("n_jobs").isNull(), "no job").when(F.col("n_ok") == 0, "no job succeeded").otherwise(F.concat(F.col("n_ok").cast("string"), F.lit(" of "), F.col("n_jobs").cast("string"), F.lit(" jobs")))
    return t.withColumn("note", note).drop("n_jobs", "n_ok")


def overall_status(report: DataFrame) -> DataFrame:
    """One row: NOT RUN if nothing ran, else the worst of MISMATCH, CLOSE and MATCH that is there; PARTIAL where none of them is."""
    has = lambda s: F.count_if(F.col("status") == s) > 0
    none = F.count_if(F.col("status") == "NOT RUN") == F.count("*")
    return report.agg(F.when(none, "NOT RUN").when(has("MISMATCH"), "MISMATCH").when(has("CLOSE"), "CLOSE").when(has("MATCH"), "MATCH").otherwise("PARTIAL").alias("status"))


def extra_models(reference: DataFrame, results: DataFrame, scenario: str = "nonspatial") -> DataFrame:
    """Models with results that nothing was published for."""
    return results.where(F.col("scenario") == scenario).select("model_name").distinct().join(reference.where(F.col("scenario") == scenario), "model_name", "left_anti")


def completed(results: DataFrame, include_failed: bool = True) -> DataFrame:
    rows = results.where("job_id is not null and job_id != ''")
    return (rows if include_failed else rows.where("status = 'OK'")).select("job_id").distinct()


def pending(jobs: DataFrame, results: DataFrame, include_failed: bool = True, force: bool = False) -> DataFrame:
    return jobs if force else jobs.join(completed(results, include_failed), "job_id", "left_anti")


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Appends result rows as Parquet by scenario and region; the commit is atomic."""
    as_results(results).write.mode(mode).partitionBy("scenario", "region").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    missing = [c for c in RESULT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing result columns: {', '.join(missing[:8])}")
    return df.select(*RESULT_COLUMNS)


def write_leakage(audits: DataFrame, path: str, mode: str = "append") -> None:
    """Audit findings by job, as JSON by scenario."""
    audits.write.mode(mode).partitionBy("scenario").json(path)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of JSON files, one object a line, in a batch; lines that cannot be read are left out, columns that are missing are null."""
    rows = spark.read.schema(StructType([*RESULT_SCHEMA.fields, StructField("_broken", StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return as_results(rows.where("_broken is null and job_id is not null"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def latest_run(manifests: DataFrame, benchmark_id: str | None = None) -> DataFrame:
    rows = manifests if benchmark_id is None else manifests.where(F.col("benchmark_id") == benchmark_id)
    return rows.agg(F.max("run_id").alias("run_id"))


def hash_json(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def manifest(spark: SparkSession, run_id: str, benchmark_id: str, config: dict, counters: dict | None = None) -> DataFrame:
    """A run's identity, as one row."""
    row = (run_id, benchmark_id, json.dumps(config, sort_keys=True, default=str), hash_json(config), spark.version, json.dumps(counters or {}, sort_keys=True))
    return spark.createDataFrame([row], "run_id string, benchmark_id string, config string, config_hash string, spark_version string, counters string")


def content_hash(df: DataFrame) -> DataFrame:
    """One row with a hash of a table's rows that does not depend on their order; doubles at twelve decimals."""
    cols = [F.round(F.col(c), 12).cast("string") if t == "double" else F.col(c).cast("string") for c, t in sorted(df.dtypes)]
    h = F.xxhash64(*cols)
    return df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string"), F.lit(",".join(sorted(df.columns)))), 256).alias("digest"))
