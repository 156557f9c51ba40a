"""Hashes of files and arrays, checksums of tables, configuration files, optional dependencies and the cache folder."""

from __future__ import annotations

import hashlib
import importlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SkippableError


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, length, sha256 of each file under a path that Spark can read; each file is hashed in a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def hash_file(spark: SparkSession, path: str) -> str:
    return file_hashes(spark, path).first()["sha256"]


def hash_array(x: np.ndarray) -> str:
    """By shape, type and values."""
    x = np.ascontiguousarray(x)
    return hashlib.sha256(f"{x.shape}{x.dtype}".encode() + x.tobytes()).hexdigest()


def write_checksums(spark: SparkSession, path: str, target: str, dataset: str, version: str = "1", extra: dict | None = None) -> None:
    """One row for each file of a dataset, with what made them, as JSON in a folder of its own."""
    t = file_hashes(spark, path).withColumns({"dataset": F.lit(dataset), "version": F.lit(version), "algorithm": F.lit("sha256"), "export": F.lit(json.dumps(extra or {}, default=str))})
    t.coalesce(1).write.mode("overwrite").json(target)


def changed_files(spark: SparkSession, path: str, checksums: str) -> DataFrame:
    """name, state (missing, new or changed) of files that are not as the checksums say."""
    was, now = spark.read.json(checksums).select("name", F.col("sha256").alias("was")), file_hashes(spark, path).select("name", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").otherwise("changed")
    return was.join(now, "name", "full").where("was is distinct from now").select("name", state.alias("state"))


def hash_ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """One row with a hash of a table's values and types in the order given; names of columns sorted, so that their order does not count.

    Row numbers come from sorted partitions and their sizes, so nothing but sizes is gathered.
    """
    cols = sorted(df.columns)
    kinds = dict(df.dtypes)
    h = F.xxhash64(*[F.coalesce((F.round(F.col(c), 12) if kinds[c] == "double" else F.col(c)).cast("string"), F.lit("\0")) for c in cols])
    t = df.repartitionByRange(*order).sortWithinPartitions(*order).select(h.alias("h"), F.monotonically_increasing_id().alias("m"))
    t = t.withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND((1 << 33) - 1))
    before, offsets = 0, []
    for r in sorted(t.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    off = df.sparkSession.createDataFrame(offsets, "part long, off long")
    placed = t.join(F.broadcast(off), "part").select(F.xxhash64("h", F.col("off") + F.col("at")).alias("x"))
    return placed.agg(F.sha2(F.concat_ws("|", F.lit(",".join(f"{c}:{kinds[c]}" for c in cols)), F.count("*").cast("string"), F.coalesce(F.sum(F.col("x").cast("decimal(38,0)")).cast("string"), F.lit("0"))), 256).alias("digest"))


def load_config(spark: SparkSession, path: str | None = None, overrides: dict | None = None) -> dict:
    """Settings of a JSON file that Spark can read, or of none, with overrides that are not None on top, nested ones key by key."""
    out = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect())) if path else {}

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a.get(k) or {}, v) if isinstance(v, dict) and isinstance(a.get(k) or {}, dict) else v for k, v in b.items() if v is not None}

    return merge(out, overrides or {})


def require(module: str, hint: str | None = None):
    """A module, or the error that makes a job a typed skip."""
    try:
        return importlib.import_module(module)
    except ImportError as missing:
        raise SkippableError(f"{module} is not installed" + (f"; {hint}" if hint else "")) from missing


def cache_root(spark: SparkSession) -> str:
    """The folder for artefacts: spark.faunaflux.cache, or one in the warehouse, which all executors see."""
    return spark.conf.get("spark.faunaflux.cache", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/faunaflux-cache"
