"""Leakage checks between training and test rows; each is a small table of findings by group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .spatial import within_distance


def shared_sites(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Sites on both sides: their number and the first five."""
    ids = lambda df: df.where("siteid is not null").select(*keys, F.col("siteid").cast("string").alias("siteid")).distinct()
    both = ids(train).join(ids(test), [*keys, "siteid"], "left_semi")
    both = both.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("siteid")))
    return both.groupBy(*keys).agg(F.count("*").alias("n_shared"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("__r") <= 5, F.col("siteid")))), ",").alias("first_sites"))


def shared_coordinates(train: DataFrame, test: DataFrame, keys: list[str], tolerance: float = 0.0, geographic: bool = False) -> DataFrame:
    """Test rows at the place of a training row, to nine decimals, or within a tolerance in metres."""
    if tolerance > 0:
        hit = within_distance(test, train, tolerance, on=keys, geographic=geographic)
    else:
        place = [F.round("x", 9).alias("rx"), F.round("y", 9).alias("ry")]
        hit = test.select(*keys, *place).join(train.select(*keys, *place).distinct(), [*keys, "rx", "ry"], "left_semi")
    return hit.groupBy(*keys).agg(F.count("*").alias("n_overlapping"))


def identical_rows(train: DataFrame, test: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Test rows whose features, to nine decimals, are those of a training row. A missing value equals nothing."""
    kinds = dict(train.dtypes)
    cols = [(F.round(finite(c), 9) if kinds[c] in ("double", "float", "int", "bigint") else F.col(c).cast("string")).alias(c) for c in features]
    hit = test.select(*keys, *cols).join(train.select(*keys, *cols).distinct(), [*keys, *features], "left_semi")
    return hit.groupBy(*keys).agg(F.count("*").alias("n_identical"))


def duplicate_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that repeat an earlier one in full, nulls equal."""
    once = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return once.groupBy(*keys).agg((F.sum("__n") - F.count("*")).alias("n_duplicates"))


def buffer_violations(train: DataFrame, test: DataFrame, keys: list[str], buffer_m: float, geographic: bool = False) -> DataFrame:
    return within_distance(train, test, buffer_m, on=keys, geographic=geographic).groupBy(*keys).agg(F.count("*").alias("n_within_buffer"))


def target_copies(df: DataFrame, features: list[str], target: str = "occ") -> DataFrame:
    """For each feature: whether it is the target, by name or by value (absolute tolerance 1e-9, relative 1e-5)."""
    y = F.col(target).cast("double")
    close = lambda c: F.coalesce(F.max(F.abs(F.col(c).cast("double") - y) - (1e-9 + 1e-5 * F.abs(y))) <= 0, F.lit(False)) & (F.count(c) == F.count("*"))
    row = df.agg(*[(F.lit(c == target) | close(c)).alias(c) for c in features])
    return row.unpivot([], features, "feature", "is_copy")


def crossing_edges(edges: DataFrame, parts: DataFrame, allow: bool = False) -> DataFrame:
    """Edges (src, dst) between a training and a test node (parts: node, part)."""
    a, b = (parts.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part")) for c in ("src", "dst"))
    t = edges.join(a, "src").join(b, "dst")
    n = F.count_if(F.col("src_part") != F.col("dst_part"))
    return t.agg(n.alias("n_crossing"), F.when((n > 0) & F.lit(not allow), "FAIL").otherwise("PASS").alias("status"))


def feature_alignment(train_columns: list[str], test_columns: list[str]) -> dict:
    return {"aligned": train_columns == test_columns, "only_train": sorted({*train_columns} - {*test_columns}), "only_test": sorted({*test_columns} - {*train_columns})}


def coordinate_features(features: list[str], allowed: bool = False) -> dict:
    found = [f for f in features if f in ("x", "y", "longitude", "latitude")]
    return {"passed": allowed or not found, "found": found}


def fitted_on_train(metadata: dict) -> dict:
    where = metadata.get("fitted_on")
    return {"passed": where in (None, "train"), "severity": "WARNING" if where is None else "FATAL"}


def hyperparameter_selection(selection_used_test: bool, detail: str = "") -> dict:
    return {"passed": not selection_used_test, "severity": "FATAL", "detail": detail}


def checks(findings: dict[str, tuple[DataFrame, str, str]], keys: list[str]) -> DataFrame:
    """One table of (keys, check, severity, count) from findings: name to (table, count column, severity)."""
    parts = [t.select(*keys, F.lit(n).alias("check"), F.lit(sev).alias("severity"), F.col(c).cast("long").alias("count")) for n, (t, c, sev) in findings.items()]
    return reduce(DataFrame.unionByName, parts)


def audit_status(groups: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """FAIL with a failed fatal check, PASS_WITH_WARNINGS with another failed one, else PASS; groups has every group."""
    bad = findings.where("`count` > 0").groupBy(*keys).agg(F.count_if(F.col("severity") == "FATAL").alias("n_fatal"), F.count_if(F.col("severity") != "FATAL").alias("n_warning"))
    t = groups.select(*keys).distinct().join(bad, keys, "left").na.fill(0, ["n_fatal", "n_warning"])
    return t.withColumn("status", F.when(F.col("n_fatal") > 0, "FAIL").when(F.col("n_warning") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


def audit(train: DataFrame, test: DataFrame, keys: list[str], features: list[str], buffer_m: float | None = None, geographic: bool = False) -> DataFrame:
    found = {
        "sites": (shared_sites(train, test, keys), "n_shared", "FATAL"),
        "coordinates": (shared_coordinates(train, test, keys), "n_overlapping", "WARNING"),
        "identical_rows": (identical_rows(train, test, keys, features), "n_identical", "WARNING"),
        "duplicates": (duplicate_records(train, keys), "n_duplicates", "WARNING"),
    }
    if buffer_m is not None:
        found["buffer"] = (buffer_violations(train, test, keys, buffer_m, geographic), "n_within_buffer", "FATAL")
    return audit_status(train.select(*keys).unionByName(test.select(*keys)), checks(found, keys), keys)
