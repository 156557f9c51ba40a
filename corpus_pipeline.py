"""A corpus pipeline of five stages over the documents table: language, repeated lines, near duplicates, benchmark passages, source weights.

Every stage takes all rows that the one before kept, and all but the last return the columns of documents. Inside a stage rows are known by a key of
their own, so rows without a doc_id, or with one that repeats, are documents like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faunaflux.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from faunaflux.llm.cluster import durable, keyed, rowed, shared_folder


def in_order():
    """Rows by doc_id, those without one last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col("__row").alias("row"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, which get no language. The language found replaces nothing; where lang is null it is filled in."""
    model = language_id.learn(docs.where(language_id.fold(5) != 0))
    columns = docs.columns
    found = language_id.identify(docs, model, pred_col="__lang", score_col="__score", set_col="__set")
    kept = found.where(F.col("__lang") != "und") if model.languages else found.where(language_id.has_letter())
    known = F.when(F.col("__lang") != "und", F.col("__lang"))
    return kept.withColumn("lang", F.coalesce("lang", known)).select(*[f"`{c}`" for c in columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines out; documents of which nothing but space is left go."""
    out = line_dedup.line_dedup(rowed(docs).withColumn("__order", in_order()), "__order", kept_col="__kept", lines_col="__lines", removed_col="__removed")
    out = out.where((F.col("__removed") == 0) | F.coalesce(F.col("__kept").rlike(r"\S"), F.lit(False)))
    size = F.when(F.col("__removed") > 0, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).withColumn("text", F.col("__kept")).select(*[f"`{c}`" for c in docs.columns])


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, one row stays: the one with the least doc_id, one without a doc_id only if all are."""
    rows = rowed(docs)
    groups = durable(jaccard_join.jaccard_join(rows, "__row").where("n_links > 0").select(F.col("_id").alias("__row"), "class_id"))
    groups = rows.select("doc_id", "__row").join(groups, "__row").select("class_id", in_order().alias("o"))
    first = groups.groupBy("class_id").agg(F.min("o").alias("first"))
    gone = groups.join(first, "class_id").where("o.row != first.row").select(F.col("o.row").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    items = keyed(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")
    rows = rowed(docs)
    found = decontaminate.find_items(keyed(rows, "__row"), items).select(F.col("_id").alias("__row")).distinct()
    return rows.join(found, "__row", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of times in column times, which replaces one of that name."""
    out = mixing.mix(rowed(docs), carry=True, row_col="__row").where("times > 0")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "times"], F.col("times"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("jaccard_join", duplicate_stage), ("decontaminate", benchmark_stage), ("mixing", mixing_stage)]

#: The rows depend on a trained model, MinHash candidates and a seeded hash, which SQL can't express: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
