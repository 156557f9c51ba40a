"""Incremental ingest of job results: a stream of result rows, deduplicated by job, kept as a running board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RESULT_SCHEMA


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Result rows as JSON files arrive; a file that does not parse gives no rows."""
    return spark.readStream.schema(RESULT_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def once_per_job(results: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first row of each job; the state of a job is kept for the delay."""
    t = results.withColumn("at", F.coalesce(F.to_timestamp("created_at"), F.timestamp_seconds(F.lit(0))))
    return t.withWatermark("at", delay).dropDuplicatesWithinWatermark(["job_id"]).drop("at")


def running_board(results: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Counts and means by model so far."""
    ok = F.col("status") == "OK"
    return results.groupBy("model_name").agg(F.count("*").alias("n_jobs"), F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, F.col(metric))).alias(f"{metric}_mean"))


def windowed_events(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Sums of event values by user and window, final once the watermark has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "user_id").agg(F.sum("value").alias("value"), F.count("*").alias("n"))


def start_board(results: DataFrame, name: str, checkpoint: str, path: str | None = None) -> StreamingQuery:
    """The running board, kept as Parquet under a path (a row for each model, replaced with each batch), or in memory for a look at it."""
    out = running_board(results).writeStream.outputMode("complete").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if path is None:
        return out.format("memory").start()
    return out.foreachBatch(lambda board, _: board.write.mode("overwrite").parquet(path)).start()
