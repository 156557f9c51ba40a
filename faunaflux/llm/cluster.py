"""What the operators share on the cluster's side: durable cuts of lineage, connected components, column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null identifier inside an operator; turned back into null in results.
NO_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where none is set, a local session gets one of its own; on a cluster that is an error, as no folder here is shared."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="faunaflux-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint(), in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table of Parquet files in the shared folder, of which only the columns asked for are read. delete() removes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(table: DataFrame) -> None:
    """Removes the files of a table of written() that nothing will read again."""
    jvm = table.sparkSession._jvm
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def rowed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row in __row: a 64-bit hash of its place in its file, or a number kept in a checkpoint where there is no file."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__row"))
    except AnalysisException:
        return durable(docs.withColumn("__row", F.monotonically_increasing_id()))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the needed columns, under names that can't clash: _id (null: NO_ID), _text (null: empty), and the others as they are."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"), *[F.col(f"`{c}`") for c in more])


def real_id(column: str = "_id"):
    return F.when(F.col(column) != NO_ID, F.col(column))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, component), component the least node.

    Alternates large-star and small-star contractions, each a grouped minimum and a join; every round is written to the shared folder.
    Nodes are only known from edges. Skewed centres are split by the adaptive skew join, as both sides are plain shuffled joins.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    last = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
