"""Views of the driver's tables in the shapes that the operators take, and the same views as SQL text for the other engine.

occ: orders as occurrence records; pred: scores of three made-up models on the test rows of occ; results: one row for each job with its metrics;
series: daily sums of events by user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import d
from ..operators import metrics

PREDICTORS = ["price", "acct", "age"]
JOB = ["scenario", "region", "species_id", "model_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select(
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("spid"),
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("siteid"),
        F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("part"),
        (F.col("o_custkey") * 7919 % 100000).cast("double").alias("x"),
        (F.col("o_orderkey") * 104729 % 100000).cast("double").alias("y"),
        (F.col("o_orderstatus") == "F").cast("int").alias("occ"),
        F.col("o_totalprice").cast("double").alias("price"),
        F.col("c_acctbal").cast("double").alias("acct"),
        F.datediff(F.to_date(F.lit("1999-01-01")), F.to_date("o_orderdate")).cast("double").alias("age"),
        F.col("o_orderpriority").alias("prio"),
    )


OCC = """occ AS (SELECT r_name AS region, c_mktsegment AS spid, o_orderkey AS ord, 's' || o_orderkey::varchar AS siteid, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS part,
 (o_custkey * 7919 % 100000)::double AS x, (o_orderkey * 104729 % 100000)::double AS y, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS occ, o_totalprice::double AS price, c_acctbal::double AS acct,
 datediff('day', o_orderdate::date, DATE '1999-01-01')::double AS age, o_orderpriority AS prio
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, region, species_id, model_name, row, y, p; the spatial scenario keeps the east of the test rows."""
    t = occ(spark, sf_dir).where("part = 'test'")
    one = d(1)
    models = F.array(
        F.struct(F.lit("acct").alias("m"), (one / (one + F.exp(-(F.col("acct") - 4500) / 2500))).alias("p")),
        F.struct(F.lit("mod97").alias("m"), (((F.col("ord") * 31 % 97).cast("double") + 0.5) / 97).alias("p")),
        F.struct(F.lit("price").alias("m"), (one / (one + F.exp(-(F.col("price") - 150000) / 50000))).alias("p")),
    )
    scenarios = F.when(F.col("x") >= 50000, F.array(F.lit("nonspatial"), F.lit("spatial"))).otherwise(F.array(F.lit("nonspatial")))
    t = t.withColumn("mp", F.explode(models)).withColumn("scenario", F.explode(scenarios))
    return t.select("scenario", "region", F.col("spid").alias("species_id"), F.col("mp.m").alias("model_name"), F.col("ord").alias("row"), F.col("occ").alias("y"), F.col("mp.p").alias("p"))


PRED = OCC + """, raw AS (SELECT *, 'acct' AS model_name, 1 / (1 + exp(-(acct - 4500) / 2500)) AS p FROM occ WHERE part = 'test'
 UNION ALL SELECT *, 'mod97', ((ord * 31 % 97)::double + 0.5) / 97 FROM occ WHERE part = 'test' UNION ALL SELECT *, 'price', 1 / (1 + exp(-(price - 150000) / 50000)) FROM occ WHERE part = 'test'),
pred AS (SELECT s.scenario, region, spid AS species_id, model_name, ord AS row, occ AS y, p FROM raw JOIN (VALUES ('nonspatial', -1), ('spatial', 50000)) s(scenario, least_x) ON x >= least_x)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each job: status, roc_auc, brier, n_test, runtime. A few jobs failed; those have no metrics."""
    p = pred(spark, sf_dir)
    m = metrics.roc_auc(p, JOB).join(p.groupBy(*JOB).agg(metrics.brier_expr().alias("brier"), F.count("*").alias("n_test")), JOB)
    lost = (F.col("model_name") == "mod97") & (F.col("region") == "AFRICA") & (F.col("species_id") == "BUILDING")
    status = F.when(lost, "FAILED").when(F.col("roc_auc").isNull(), "SKIPPED_DATA").otherwise("OK")
    m = m.withColumn("status", status).withColumn("roc_auc", F.when(~lost, F.col("roc_auc"))).withColumn("brier", F.when(~lost, F.col("brier")))
    runtime = (F.col("n_test") * F.when(F.col("model_name") == "acct", 3).when(F.col("model_name") == "price", 5).otherwise(1)).cast("double") / 100
    return m.select(*JOB, "status", "roc_auc", "brier", "n_test", runtime.alias("runtime"))


AUC = """cnt AS (SELECT scenario, region, species_id, model_name, p AS s, sum(y) AS pos, count(*) AS n FROM pred GROUP BY ALL),
below AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY scenario, region, species_id, model_name ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cnt),
auc AS (SELECT scenario, region, species_id, model_name, CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN (sum(pos * (b + (n + 1)::double / 2)) - sum(pos)::double * (sum(pos) + 1) / 2) / (sum(pos)::double * (sum(n) - sum(pos))) END AS roc_auc FROM below GROUP BY ALL)"""

RESULTS = PRED + ", " + AUC + """, results AS (SELECT scenario, region, species_id, model_name, CASE WHEN lost THEN 'FAILED' WHEN a IS NULL THEN 'SKIPPED_DATA' ELSE 'OK' END AS status,
 CASE WHEN NOT lost THEN a END AS roc_auc, CASE WHEN NOT lost THEN b END AS brier, n_test, (n_test * CASE model_name WHEN 'acct' THEN 3 WHEN 'price' THEN 5 ELSE 1 END)::double / 100 AS runtime
 FROM (SELECT auc.*, auc.roc_auc AS a, x.b, x.n_test, model_name = 'mod97' AND region = 'AFRICA' AND species_id = 'BUILDING' AS lost FROM auc
 JOIN (SELECT scenario, region, species_id, model_name, avg((p - y) * (p - y)) AS b, count(*) AS n_test FROM pred GROUP BY ALL) x USING (scenario, region, species_id, model_name)))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t (day), value: the daily sum of events of a user."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))


SERIES = "series AS (SELECT user_id AS id, ts::date AS day, sum(value) AS value FROM events GROUP BY ALL)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at so many digits, without negative zeros."""
    return df.select(*[(F.round(c, digits) + d(0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
