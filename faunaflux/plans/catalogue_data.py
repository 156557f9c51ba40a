"""Queries over occurrence records: assembly, distance joins, audits, resampling, preprocessing, features, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import audit, features, graphs, recipe, resample, spatial, tasks
from ..sources import survey
from . import views
from .catalogue import query
from .views import OCC, PREDICTORS, SERIES

G = ["region", "spid"]
KEY = "region, spid"


def _occ(spark, d):
    return views.occ(spark, d)


def _train(spark, d):
    return _occ(spark, d).where("part = 'train'")


def _test(spark, d):
    return _occ(spark, d).where("part = 'test'")


@query("task_train_union", """, b AS (SELECT region, x, y FROM occ WHERE part = 'train' AND occ = 0), s AS (SELECT DISTINCT region, spid FROM occ),
u AS (SELECT region, spid, x, y, 1 AS occ FROM occ WHERE part = 'train' AND occ = 1 UNION ALL SELECT b.region, s.spid, x, y, 0 FROM b JOIN s USING (region))
SELECT region, spid, occ, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM u GROUP BY ALL""", OCC)
def task_train_union(spark, d):
    train = _train(spark, d)
    po = train.where("occ = 1").select("region", "spid", "x", "y", "occ")
    bg = train.where("occ = 0").select("region", "x", "y")
    u = tasks.training_table(po, bg, _occ(spark, d).select(*G).distinct())
    return u.groupBy("region", "spid", "occ").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


ENV = ", env AS (SELECT region, 'c' || (ord % 500)::varchar AS siteid, ord, price, acct FROM occ), e AS (SELECT region, siteid, arg_min(price, ord) AS price, arg_min(acct, ord) AS acct FROM env GROUP BY ALL)"


def _env(spark, d):
    return _occ(spark, d).select("region", F.concat(F.lit("c"), (F.col("ord") % 500).cast("string")).alias("siteid"), "ord", "price", "acct")


@query("env_dedupe", ENV + " SELECT region, siteid, round(price, 6) AS price, round(acct, 6) AS acct FROM e", OCC)
def env_dedupe(spark, d):
    return tasks.first_by_key(_env(spark, d), ["region", "siteid"], "ord").select("region", "siteid", "price", "acct")


@query("task_test_join", ENV + """, pa AS (SELECT region, spid, 'c' || (ord % 700)::varchar AS siteid, ord, occ FROM occ WHERE part = 'test') SELECT region, spid, siteid, ord, occ, round(price, 6) AS price, round(acct, 6) AS acct FROM pa JOIN e USING (region, siteid)""", OCC)
def task_test_join(spark, d):
    pa = _test(spark, d).select("region", "spid", F.concat(F.lit("c"), (F.col("ord") % 700).cast("string")).alias("siteid"), "ord", "occ")
    env = _env(spark, d).withColumnRenamed("ord", "env_ord")
    return tasks.test_table(pa, env, "env_ord")


@query("species_counts", f"SELECT {KEY}, count(*) FILTER (part = 'train' AND occ = 1) AS n_presence, count(*) FILTER (part = 'train' AND occ = 0) AS n_background, count(*) FILTER (part = 'test' AND occ = 1) AS n_test_presence, count(*) FILTER (part = 'test' AND occ = 0) AS n_test_absence FROM occ GROUP BY ALL", OCC)
def species_counts(spark, d):
    return tasks.species_counts(_train(spark, d), _test(spark, d))


@query("both_classes_gate", "SELECT region, spid, prio, floor(x / 4000) AS zone FROM occ GROUP BY ALL HAVING count(*) FILTER (occ = 1) > 0 AND count(*) FILTER (occ = 0) > 0", OCC)
def both_classes_gate(spark, d):
    zones = _occ(spark, d).withColumn("zone", F.floor(F.col("x") / 4000).cast("double"))
    return tasks.both_classes(zones, ["region", "spid", "prio", "zone"])


@query("survey_group", """, pa AS (SELECT region, spid, ord, CASE ord % 3 WHEN 0 THEN 'birds' WHEN 1 THEN 'plants' ELSE 'other' END AS "group", occ FROM occ), w AS (SELECT * FROM (VALUES ('BUILDING', 'birds'), ('MACHINERY', 'nowhere'), ('FURNITURE', 'plants')) t(spid, want)),
j AS (SELECT pa.*, want, max(CASE WHEN "group" = want THEN 1 ELSE 0 END) OVER (PARTITION BY region, pa.spid) AS seen FROM pa LEFT JOIN w ON w.spid = pa.spid) SELECT region, spid, ord, "group", occ FROM j WHERE seen = 0 OR "group" = want""", OCC)
def survey_group(spark, d):
    """Rows of the species' survey group, where any row of the species has it."""
    g = F.when(F.col("ord") % 3 == 0, "birds").when(F.col("ord") % 3 == 1, "plants").otherwise("other")
    pa = _occ(spark, d).select("region", "spid", "ord", g.alias("group"), "occ")
    groups = spark.createDataFrame([("BUILDING", "birds"), ("MACHINERY", "nowhere"), ("FURNITURE", "plants")], "spid string, want string")
    return tasks.in_group(pa, groups).select("region", "spid", "ord", "group", "occ")


@query("standardise_presences", "SELECT 'AWT' AS region, CAST(NULL AS varchar) AS \"group\", row_number() OVER (ORDER BY ord)::varchar AS siteid, spid, x, y, 1 AS occ, price FROM occ WHERE part = 'train' AND occ = 1", OCC)
def standardise_presences(spark, d):
    po = _train(spark, d).where("occ = 1").select("ord", "spid", "x", "y", "price")
    return tasks.standardise(po, "AWT", "po", "ord").drop("ord")


@query("sample_background", f""", c AS (SELECT ord AS cell, x, y, price FROM occ), f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM occ e WHERE e.part = 'test' AND e.occ = 1 AND sqrt((c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y)) <= 1500 * (1 + 1e-12))) SELECT cell, x, y FROM f ORDER BY md5('32639|' || cell::varchar), cell LIMIT 500""", OCC)
def sample_background(spark, d):
    """500 cells in a seeded order, away from presences."""
    cells = _occ(spark, d).select(F.col("ord").alias("cell"), "x", "y")
    return resample.sample_background(cells, 500, exclude=_test(spark, d).where("occ = 1"), radius=1500)


@query("score_cells", """, c AS (SELECT ord // 300 AS row, ord % 300 AS col, any_value(price ORDER BY ord) AS price, any_value(CASE WHEN ord % 7 > 0 THEN acct END ORDER BY ord) AS acct FROM occ GROUP BY ALL) SELECT row, col, (row // 512)::varchar || ':' || (col // 512)::varchar AS block, round(CASE WHEN price IS NOT NULL AND acct IS NOT NULL THEN price / 1000 + acct END, 6) AS value FROM c""", OCC)
def score_cells(spark, d):
    cells = _occ(spark, d).select(F.floor(F.col("ord") / 300).alias("row"), (F.col("ord") % 300).alias("col"), "price", F.when(F.col("ord") % 7 > 0, F.col("acct")).alias("acct"))
    return survey.score_cells(cells, ["price", "acct"], F.col("price") / 1000 + F.col("acct"))


@query("extract_at_points", """, c AS (SELECT (ord // 300)::bigint AS r, (ord % 300)::bigint AS k, price FROM occ) SELECT p.ord, round(c.price, 6) AS band FROM occ p LEFT JOIN c ON c.k = floor((p.x - 0) / 333.4)::bigint AND c.r = floor((100000 - p.y) / 333.4)::bigint""", OCC)
def extract_at_points(spark, d):
    o = _occ(spark, d)
    cells = o.select(F.floor(F.col("ord") / 300).alias("row"), (F.col("ord") % 300).alias("col"), F.col("price").alias("band"))
    return survey.extract_at_points(cells, o.select("ord", "x", "y"), 0.0, 100000.0, 333.4, 333.4, ["band"]).select("ord", "band")


@query("species_groups", "SELECT r_name AS spid, CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE 'g' || r_regionkey::varchar END AS \"group\" FROM region")
def species_groups(spark, d):
    r = views.table(spark, d, "region")
    value = F.when(F.col("r_regionkey") % 2 == 0, "NA").otherwise(F.concat(F.lit("g"), F.col("r_regionkey").cast("string")))
    meta = r.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", value)))).alias("groups"))
    return survey.species_groups(meta, "groups", [])


@query("infer_categorical", "SELECT unnest(['prio', 'occ']) AS \"column\"")
def infer_categorical(spark, d):
    return spark.createDataFrame([(c,) for c in tasks.infer_categorical(_occ(spark, d), ["price", "prio", "occ", "ord"])], "column string")


@query("geographic_radius_graph", f""", g AS (SELECT *, x * 3.6 / 1000 - 180 AS lon, y * 1.6 / 1000 - 80 AS lat FROM occ), u AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS a, cos(radians(lat)) * sin(radians(lon)) AS b, sin(radians(lat)) AS c FROM g)
SELECT p.region, p.spid, p.ord AS src, q.ord AS dst FROM u p JOIN u q ON q.region = p.region AND q.spid = p.spid AND p.ord <> q.ord AND sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) <= {scalar.chord(700_000)!r} * (1 + 1e-12)""", OCC)
def geographic_radius_graph(spark, d):
    return graphs.geographic_radius(_lonlat(_occ(spark, d)), G, "ord", 700_000)


@query("pa_unpivot", ", w AS (SELECT ord, occ AS a, (ord % 2)::int AS b FROM occ) SELECT ord, 'a' AS spid, a AS occ FROM w UNION ALL SELECT ord, 'b', b FROM w", OCC)
def pa_unpivot(spark, d):
    return tasks.unpivot_presence_absence(_occ(spark, d).select("ord", F.col("occ").alias("a"), (F.col("ord") % 2).cast("int").alias("b")), ["ord"], ["a", "b"])


@query("standardise_types", "SELECT region, coalesce(try_cast(prio[1:1] AS bigint), 0) AS occ, try_cast(prio AS double) AS x, count(*) AS n FROM occ GROUP BY ALL", OCC)
def standardise_types(spark, d):
    t = tasks.coerce_types(_occ(spark, d).select("region", F.substring("prio", 1, 1).alias("occ"), F.col("prio").alias("x")))
    return t.groupBy("region", "occ", "x").agg(F.count("*").alias("n"))


_PROFILED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("table_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c}::varchar) AS least, max({c}::varchar) AS largest FROM customer" for c in _PROFILED))
def table_profile(spark, d):
    return tasks.table_profile(views.table(spark, d, "customer"), list(_PROFILED)).drop("type")


@query("inspect_columns", None)
def inspect_columns(spark, d):
    return tasks.guess_roles(tasks.table_profile(_occ(spark, d)))


@query("draft_schema", None)
def draft_schema(spark, d):
    return tasks.draft_schema(tasks.guess_roles(tasks.table_profile(_occ(spark, d))))


NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {m} * (1 + 1e-12)"


@query("buffer_semi_planar", f"SELECT region, spid, siteid FROM occ a WHERE part = 'train' AND EXISTS (SELECT 1 FROM occ b WHERE b.part = 'test' AND b.region = a.region AND b.spid = a.spid AND {NEAR.format(m=3000)})", OCC)
def buffer_semi_planar(spark, d):
    return spatial.within_distance(_train(spark, d), _test(spark, d), 3000, on=G).select(*G, "siteid")


@query("buffer_anti_planar", f"SELECT region, spid, siteid FROM occ a WHERE part = 'train' AND NOT EXISTS (SELECT 1 FROM occ b WHERE b.part = 'test' AND b.region = a.region AND b.spid = a.spid AND {NEAR.format(m=3000)})", OCC)
def buffer_anti_planar(spark, d):
    return spatial.apply_buffer(_train(spark, d), _test(spark, d), G, 3000).select(*G, "siteid")


def _lonlat(df):
    return df.withColumn("x", F.col("x") * 3.6 / 1000 - 180).withColumn("y", F.col("y") * 1.6 / 1000 - 80)


@query("buffer_anti_geographic", f""", g AS (SELECT *, x * 3.6 / 1000 - 180 AS lon, y * 1.6 / 1000 - 80 AS lat FROM occ), u AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS a, cos(radians(lat)) * sin(radians(lon)) AS b, sin(radians(lat)) AS c FROM g)
SELECT region, spid, siteid FROM u p WHERE part = 'train' AND NOT EXISTS (SELECT 1 FROM u q WHERE q.part = 'test' AND q.region = p.region AND q.spid = p.spid AND sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) <= {scalar.chord(500_000)!r} * (1 + 1e-12))""", OCC)
def buffer_anti_geographic(spark, d):
    return spatial.apply_buffer(_lonlat(_train(spark, d)), _lonlat(_test(spark, d)), G, 500_000, geographic=True).select(*G, "siteid")


@query("buffer_diagnostics", f""", k AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM occ b WHERE b.part = 'test' AND b.region = a.region AND b.spid = a.spid AND {NEAR.format(m=3000)}) AS kept FROM occ a WHERE part = 'train'),
c AS (SELECT {KEY}, count(*) AS n_before, count(*) FILTER (occ = 1) AS presence_before, count(*) FILTER (kept) AS n_after, count(*) FILTER (kept AND occ = 1) AS presence_after FROM k GROUP BY ALL) SELECT *, n_before - n_after AS n_excluded, presence_after = 0 OR presence_after = n_after AS single_class FROM c""", OCC)
def buffer_diagnostics(spark, d):
    return spatial.buffer_diagnostics(_train(spark, d), _test(spark, d), G, 3000)


@query("spatial_folds", f""", g AS (SELECT {KEY}, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) / 20 AS s FROM occ GROUP BY ALL), t AS (SELECT occ.region, occ.spid, siteid, floor((x - x0) / s)::bigint::varchar || ':' || floor((y - y0) / s)::bigint::varchar AS block FROM occ JOIN g USING ({KEY})),
f AS (SELECT {KEY}, block, ((row_number() OVER (PARTITION BY {KEY} ORDER BY md5('32639|' || block), block) - 1) % 5)::int AS fold FROM (SELECT DISTINCT {KEY}, block FROM t)) SELECT {KEY}, siteid, block, fold FROM t JOIN f USING ({KEY}, block)""", OCC)
def spatial_folds(spark, d):
    return spatial.spatial_folds(_occ(spark, d), G).select(*G, "siteid", "block", "fold")


RES = """, j AS (SELECT s.*, o.x AS cx, o.y AS cy FROM (SELECT * FROM pred WHERE scenario = 'nonspatial') s JOIN occ o ON o.ord = s.row), g AS (SELECT region, model_name, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM j GROUP BY ALL),
c AS (SELECT j.region, j.model_name, least(floor((cx - x0) / (x1 - x0) * 10), 9)::int AS cell_x, least(floor((cy - y0) / (y1 - y0) * 10), 9)::int AS cell_y, j.y AS obs, p FROM j JOIN g USING (region, model_name))
SELECT region, model_name, cell_x, cell_y, count(*) AS n, round(avg(obs - p), 6) + 0 AS mean_residual, round(avg(obs), 6) AS mean_observed, round(avg(p), 6) AS mean_predicted FROM c GROUP BY ALL"""


@query("spatial_residuals", RES, views.PRED)
def spatial_residuals(spark, d):
    o = _occ(spark, d).select("ord", "x", F.col("y").alias("yc"))
    p = views.pred(spark, d).where("scenario = 'nonspatial'").join(o, F.col("row") == F.col("ord")).withColumnRenamed("y", "y_true")
    return spatial.spatial_residuals(p, ["region", "model_name"], x="x", y="yc")


@query("audit_sites", ", t AS (SELECT *, 'c' || (ord % 9001)::varchar AS s FROM occ), a AS (SELECT DISTINCT region, spid, s FROM t WHERE part = 'train'), b AS (SELECT DISTINCT region, spid, s FROM t WHERE part = 'test') , j AS (SELECT region, spid, s, row_number() OVER (PARTITION BY region, spid ORDER BY s) AS r FROM a JOIN b USING (region, spid, s)) SELECT region, spid, count(*) AS n_shared, string_agg(s, ',' ORDER BY s) FILTER (r <= 5) AS first_sites FROM j GROUP BY ALL", OCC)
def audit_sites(spark, d):
    site = lambda t: t.withColumn("siteid", F.concat(F.lit("c"), (F.col("ord") % 9001).cast("string")))
    return audit.shared_sites(site(_train(spark, d)), site(_test(spark, d)), G)


def _coarse(df):
    return df.withColumn("x", F.floor(F.col("x") / 2000).cast("double")).withColumn("y", F.floor(F.col("y") / 2000).cast("double"))


@query("audit_coords", ", t AS (SELECT region, spid, part, floor(x / 2000) AS x, floor(y / 2000) AS y FROM occ) SELECT region, spid, count(*) AS n_overlapping FROM t a WHERE part = 'test' AND EXISTS (SELECT 1 FROM t b WHERE b.part = 'train' AND b.region = a.region AND b.spid = a.spid AND b.x = a.x AND b.y = a.y) GROUP BY ALL", OCC)
def audit_coords(spark, d):
    return audit.shared_coordinates(_coarse(_train(spark, d)), _coarse(_test(spark, d)), G)


@query("audit_identical_rows", ", t AS (SELECT region, spid, part, prio, floor(age / 200) AS age FROM occ) SELECT region, spid, count(*) AS n_identical FROM t a WHERE part = 'test' AND EXISTS (SELECT 1 FROM t b WHERE b.part = 'train' AND b.region = a.region AND b.spid = a.spid AND b.prio = a.prio AND b.age = a.age) GROUP BY ALL", OCC)
def audit_identical_rows(spark, d):
    few = lambda t: t.withColumn("age", F.floor(F.col("age") / 200).cast("double"))
    return audit.identical_rows(few(_train(spark, d)), few(_test(spark, d)), G, ["prio", "age"])


@query("audit_duplicates", "SELECT l_returnflag, l_linestatus, sum(n) - count(*) AS n_duplicates FROM (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
def audit_duplicates(spark, d):
    rows = views.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return audit.duplicate_records(rows, ["l_returnflag", "l_linestatus"])


@query("audit_buffer", f"SELECT region, spid, count(*) AS n_within_buffer FROM occ a WHERE part = 'train' AND EXISTS (SELECT 1 FROM occ b WHERE b.part = 'test' AND b.region = a.region AND b.spid = a.spid AND {NEAR.format(m=1000)}) GROUP BY ALL", OCC)
def audit_buffer(spark, d):
    return audit.buffer_violations(_train(spark, d), _test(spark, d), G, 1000)


@query("audit_target_copy", "SELECT 'price' AS feature, false AS is_copy UNION ALL SELECT 'copy', true UNION ALL SELECT 'occ', true", OCC)
def audit_target_copy(spark, d):
    return audit.target_copies(_occ(spark, d).withColumn("copy", F.col("occ") + 1e-10), ["price", "copy", "occ"])


@query("audit_edges", ", e AS (SELECT ord AS src, lead(ord) OVER (ORDER BY ord) AS dst FROM occ), j AS (SELECT a.part AS p, b.part AS q FROM e JOIN occ a ON a.ord = src JOIN occ b ON b.ord = dst) SELECT count(*) FILTER (p <> q) AS n_crossing, CASE WHEN count(*) FILTER (p <> q) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM j", OCC)
def audit_edges(spark, d):
    o = _occ(spark, d)
    e = o.select(F.col("ord").alias("src"), F.lead("ord").over(Window.orderBy("ord")).alias("dst"))
    return audit.crossing_edges(e, o.select(F.col("ord").alias("node"), "part"))


@query("audit_status", f""", n AS (SELECT a.region, a.spid, count(*) AS f FROM occ a WHERE part = 'train' AND EXISTS (SELECT 1 FROM occ b WHERE b.part = 'test' AND b.region = a.region AND b.spid = a.spid AND {NEAR.format(m=1)}) GROUP BY ALL), g AS (SELECT DISTINCT region, spid FROM occ)
SELECT g.region, g.spid, CASE WHEN f > 0 THEN 1 ELSE 0 END::bigint AS n_fatal, 0::bigint AS n_warning, CASE WHEN f > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM g LEFT JOIN n USING (region, spid)""", OCC)
def audit_status(spark, d):
    return audit.audit(_train(spark, d), _test(spark, d), G, ["price", "acct", "age", "x", "y"], buffer_m=1)


def _md5(seed, row="ord"):
    return f"md5('{seed}|' || {row}::varchar)"


@query("holdout_stratified", f""", r AS (SELECT *, count(*) OVER (PARTITION BY {KEY}, occ) AS n, row_number() OVER (PARTITION BY {KEY}, occ ORDER BY {_md5(32639)}, ord) AS k FROM occ)
SELECT {KEY}, ord, occ, CASE WHEN k <= CASE WHEN n = 1 THEN 0 ELSE least(greatest(round_even(n * 0.2::double, 0), 1), n - 1) END THEN 'test' ELSE 'train' END AS part FROM r""", OCC)
def holdout_stratified(spark, d):
    return resample.stratified_holdout(_occ(spark, d).drop("part"), G, "ord").select(*G, "ord", "occ", "part")


@query("background_subsample", f", r AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, occ ORDER BY {_md5(32639)}, ord) AS k, floor(sum(occ) OVER (PARTITION BY {KEY}) * 0.5) AS n FROM occ) SELECT {KEY}, ord, occ FROM r WHERE occ = 1 OR k <= n", OCC)
def background_subsample(spark, d):
    return resample.background_subsample(_occ(spark, d), G, "ord", ratio=0.5).select(*G, "ord", "occ")


@query("ensemble_balanced", f", m AS (SELECT occ.*, member_id FROM occ, range(0, 16) r(member_id)), k AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, member_id, occ ORDER BY md5((32639 + member_id)::varchar || '|' || ord::varchar), ord) AS k, sum(occ) OVER (PARTITION BY {KEY}, member_id) AS n FROM m) SELECT {KEY}, member_id::int AS member_id, ord, occ FROM k WHERE occ = 1 OR k <= n", OCC)
def ensemble_balanced(spark, d):
    return resample.balanced_members(_occ(spark, d), G, "ord").select(*G, "member_id", "ord", "occ")


PARTS = f", b AS (SELECT *, (ntile(16) OVER (PARTITION BY {KEY} ORDER BY {_md5(32639)}, ord) - 1)::int AS member_id FROM occ WHERE occ = 0), m AS (SELECT {KEY}, member_id, ord, occ FROM b UNION ALL SELECT {KEY}, member_id, ord, occ FROM occ JOIN (SELECT DISTINCT {KEY}, member_id FROM b) USING ({KEY}) WHERE occ = 1)"


@query("ensemble_partition", PARTS + f" SELECT {KEY}, member_id, ord, occ FROM m", OCC)
def ensemble_partition(spark, d):
    return resample.partition_members(_occ(spark, d), G, "ord").select(*G, "member_id", "ord", "occ")


@query("ensemble_cap", PARTS + f", c AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, member_id ORDER BY occ DESC, {_md5(32639)}, ord) AS k FROM m) SELECT {KEY}, member_id, count(*) FILTER (occ = 1) AS n_presence, count(*) FILTER (occ = 0) AS n_background FROM c WHERE k <= 40 GROUP BY ALL", OCC)
def ensemble_cap(spark, d):
    m = resample.partition_members(_occ(spark, d), G, "ord")
    return resample.member_counts(resample.cap_members(m, G, "ord", cap=40), G)


@query("average_logits", ", l AS (SELECT scenario, row, avg(ln(greatest(least(p, 1 - 1e-7), 1e-7) / (1 - greatest(least(p, 1 - 1e-7), 1e-7)))) AS z FROM pred GROUP BY ALL) SELECT scenario, row, round(1 / (1 + exp(-z)), 6) AS p FROM l", views.PRED)
def average_logits(spark, d):
    return resample.average_logits(views.pred(spark, d), ["scenario", "row"])


@query("stratified_folds", f"SELECT {KEY}, ord, ((row_number() OVER (PARTITION BY {KEY}, occ ORDER BY {_md5(32639)}, ord) - 1) % 5)::int AS fold FROM occ", OCC)
def stratified_folds(spark, d):
    return resample.stratified_folds(_occ(spark, d), G, "ord").select(*G, "ord", "fold")


@query("presence_weights", f"SELECT {KEY}, occ, count(*) AS n, round(CASE WHEN occ = 1 THEN 1 ELSE max(p)::double / max(b) END, 6) AS weight FROM (SELECT *, sum(occ) OVER (PARTITION BY {KEY}) AS p, sum(1 - occ) OVER (PARTITION BY {KEY}) AS b FROM occ) GROUP BY region, spid, occ", OCC)
def presence_weights(spark, d):
    return resample.presence_weights(_occ(spark, d), G).groupBy(*G, "occ").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


LONG = "u AS (SELECT region, part, 'price' AS \"column\", price AS v FROM occ UNION ALL SELECT region, part, 'acct', acct FROM occ UNION ALL SELECT region, part, 'age', age FROM occ)"


@query("recipe_zero_variance", f", {LONG}, z AS (SELECT * FROM u UNION ALL SELECT region, part, 'flat', 1 FROM occ) SELECT region, \"column\", count(v) AS n, count(DISTINCT v) AS n_distinct, round(var_pop(v), 2) AS variance, count(DISTINCT v) <= 1 AS dropped FROM z GROUP BY ALL", OCC)
def recipe_zero_variance(spark, d):
    t = recipe.zero_variance(_occ(spark, d).withColumn("flat", F.lit(1.0)), ["region"], [*PREDICTORS, "flat"])
    return t.withColumn("variance", F.round("variance", 2))


YJ = "CASE WHEN v >= 0 THEN CASE WHEN abs(lam) < 1e-8 THEN ln(1 + v) ELSE (pow(v + 1, lam) - 1) / lam END ELSE CASE WHEN abs(lam - 2) < 1e-8 THEN -ln(1 - v) ELSE -(pow(1 - v, 2 - lam) - 1) / (2 - lam) END END"


@query("recipe_yeo_johnson_apply", f", {LONG}, l AS (SELECT *, lam FROM u, (VALUES (0.0::double), (0.5), (1.0), (2.0)) t(lam)) SELECT region, \"column\", lam, round(avg(ln(1 + abs({YJ}))), 6) AS size FROM l GROUP BY ALL", OCC)
def recipe_yeo_johnson_apply(spark, d):
    t = recipe.long_form(_occ(spark, d), ["region"], PREDICTORS).withColumn("lam", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 2.0)])))
    return t.groupBy("region", "column", "lam").agg(F.avg(F.ln(1 + F.abs(scalar.yeo_johnson("v", F.col("lam"))))).alias("size"))


@query("recipe_lambda_grid", f", {LONG}, l AS (SELECT u.*, lam, {YJ} AS t FROM u, (VALUES (-1.0::double), (-0.5), (0.0), (0.5), (1.0), (1.5), (2.0)) t(lam) WHERE part = 'train'), k AS (SELECT region, \"column\", lam, -count(v) / 2.0::double * ln(var_pop(t)) + (lam - 1) * sum(sign(v) * ln(abs(v) + 1)) AS llf FROM l GROUP BY region, \"column\", lam) SELECT region, \"column\", arg_max(lam, llf) AS lam FROM k GROUP BY ALL", OCC)
def recipe_lambda_grid(spark, d):
    return recipe.lambda_grid(_train(spark, d), ["region"], PREDICTORS, [-1, -0.5, 0, 0.5, 1, 1.5, 2])


@query("recipe_zscore", ", s AS (SELECT region, avg(price) AS m, stddev_samp(price) AS sd FROM occ WHERE part = 'train' GROUP BY ALL) SELECT region, ord, round((price - m) / sd, 6) + 0 AS price FROM occ JOIN s USING (region) WHERE part = 'test'", OCC)
def recipe_zscore(spark, d):
    return recipe.standard_scale(_test(spark, d), ["region"], ["price"], _train(spark, d)).select("region", "ord", "price")


@query("recipe_fit_transform", None)
def recipe_fit_transform(spark, d):
    r = recipe.SdmRecipe(["region"], PREDICTORS, ["prio"]).fit(_train(spark, d), "ord")
    return r.transform(_test(spark, d)).select("region", "ord", *PREDICTORS, "prio", "prio_code")


LEVELS = ", l AS (SELECT region, prio AS level, min(ord) AS o FROM occ WHERE part = 'train' AND prio <> '1-URGENT' GROUP BY ALL), c AS (SELECT region, level, (row_number() OVER (PARTITION BY region ORDER BY o, level) - 1)::int AS code FROM l)"


@query("category_codes", LEVELS + " SELECT occ.region, ord, prio, coalesce(code, -1)::int AS prio_code FROM occ LEFT JOIN c ON c.region = occ.region AND c.level = occ.prio WHERE part = 'test'", OCC)
def category_codes(spark, d):
    codes = recipe.levels(_train(spark, d).where("prio != '1-URGENT'"), ["region"], ["prio"], "ord")
    return recipe.apply_levels(_test(spark, d), codes, ["region"], "prio").select("region", "ord", "prio", "prio_code")


@query("one_hot", "SELECT prio, (prio = '1-URGENT')::int AS \"prio=1-URGENT\", (prio = '5-LOW')::int AS \"prio=5-LOW\", count(*) AS n FROM occ GROUP BY ALL", OCC)
def one_hot(spark, d):
    t = recipe.one_hot(_occ(spark, d), "prio", ["1-URGENT", "5-LOW"])
    return t.groupBy("prio", F.col("`prio=1-URGENT`"), F.col("`prio=5-LOW`")).agg(F.count("*").alias("n"))


@query("pca", None)
def pca(spark, d):
    return recipe.pca(_occ(spark, d), PREDICTORS, 2)[0].select("ord", "pc")


@query("fast_ica", None)
def fast_ica(spark, d):
    return features.fast_ica(_occ(spark, d), ["region"], PREDICTORS, 2)


@query("temporal_summary", ", i AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY day) - 1)::double AS i FROM series) SELECT id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max, round(arg_min(value, i), 6) AS first, round(arg_max(value, i), 6) AS last, round(coalesce(regr_slope(value, i), 0), 6) + 0 AS slope FROM i GROUP BY ALL", SERIES)
def temporal_summary(spark, d):
    return features.temporal_summary(views.series(spark, d), "id", "day", "value")


@query("patch_statistics", "SELECT vec_id, round(list_avg(e), 6) + 0 AS mean, round(list_stddev_pop(e), 6) AS sd, round(list_min(e), 6) AS min, round(list_max(e), 6) AS max, round(list_median(e), 6) + 0 AS median FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)")
def patch_statistics(spark, d):
    return features.patch_statistics(views.table(spark, d, "embeddings"), "vec_id", "embedding")


def _halves(spark, d):
    e = F.col("embedding").cast("array<double>")
    return views.table(spark, d, "embeddings").select("vec_id", F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))


@query("scale_fusion_attention", """WITH h AS (SELECT vec_id, embedding[1:32]::double[] AS a, embedding[33:64]::double[] AS b FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS na, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb FROM h),
w AS (SELECT *, exp(na - greatest(na, nb)) / (exp(na - greatest(na, nb)) + exp(nb - greatest(na, nb))) AS w FROM n) SELECT vec_id, round(a[1] * w + b[1] * (1 - w), 6) + 0 AS f1, round(list_sum(a) * w + list_sum(b) * (1 - w), 6) + 0 AS total FROM w""")
def scale_fusion_attention(spark, d):
    t = _halves(spark, d).withColumn("f", features.combine_scales([F.col("a"), F.col("b")], "attention"))
    return t.select("vec_id", F.get("f", F.lit(0)).alias("f1"), F.aggregate("f", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("scale_fusion_mean_max", "WITH h AS (SELECT vec_id, embedding[1:32]::double[] AS a, embedding[33:64]::double[] AS b FROM embeddings) SELECT vec_id, round((a[3] + b[3]) / 2, 6) + 0 AS mean3, round(greatest(a[3], b[3]), 6) + 0 AS max3, 64 AS width FROM h")
def scale_fusion_mean_max(spark, d):
    ab = [F.col("a"), F.col("b")]
    t = _halves(spark, d)
    return t.select("vec_id", F.get(features.combine_scales(ab, "mean"), F.lit(2)).alias("mean3"), F.get(features.combine_scales(ab, "max"), F.lit(2)).alias("max3"), F.size(features.combine_scales(ab, "concat")).alias("width"))


@query("fusion_concat", "SELECT ord, round(age, 6) AS f0, round(embedding[1]::double, 6) + 0 AS f1, 66 AS width FROM occ JOIN embeddings ON vec_id = ord", OCC)
def fusion_concat(spark, d):
    t = _occ(spark, d).join(views.table(spark, d, "embeddings"), F.col("vec_id") == F.col("ord"))
    f = features.concat_fusion({"terrain": F.col("embedding"), "climate": F.array("age", "price")})
    return t.select("ord", F.get(f, F.lit(0)).alias("f0"), F.get(f, F.lit(2)).alias("f1"), F.size(f).alias("width"))


@query("fusion_early", ", s AS (SELECT avg(age) AS ma, stddev_samp(age) AS sa, avg(price) AS mp, stddev_samp(price) AS sp FROM occ WHERE part = 'train') SELECT ord, round((age - ma) / sa, 6) + 0 AS f0, round((price - mp) / sp, 6) + 0 AS f1 FROM occ, s WHERE part = 'test'", OCC)
def fusion_early(spark, d):
    t = recipe.standard_scale(_test(spark, d), [], ["age", "price"], _train(spark, d))
    f = features.concat_fusion({"a": F.array("age"), "b": F.array("price")})
    return t.select("ord", F.get(f, F.lit(0)).alias("f0"), F.get(f, F.lit(1)).alias("f1"))


SOME = ", n AS (SELECT region, spid, ord, x, y, age, price FROM occ)"
SYM = "SELECT DISTINCT region, spid, src, dst FROM (SELECT region, spid, src, dst FROM e UNION ALL SELECT region, spid, dst, src FROM e) WHERE src <> dst"


def _nodes(spark, d):
    return _occ(spark, d).select(*G, "ord", "x", "y", "age", "price")


def _knn_sql(distance, k, frm="n"):
    return f", e AS (SELECT region, spid, src, dst FROM (SELECT a.region, a.spid, a.ord AS src, b.ord AS dst, row_number() OVER (PARTITION BY a.ord ORDER BY {distance}, b.ord) AS k FROM {frm} a JOIN {frm} b ON a.region = b.region AND a.spid = b.spid AND a.ord <> b.ord) WHERE k <= {k}) "


@query("graph_knn_geo", SOME + _knn_sql("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", 8) + SYM, OCC)
def graph_knn_geo(spark, d):
    return graphs.geographic_knn(_nodes(spark, d), G, "ord")


Z = SOME + ", z AS (SELECT n.region, n.spid, ord, (x - mx) / sx AS zx, (y - my) / sy AS zy, (age - ma) / sa AS za, (price - mp) / sp AS zp FROM n JOIN (SELECT region, spid, avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy, avg(age) AS ma, stddev_samp(age) AS sa, avg(price) AS mp, stddev_samp(price) AS sp FROM n GROUP BY ALL) USING (region, spid))"


@query("graph_knn_env", Z + _knn_sql("round(sqrt((a.za - b.za) * (a.za - b.za) + (a.zp - b.zp) * (a.zp - b.zp)), 9)", 5, "z") + SYM, OCC)
def graph_knn_env(spark, d):
    return graphs.environmental_knn(_nodes(spark, d), G, "ord", ["age", "price"], 5)


@query("graph_hybrid", Z + _knn_sql("round(sqrt(0.5 * ((a.zx - b.zx) * (a.zx - b.zx) + (a.zy - b.zy) * (a.zy - b.zy)) + 0.5 * ((a.za - b.za) * (a.za - b.za) + (a.zp - b.zp) * (a.zp - b.zp))), 9)", 5, "z") + SYM, OCC)
def graph_hybrid(spark, d):
    return graphs.hybrid_knn(_nodes(spark, d), G, "ord", ["age", "price"], 5)


RADIUS = SOME + ", e AS (SELECT a.region, a.spid, a.ord AS src, b.ord AS dst FROM n a JOIN n b ON a.region = b.region AND a.spid = b.spid AND a.ord <> b.ord AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 9000 * (1 + 1e-12))"


@query("graph_radius", RADIUS + " SELECT region, spid, src, dst FROM e", OCC)
def graph_radius(spark, d):
    return graphs.radius_edges(_nodes(spark, d), G, "ord", 9000)


@query("graph_degree_stats", RADIUS + ", g AS (SELECT n.region, n.spid, n.ord, count(src) AS deg FROM n LEFT JOIN e ON e.src = n.ord GROUP BY ALL) SELECT region, spid, count(*) AS n_nodes, sum(deg)::bigint AS n_edges, round(sum(deg)::double / count(*), 6) AS mean_degree, count(*) FILTER (deg = 0) AS isolated_nodes FROM g GROUP BY ALL", OCC)
def graph_degree_stats(spark, d):
    return graphs.radius_degrees(_nodes(spark, d), G, "ord", 9000)


@query("graph_user", "SELECT 0::bigint AS src, n_nationkey::bigint AS dst FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey::bigint, 0::bigint FROM nation WHERE n_nationkey > 0")
def graph_user(spark, d):
    n = views.table(spark, d, "nation").select(F.lit(0).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    return graphs.user_graph(n, 25)


@query("graph_patch", None)
def graph_patch(spark, d):
    return graphs.patch_adjacency(_occ(spark, d), "ord", ["x", "y", "age"])[1]


@query("scalar_functions", """SELECT ord, prio, regexp_replace(trim(regexp_replace(prio || ' / ' || region, '[^A-Za-z0-9._-]+', '-', 'g'), '-'), '^$', 'na') AS slug, lower(replace(region, '_', '-')) AS name, sha256(ord::varchar)[1:12] AS short,
CASE WHEN abs(acct / 100000) <= 0.01 THEN 'MATCH' WHEN abs(acct / 100000) <= 0.025 THEN 'CLOSE' ELSE 'MISMATCH' END AS band, round(1 / (1 + exp(-acct / 1000)), 6) AS expit FROM occ""", OCC)
def scalar_functions(spark, d):
    return _occ(spark, d).select("ord", "prio", scalar.slug(F.concat("prio", F.lit(" / "), "region")).alias("slug"), scalar.normalise_name("region").alias("name"), F.substring(F.sha2(F.col("ord").cast("string"), 256), 1, 12).alias("short"), scalar.reproduction_status(F.col("acct") / 100000).alias("band"), scalar.expit(F.col("acct") / 1000).alias("expit"))


@query("hash_split", f"SELECT {KEY}, sha256(string_agg(ord::varchar, ',' ORDER BY ord::varchar) || '|fold0') AS digest FROM occ GROUP BY ALL", OCC)
def hash_split(spark, d):
    return _occ(spark, d).groupBy(*G).agg(scalar.hash_split("ord", "fold0").alias("digest"))
