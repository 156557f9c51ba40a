"""Queries over learners, objectives, reports and plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import encoders, explain, graphs, grouped, learners, metrics, newton, objectives, penalised, report, resample, tasks, trees
from . import views
from .benchmarks import RunConfig, provenance
from .catalogue import query
from .planner import Methodology, Modality, StagedPlanner, expand_grid
from .views import OCC, PREDICTORS, PRED, RESULTS

G = ["region", "spid"]
JOB = "scenario, region, species_id, model_name"


def _train(spark, d):
    return views.occ(spark, d).where("part = 'train'")


def _test(spark, d):
    return views.occ(spark, d).where("part = 'test'")


@query("model_dummy", ", p AS (SELECT region, spid, avg(occ) AS p FROM occ WHERE part = 'train' GROUP BY ALL) SELECT region, spid, ord, round(p.p, 6) AS p FROM occ JOIN p USING (region, spid) WHERE part = 'test'", OCC)
def model_dummy(spark, d):
    return learners.dummy(_train(spark, d), _test(spark, d), G).select(*G, "ord", "p")


@query("model_gaussian_nb", """, s AS (SELECT region, spid, occ AS c, count(*) AS n, avg(price) AS mp, var_pop(price) AS vp, avg(acct) AS ma, var_pop(acct) AS va, avg(age) AS mg, var_pop(age) AS vg FROM occ WHERE part = 'train' GROUP BY ALL),
e AS (SELECT region, spid, greatest(var_pop(price), var_pop(acct), var_pop(age)) * 1e-9 AS eps, count(*) AS total FROM occ WHERE part = 'train' GROUP BY ALL),
l AS (SELECT o.region, o.spid, o.ord, c, ln(n::double / total) - ln((vp + eps) * 2 * pi()) / 2 - (price - mp) * (price - mp) / ((vp + eps) * 2) - ln((va + eps) * 2 * pi()) / 2 - (acct - ma) * (acct - ma) / ((va + eps) * 2) - ln((vg + eps) * 2 * pi()) / 2 - (age - mg) * (age - mg) / ((vg + eps) * 2) AS l FROM occ o JOIN s USING (region, spid) JOIN e USING (region, spid) WHERE part = 'test'),
w AS (SELECT region, spid, ord, max(l) FILTER (c = 1) AS l1, max(l) FILTER (c = 0) AS l0 FROM l GROUP BY ALL) SELECT region, spid, ord, round(CASE WHEN l1 IS NULL THEN 0 WHEN l0 IS NULL THEN 1 ELSE 1 / (1 + exp(l0 - l1)) END, 6) AS p FROM w""", OCC)
def model_gaussian_nb(spark, d):
    return learners.gaussian_nb(_train(spark, d), _test(spark, d), G, PREDICTORS, "ord")


@query("model_knn", """, t AS (SELECT a.region, a.spid, a.ord, b.occ, row_number() OVER (PARTITION BY a.ord ORDER BY abs(a.price - b.price) + abs(a.acct - b.acct) + abs(a.age - b.age), b.ord) AS k FROM occ a JOIN occ b ON a.region = b.region AND a.spid = b.spid WHERE a.part = 'test' AND b.part = 'train')
SELECT region, spid, ord, round(avg(occ), 6) AS p FROM t WHERE k <= 5 GROUP BY ALL""", OCC)
def model_knn(spark, d):
    return learners.knn(_train(spark, d), _test(spark, d), G, PREDICTORS, "ord")


@query("model_logistic_regression", None)
def model_logistic_regression(spark, d):
    return learners.logistic(_train(spark, d), _test(spark, d), G, PREDICTORS, "ord")


#: The gradient of each group's penalised likelihood at the coefficients that were found, to one digit in front of the point: 0 everywhere.
@query("logistic_gradient", ", g AS (SELECT DISTINCT region, spid FROM occ WHERE part = 'train') SELECT region, spid, 0.0::double AS gradient FROM g", OCC)
def logistic_gradient(spark, d):
    train = _train(spark, d)
    m = train.groupBy(*G).agg(*[f(F.col(x)).alias(f"{n}_{x}") for x in PREDICTORS for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    x = [(F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}") for f in PREDICTORS]
    t = train.join(m, G)
    beta = newton.fit(t, G, x, F.col("occ"), ridge=1.0).drop("gradient")
    t = t.join(beta, G).withColumn("r", F.col("occ") - scalar.expit(newton.score(x)))
    slopes = [F.abs(F.sum(F.col("r") * c) - F.get(F.first("beta"), F.lit(i + 1))) for i, c in enumerate(x)]
    return t.groupBy(*G).agg(F.round(F.greatest(F.abs(F.sum("r")), *slopes), 5).alias("gradient"))


def _model(name):
    @query(f"model_{name.replace('-', '_')}", None)
    def run(spark, d):
        """A model for each region and species."""
        return learners.predict(name, _train(spark, d), _test(spark, d), G, PREDICTORS, "ord")


for _name in ("adaboost", "decision-tree", "random-forest-mllib", "random-forest", "extra-trees", "gradient-boosting", "brt", "maxnet", "gam", "svm", "linear-svc", "mlp-mllib"):
    _model(_name)


LONG = ", v AS (SELECT region, spid, occ, unnest([0, 1, 2]) AS f, unnest([price, acct, age]) AS x FROM occ WHERE part = 'train'), n AS (SELECT *, row_number() OVER (PARTITION BY region, spid, f ORDER BY x) AS r, count(*) OVER w AS n, max(x) OVER w AS top FROM v WINDOW w AS (PARTITION BY region, spid, f))"


#: The tree of one split: of all cuts at 63 quantiles of each feature, the one that takes most from the squared error.
@query("tree_stump", LONG + """, e AS (SELECT DISTINCT region, spid, f, x AS cut FROM n JOIN (SELECT unnest(range(1, 64)) AS k) q ON r = ceil(k * n / 64.0) WHERE x < top),
s AS (SELECT e.region, e.spid, e.f, cut, sum(occ) FILTER (x <= cut)::double AS sl, count(*) FILTER (x <= cut) AS wl, sum(occ)::double AS st, count(*) AS wt FROM e JOIN v ON e.region = v.region AND e.spid = v.spid AND e.f = v.f GROUP BY ALL),
g AS (SELECT *, sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) - st * st / wt AS gain FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY region, spid ORDER BY round(gain / top, 9) DESC, f, cut) AS best FROM (SELECT *, max(gain) OVER (PARTITION BY region, spid) AS top FROM g))
SELECT region, spid, f::int AS feature, round(cut, 6) AS cut, round(sl / wl, 6) AS p_low, round((st - sl) / (wt - wl), 6) AS p_high, wl::double AS n_low FROM b WHERE best = 1 AND gain > 1e-9""", OCC)
def tree_stump(spark, d):
    t = trees.fit(_train(spark, d), G, PREDICTORS, "ord", trees.Spec(depth=1)).where(F.size("value") > 1)
    at = lambda c, i: F.get(c, F.lit(i))
    return t.select(*G, at("feature", 0).alias("feature"), at("threshold", 0).alias("cut"), at("value", 1).alias("p_low"), at("value", 2).alias("p_high"), at("cover", 1).alias("n_low"))


def _draw_sql(tree):
    a, c = trees.draw_numbers(scalar.SEED, tree)
    return f"(h * {a} + {c}) % {trees.PRIME} + 0.5"


#: How many background rows and presences the first three trees of a down-sampled forest take, by the draws' arithmetic.
@query("forest_draws", ", r AS (SELECT region, spid, occ, ('0x' || md5('32639|' || ord::varchar)[:8])::bigint % 2147483647 AS h FROM occ WHERE part = 'train'), c AS (SELECT region, spid, sum(occ)::double AS p, count(*) - sum(occ) AS b FROM r GROUP BY ALL), u AS (" + " UNION ALL ".join(f"SELECT *, {t} AS tree, ({_draw_sql(t)}) / 2147483647 AS u FROM r" for t in range(3)) + """),
m AS (SELECT u.*, CASE WHEN occ = 1 THEN 1.0::double ELSE p / greatest(b, 1) END AS l FROM u JOIN c USING (region, spid)), t AS (SELECT region, spid, tree, occ, list_sum(list_transform(range(1, 21), lambda k: CASE WHEN u >= list_sum(list_transform(range(0, k), lambda j: exp(-l) * pow(l, j) / factorial(j::int))) THEN 1 ELSE 0 END)) AS times FROM m)
SELECT region, spid, tree::int AS tree, sum(times) FILTER (occ = 1)::double AS presences, coalesce(sum(times) FILTER (occ = 0), 0)::double AS background FROM t GROUP BY ALL HAVING sum(occ) > 0""", OCC)
def forest_draws(spark, d):
    spec = trees.Spec(trees=3, draw="balanced", depth=0)
    train = _train(spark, d)
    n = train.groupBy(*G).agg(F.sum("occ").cast("double").alias("__p"), F.count_if(F.col("occ") == 0).cast("double").alias("__b"))
    rows = train.join(n, G).select(*G, "occ", "__p", "__b", trees.row_hash("ord").alias("h"))

    def take(batches):
        for t in batches:
            for tree in range(3):
                out = t[[*G, "occ"]].copy()
                out["tree"] = tree
                mean = np.where(t["occ"] == 1, 1.0, t["__p"] / np.maximum(t["__b"], 1))
                out["times"] = trees.poisson(trees.uniform(t["h"].to_numpy(), spec.seed, tree), mean)
                yield out

    t = rows.mapInPandas(take, "region string, spid string, occ int, tree int, times double")
    sums = t.groupBy(*G, "tree").agg(F.sum(F.when(F.col("occ") == 1, F.col("times"))).alias("presences"), F.coalesce(F.sum(F.when(F.col("occ") == 0, F.col("times"))), F.lit(0.0)).alias("background"))
    return sums.where("presences is not null")


def _rest(spark, d, name, off):
    """How far the fitted model of each group is from where its penalised likelihood is greatest, per presence, at four digits: off(learner, model, total, presences), where total sums a
    function of x and y over the rows, in batches."""
    learner = penalised.LEARNERS[name]()
    train = _train(spark, d)
    model = grouped.fit(train, G, PREDICTORS, learner)
    by = lambda t: t.groupBy(*G)

    def run(rows, of):
        data = grouped.Here(rows[PREDICTORS].to_numpy(float), rows["occ"].to_numpy(float), np.ones(len(rows)), None)
        out = rows[G].iloc[:1].copy()
        total = lambda f: data.total(lambda x, y, w: f(x, y))
        out["n"], out["rest"] = len(rows), round(off(learner, np.asarray(of["beta"].iloc[0]), total, data.y.sum()) / max(data.y.sum(), 1), 4) + 0.0
        return out

    return by(train.select(*G, *PREDICTORS, "occ")).cogroup(by(model)).applyInPandas(run, "region string, spid string, n long, rest double")


REST = ", g AS (SELECT region, spid, count(*) AS n FROM occ WHERE part = 'train' GROUP BY ALL) SELECT region, spid, n, 0.0::double AS rest FROM g"


@query("maxnet_rest", REST, OCC)
def maxnet_rest(spark, d):
    """By how much the conditions of the L1-penalised optimum are missed."""

    def off(learner, model, total, presences):
        beta = learner.parts(model, 3)[5]

        def sums(x, y):
            f = learner.design(model, x)
            q = penalised.expit(f @ beta)
            return np.stack([f[y == 1].sum(0), (f[y == 1] ** 2).sum(0), f.T @ (y - (y + penalised.BACKGROUND) * q)])

        t = total(sums)
        return penalised.kkt(beta, t[2], np.r_[0, learner.penalties(t[:2, 1:], presences)])

    return _rest(spark, d, "maxnet", off)


@query("gam_rest", REST, OCC)
def gam_rest(spark, d):
    """The largest part of the penalised likelihood's gradient."""

    def off(learner, model, total, presences):
        ends, strength, beta = learner.parts(model, 3)

        def gradient(x, y):
            f = learner.design(x, ends)
            return f.T @ (y - penalised.expit(f @ beta))

        return np.abs(total(gradient) - np.tensordot(strength, learner.penalty(3), 1) @ beta).max()

    return _rest(spark, d, "gam", off)


STUMP = LONG + """, e AS (SELECT DISTINCT region, spid, f, x AS cut FROM n JOIN (SELECT unnest(range(1, 64)) AS k) q ON r = ceil(k * n / 64.0) WHERE x < top),
s AS (SELECT e.region, e.spid, e.f, cut, sum(occ) FILTER (x <= cut)::double AS sl, count(*) FILTER (x <= cut) AS wl, sum(occ)::double AS st, count(*) AS wt FROM e JOIN v ON e.region = v.region AND e.spid = v.spid AND e.f = v.f GROUP BY ALL),
g AS (SELECT *, sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) - st * st / wt AS gain FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY region, spid ORDER BY round(gain / top, 9) DESC, f, cut) AS best FROM (SELECT *, max(gain) OVER (PARTITION BY region, spid) AS top FROM g)), stump AS (SELECT * FROM b WHERE best = 1 AND gain > 1e-9)"""


#: Of a tree of one split, what its feature adds to the mean: the leaf's value less it.
@query("stump_shapley", STUMP + """, t AS (SELECT region, spid, unnest([0, 1, 2]) AS f, unnest([price, acct, age]) AS x FROM occ WHERE part = 'test')
SELECT t.region, t.spid, ['price', 'acct', 'age'][t.f + 1] AS feature, round(avg(CASE WHEN t.f = s.f THEN abs(CASE WHEN x <= cut THEN sl / wl ELSE (st - sl) / (wt - wl) END - st / wt) ELSE 0 END), 6) AS mean_abs, round(avg(CASE WHEN t.f = s.f THEN CASE WHEN x <= cut THEN sl / wl ELSE (st - sl) / (wt - wl) END - st / wt ELSE 0 END), 6) + 0 AS mean
FROM t JOIN stump s USING (region, spid) GROUP BY ALL""", OCC)
def stump_shapley(spark, d):
    model = trees.fit(_train(spark, d), G, PREDICTORS, "ord", trees.Spec(depth=1))
    whole = model.join(model.where(F.size("value") > 1).select(*G), G, "left_semi")
    return explain.summary(explain.tree_shapley(whole, _test(spark, d), G, PREDICTORS, "ord"), G, PREDICTORS)


@query("tree_shapley", None)
def tree_shapley(spark, d):
    """Of gradient-boosted trees, in log-odds."""
    model = trees.fit(_train(spark, d), G, PREDICTORS, "ord", trees.SPECS["gradient-boosting"])
    return explain.summary(explain.tree_shapley(model, _test(spark, d), G, PREDICTORS, "ord"), G, PREDICTORS)


def _fused(spark, d, fusion):
    rows = {p: f(spark, d).withColumn("id", F.col("ord")) for p, f in (("train", _train), ("test", _test))}
    parts = {"climate": ["age"], "economy": ["price", "acct"]}
    enc = {m: encoders.Standardized("id", c).fit(rows["train"]) for m, c in parts.items()}
    of = lambda p: {m: e.transform(rows[p]) for m, e in enc.items()}
    return fusion.fit(of("train"), rows["train"]).transform(of("test")).select(F.col("id").alias("ord"), F.get("value", F.lit(0)).alias("p"))


@query("fusion_gated", None)
def fusion_gated(spark, d):
    return _fused(spark, d, encoders.Gated("id"))


@query("fusion_moe", None)
def fusion_moe(spark, d):
    return _fused(spark, d, encoders.MixtureOfExperts("id"))


@query("model_subsample_ensemble", None)
def model_subsample_ensemble(spark, d):
    members = resample.balanced_members(_train(spark, d), G, "ord")
    return learners.ensemble(members, _test(spark, d), G, "ord", lambda a, b, keys: learners.gaussian_nb(a, b, keys, PREDICTORS, "ord"))


@query("inner_cv_tuning", None)
def inner_cv_tuning(spark, d):
    fit = lambda a, b, keys, k: learners.knn(a, b, keys, PREDICTORS, "ord", k=k)
    return learners.best_setting(learners.tune(_train(spark, d), G, "ord", [{"k": 3}, {"k": 9}], fit), G)


@query("late_fusion", None)
def late_fusion(spark, d):
    return learners.late_fusion(_train(spark, d), _test(spark, d), {"climate": ["age"], "economy": ["price", "acct"]}, "ord")


@query("linear_shapley", """, m AS (SELECT region, avg(price) AS mp, avg(age) AS mg FROM occ GROUP BY ALL), c AS (SELECT region, 'price' AS feature, (price - mp) * 0.001 AS phi FROM occ JOIN m USING (region) UNION ALL SELECT region, 'age', (age - mg) * -2.0 FROM occ JOIN m USING (region))
SELECT region, feature, round(avg(abs(phi)), 4) AS mean_abs FROM c GROUP BY ALL""", OCC)
def linear_shapley(spark, d):
    t = learners.linear_shapley(views.occ(spark, d), {"price": 0.001, "age": -2.0}, ["region"])
    return t.select("region", "feature", F.round("mean_abs", 4).alias("mean_abs"))


@query("graph_smoothing", None)
def graph_smoothing(spark, d):
    return graphs.radius_smoothed(views.occ(spark, d).select(*G, "ord", "x", "y", "age"), G, "ord", ["age"], 9000)


@query("skip_rows", "SELECT 'xgboost' AS model_name, 'SKIPPED_DEPENDENCY' AS status, 'xgboost is not available here' AS error UNION ALL SELECT 'tabpfn-sdm', 'SKIPPED_LICENSE', 'tabpfn-sdm is not available here'")
def skip_rows(spark, d):
    return learners.skip_rows(spark.createDataFrame([("xgboost",), ("tabpfn-sdm",), ("knn",)], "model_name string"))


LOGIT = f", z AS (SELECT {JOB}, row, y, ln(p / (1 - p)) AS z FROM pred WHERE scenario = 'nonspatial'), c AS (SELECT *, greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) AS ce FROM z)"
JOBS = views.JOB


def _logits(spark, d):
    p = views.pred(spark, d).where("scenario = 'nonspatial'")
    return p.withColumn("z", F.ln(F.col("p") / (1 - F.col("p"))))


@query("loss_bce", LOGIT + f" SELECT {JOB}, round(avg(ce), 6) AS loss FROM c GROUP BY ALL", PRED)
def loss_bce(spark, d):
    return objectives.bce(_logits(spark, d), JOBS)


@query("loss_weighted_bce", LOGIT + f" SELECT {JOB}, round(sum(ce * CASE WHEN y = 1 THEN 3 ELSE 1 END) / sum(CASE WHEN y = 1 THEN 3 ELSE 1 END), 6) AS loss FROM c GROUP BY ALL", PRED)
def loss_weighted_bce(spark, d):
    return objectives.weighted_bce(_logits(spark, d), JOBS, positive=3)


@query("loss_focal", LOGIT + f" SELECT {JOB}, round(avg(pow(1 - exp(-ce), 2) * ce), 6) AS loss FROM c GROUP BY ALL", PRED)
def loss_focal(spark, d):
    return objectives.focal(_logits(spark, d), JOBS)


@query("loss_pairwise", LOGIT + f" SELECT {JOB}, round(avg(greatest(1 - (a.z - b.z), 0)), 6) AS loss FROM (SELECT * FROM z WHERE y = 1) a FULL JOIN (SELECT * FROM z WHERE y = 0) b USING ({JOB}) GROUP BY ALL", PRED)
def loss_pairwise(spark, d):
    return objectives.pairwise_ranking(_logits(spark, d), JOBS)


@query("loss_maxent", LOGIT + f" SELECT {JOB}, round(-avg(z) FILTER (y = 1) + ln(sum(exp(z)) FILTER (y = 0)) - ln(count(*) FILTER (y = 0)), 6) + 0 AS loss FROM z GROUP BY ALL", PRED)
def loss_maxent(spark, d):
    return objectives.maxent(_logits(spark, d), JOBS)


@query("loss_poisson", LOGIT + f", n AS (SELECT *, 40 * z AS s, count(*) FILTER (y = 0) OVER (PARTITION BY {JOB}) AS nb FROM z) SELECT {JOB}, round(CASE WHEN max(nb) = 0 THEN 0 ELSE avg(CASE WHEN y = 1 THEN 1e-6 ELSE 1e-12::double / nb END * exp(greatest(least(s, 30), -30)) - y * s) END, 5) + 0 AS loss FROM n GROUP BY ALL", PRED)
def loss_poisson(spark, d):
    """Scores go beyond the clamp, on both sides."""
    t = objectives.poisson(_logits(spark, d).withColumn("z", F.col("z") * 40), JOBS, area=1e-12)
    return t.withColumn("loss", F.round("loss", 5))


@query("loss_deepmaxent", LOGIT + ", g AS (SELECT region, model_name, species_id, count(*) AS n, ln(sum(exp(s)) FILTER (y = 0)) - ln(count(*) FILTER (y = 0)) AS l, avg(s) FILTER (y = 1) AS p, avg(s * s) AS q FROM (SELECT *, greatest(least(10 * z, 30), -30) AS s FROM z) GROUP BY ALL) SELECT region, model_name, round(avg(coalesce(l - p + 0.01 * q, 0)), 5) + 0 AS loss FROM g WHERE n >= 2 GROUP BY ALL", PRED)
def loss_deepmaxent(spark, d):
    t = objectives.deep_maxent(_logits(spark, d).withColumn("z", F.col("z") * 10), ["region", "model_name"], "species_id", penalty=0.01)
    return t.withColumn("loss", F.round("loss", 5))


IMPORTANCE = """, t AS (SELECT region, ord, occ AS y, age, price, acct FROM occ WHERE part = 'test'), g AS (SELECT t.*, rep, row_number() OVER (PARTITION BY region, rep ORDER BY md5(ord::varchar), ord) AS i, row_number() OVER (PARTITION BY region, rep ORDER BY md5((32639 + rep)::varchar || '|' || ord::varchar), ord) AS j FROM t, range(0, 10) r(rep)),
e AS (SELECT region, -1 AS rep, 'base' AS feature, y, age, price, acct FROM t UNION ALL SELECT a.region, a.rep, 'time', a.y, b.age, a.price, a.acct FROM g a JOIN g b ON a.region = b.region AND a.rep = b.rep AND a.i = b.j
 UNION ALL SELECT a.region, a.rep, 'economy', a.y, a.age, b.price, b.acct FROM g a JOIN g b ON a.region = b.region AND a.rep = b.rep AND a.i = b.j),
p AS (SELECT region, rep, feature, y, 1 / (1 + exp(-(age / 500 - price / 100000 + acct / 9000))) AS s FROM e), c AS (SELECT region, rep, feature, s, sum(y) AS pos, count(*) AS n FROM p GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY region, rep, feature ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c),
auc AS (SELECT region, rep, feature, CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN (sum(pos * (b + (n + 1)::double / 2)) - sum(pos)::double * (sum(pos) + 1) / 2) / (sum(pos)::double * (sum(n) - sum(pos))) END AS a FROM b GROUP BY ALL)
SELECT auc.region, auc.feature, CASE auc.feature WHEN 'time' THEN 1 ELSE 2 END::int AS n_columns, round(avg(z.a - auc.a), 6) + 0 AS importance_mean, round(stddev_samp(z.a - auc.a), 6) + 0 AS importance_sd, round(max(z.a), 6) AS baseline_score FROM auc JOIN auc z ON z.region = auc.region AND z.rep = -1 WHERE auc.rep >= 0 GROUP BY auc.region, auc.feature"""


@query("permutation_importance", IMPORTANCE, OCC)
def permutation_importance(spark, d):
    """Ten permutations of two groups of columns, by what the area under the curve of a fixed logistic model loses."""
    t = _test(spark, d).select("region", "ord", "occ", "age", "price", "acct")
    predict = lambda x: x.withColumn("p", scalar.d(1) / (scalar.d(1) + F.exp(-(F.col("age") / 500 - F.col("price") / 100000 + F.col("acct") / 9000))))
    score = lambda x, keys: metrics.roc_auc(x, keys, "occ", "p", "score")
    return resample.permutation_importance(t, ["region"], "ord", predict, {"time": ["age"], "economy": ["price", "acct"], "none": ["soil"]}, score)


REF = ", ref AS (SELECT * FROM (VALUES ('price', 'nonspatial', 'roc_auc', 0.51::double, 226::bigint), ('acct', 'spatial', 'roc_auc', 0.2, 185), ('gam', 'nonspatial', 'roc_auc', 0.717, 226)) t(model_name, scenario, metric, published, n_species_published))"


def _reference(spark):
    return spark.createDataFrame([("price", "nonspatial", "roc_auc", 0.51, 226), ("acct", "spatial", "roc_auc", 0.2, 185), ("gam", "nonspatial", "roc_auc", 0.717, 226)], "model_name string, scenario string, metric string, published double, n_species_published long")


@query("reproduction_report", REF + """, g AS (SELECT scenario, model_name, avg(roc_auc) FILTER (status = 'OK') AS reproduced, count(DISTINCT region || '/' || species_id) FILTER (status = 'OK' AND roc_auc IS NOT NULL) AS n_species_reproduced, count(*) AS n_jobs, count(*) FILTER (status = 'OK') AS n_ok FROM results GROUP BY ALL)
SELECT scenario, model_name, metric, published, n_species_published, round(reproduced, 6) AS reproduced, n_species_reproduced, round(reproduced - published, 6) + 0 AS difference, CASE WHEN reproduced IS NULL THEN 'NOT RUN' WHEN abs(reproduced - published) <= 0.010 THEN 'MATCH' WHEN abs(reproduced - published) <= 0.025 THEN 'CLOSE' ELSE 'MISMATCH' END AS status,
CASE WHEN n_jobs IS NULL THEN 'no job' WHEN n_ok = 0 THEN 'no job succeeded' ELSE n_ok::varchar || ' of ' || n_jobs::varchar || ' jobs' END AS note FROM ref LEFT JOIN g USING (scenario, model_name)""", RESULTS)
def reproduction_report(spark, d):
    return report.reproduction(_reference(spark), views.results(spark, d))


@query("reproduction_status", REF + """, g AS (SELECT scenario, model_name, avg(roc_auc) FILTER (status = 'OK') AS v FROM results GROUP BY ALL), s AS (SELECT w.close, CASE WHEN v IS NULL THEN 'NOT RUN' WHEN abs(v - published) <= 0.010 THEN 'MATCH' WHEN abs(v - published) <= w.close THEN 'CLOSE' ELSE 'MISMATCH' END AS status FROM ref LEFT JOIN g USING (scenario, model_name), (VALUES (0.025::double), (1.0)) w(close))
SELECT close, CASE WHEN bool_and(status = 'NOT RUN') THEN 'NOT RUN' WHEN bool_or(status = 'MISMATCH') THEN 'MISMATCH' WHEN bool_or(status = 'CLOSE') THEN 'CLOSE' WHEN bool_or(status = 'MATCH') THEN 'MATCH' ELSE 'PARTIAL' END AS status FROM s GROUP BY close""", RESULTS)
def reproduction_status(spark, d):
    """By the usual band and by one that takes every row."""
    r = views.results(spark, d)
    one = lambda close: report.overall_status(report.reproduction(_reference(spark), r, close=close)).withColumn("close", F.lit(close))
    return one(0.025).unionByName(one(1.0)).select("close", "status")


@query("extra_models", REF + " SELECT DISTINCT model_name FROM results WHERE scenario = 'nonspatial' AND model_name NOT IN (SELECT model_name FROM ref WHERE scenario = 'nonspatial')", RESULTS)
def extra_models(spark, d):
    return report.extra_models(_reference(spark), views.results(spark, d))


JOBID = "'bench__' || scenario || '__' || regexp_replace(region, '[^A-Za-z0-9._-]+', '-', 'g') || '__' || species_id || '__' || model_name"


def _with_ids(df):
    return df.withColumn("job_id", scalar.job_id(F.lit("bench"), "scenario", "region", "species_id", "model_name"))


@query("pending_jobs", f", j AS (SELECT {JOBID} AS job_id, status FROM results) SELECT job_id FROM j WHERE status <> 'OK'", RESULTS)
def pending_jobs(spark, d):
    r = _with_ids(views.results(spark, d))
    return report.pending(r.select("job_id"), r, include_failed=False)


@query("job_ids", f" SELECT {JOBID} AS job_id FROM results", RESULTS)
def job_ids(spark, d):
    return _with_ids(views.results(spark, d)).select("job_id")


@query("content_hash", None)
def content_hash(spark, d):
    return report.content_hash(views.table(spark, d, "customer"))


BASE = Methodology("base", (Modality("climate"), Modality("soil"), Modality("terrain", "raster", "patch-statistics", ("1km",))))


def _plan_rows(spark, plans):
    return spark.createDataFrame([(p.name,) for p in plans], "name string")


@query("plan_information", "SELECT unnest(['all-modalities', 'only-climate', 'only-soil', 'only-terrain', 'all-minus-climate', 'all-minus-soil', 'all-minus-terrain']) AS name")
def plan_information(spark, d):
    return _plan_rows(spark, StagedPlanner(BASE).information())


@query("plan_scale", "SELECT 'base-terrain@' || s AS name FROM (SELECT unnest(['250m', '1km', '5km', '25km', '250m+1km+5km+25km']) AS s)")
def plan_scale(spark, d):
    return _plan_rows(spark, StagedPlanner(BASE).scale())


@query("plan_factorial_counts", "SELECT 'fusion' AS stage, 6::bigint AS n UNION ALL SELECT 'spatial', 5 UNION ALL SELECT 'objective', 6 UNION ALL SELECT 'model', 11")
def plan_factorial_counts(spark, d):
    t = StagedPlanner(BASE).table(spark).where("stage in ('fusion', 'spatial', 'objective', 'model')")
    return t.groupBy("stage").agg(F.count("*").alias("n"))


@query("plan_all", None)
def plan_all(spark, d):
    return StagedPlanner(BASE, 226, 2).table(spark)


@query("grid_expansion", "SELECT k, m, w FROM (SELECT unnest([3, 5, 7, 9, 15])::bigint AS k) CROSS JOIN (SELECT unnest(['euclidean', 'manhattan']) AS m) CROSS JOIN (SELECT unnest(['uniform', 'distance']) AS w)")
def grid_expansion(spark, d):
    return spark.createDataFrame([(g["k"], g["m"], g["w"]) for g in expand_grid({"k": [3, 5, 7, 9, 15], "m": ["euclidean", "manhattan"], "w": ["uniform", "distance"]})], "k long, m string, w string")


@query("validate_table", None)
def validate_table(spark, d):
    found = tasks.validate_table(views.occ(spark, d), "occ", "x", "y", [*PREDICTORS, "absent"])
    return spark.createDataFrame(found, "level string, message string")


@query("provenance_report", "SELECT verified, count(*) AS n FROM (SELECT unnest([true, true, true, true, true, true, true, true, false, false]) AS verified) GROUP BY ALL")
def provenance_report(spark, d):
    return provenance(spark).groupBy("verified").agg(F.count("*").alias("n"))


@query("benchmark_run", None)
def benchmark_run(spark, d):
    """Split, gate, recipe, audit, models, metrics and typed skips of one benchmark, over all species at once."""
    few = ["job_id", "status", "audit_status", "roc_auc", "pr_auc", "n_test", "error"]
    config = RunConfig.from_dict({"benchmark": "multi-region", "models": ["dummy", "gaussian-nb", "logistic-regression", "knn", "xgboost"], "scenarios": ["nonspatial"], "metrics": ["roc_auc", "pr_auc"]})
    return config.run(_train(spark, d), _test(spark, d), PREDICTORS).select(*few)
