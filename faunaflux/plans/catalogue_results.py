"""Queries over predictions and job results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import board, compare, metrics
from . import views
from .catalogue import query
from .views import JOB, PRED, RESULTS

K = "scenario, region, species_id, model_name"
BY_SCORE = f""", c AS (SELECT {K}, p AS s, sum(y)::double AS pos, count(*)::double AS n FROM pred GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY {K}) AS pa, sum(n) OVER (PARTITION BY {K}) AS na FROM c WINDOW w AS (PARTITION BY {K} ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
"""


@query("metric_roc_auc", f", {views.AUC} SELECT {K}, round(roc_auc, 6) AS roc_auc FROM auc", PRED)
def metric_roc_auc(spark, d):
    return metrics.roc_auc(views.pred(spark, d), JOB)


@query("metric_average_precision", BY_SCORE + f"SELECT {K}, round(CASE WHEN max(pa) > 0 AND max(pa) < max(na) THEN sum(pos / pa * tp / k) END, 6) AS average_precision FROM t GROUP BY ALL", PRED)
def metric_average_precision(spark, d):
    return metrics.average_precision(views.pred(spark, d), JOB)


@query("metric_pr_trapezoid", BY_SCORE + f""", u AS (SELECT *, tp / pa AS r, tp / k AS q FROM t), v AS (SELECT *, (r - coalesce(lag(r) OVER w, 0)) * (q + coalesce(lag(q) OVER w, 1)) / 2 AS a FROM u WINDOW w AS (PARTITION BY {K} ORDER BY s DESC))
SELECT {K}, round(CASE WHEN max(pa) > 0 AND max(pa) < max(na) THEN sum(a) END, 6) AS pr_trapezoid FROM v GROUP BY ALL""", PRED)
def metric_pr_trapezoid(spark, d):
    return metrics.pr_trapezoid(views.pred(spark, d), JOB)


@query("metric_scoring_rules", f"""SELECT {K}, round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-6), 1e-6)) ELSE ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)) END), 6) AS log_loss,
round(avg(CASE WHEN y = 1 THEN 1.0::double ELSE 0 END), 6) AS prevalence FROM pred GROUP BY ALL""", PRED)
def metric_scoring_rules(spark, d):
    return metrics.scoring_rules(views.pred(spark, d), JOB)


TSS = BY_SCORE + f""", b AS (SELECT {K}, max(pa) AS pa, max(na) AS na, max(tp / pa - (k - tp) / (na - pa)) AS tss, arg_max(s, (tp / pa - (k - tp) / (na - pa), s)) AS s FROM t GROUP BY ALL),
cut AS (SELECT {K}, CASE WHEN pa > 0 AND pa < na THEN greatest(tss, 0) END AS max_tss, CASE WHEN pa > 0 AND pa < na AND tss > 0 THEN s END AS threshold FROM b)
"""


@query("metric_max_tss", TSS + f"SELECT {K}, round(max_tss, 6) AS max_tss, round(threshold, 6) AS threshold FROM cut", PRED)
def metric_max_tss(spark, d):
    return metrics.max_tss(views.pred(spark, d), JOB)


@query("metric_sens_spec", TSS + f""", h AS (SELECT {K}, avg(CASE WHEN y = 1 THEN (p >= threshold)::int::double END) AS se, avg(CASE WHEN y = 0 THEN 1 - (p >= threshold)::int::double END) AS sp FROM pred JOIN cut USING ({K}) GROUP BY ALL)
SELECT {K}, round(CASE WHEN sp IS NOT NULL THEN se END, 6) AS sensitivity, round(CASE WHEN se IS NOT NULL THEN sp END, 6) AS specificity, round((se + sp) / 2, 6) AS balanced_accuracy FROM h""", PRED)
def metric_sens_spec(spark, d):
    return metrics.sensitivity_specificity(views.pred(spark, d), JOB)


def _boyce_sql(width: str, step: str, last: int, name: str) -> str:
    return f""", c AS (SELECT {K}, p AS s, sum(y)::double AS pos, count(*)::double AS n FROM pred GROUP BY ALL),
g AS (SELECT {K}, min(s) AS lo, max(s) AS hi, sum(pos) AS pa, sum(n) AS na FROM c GROUP BY ALL), e AS (SELECT *, {width} AS width FROM g), f AS (SELECT *, {step} AS step FROM e),
w AS (SELECT f.*, i, lo + i * step AS a, lo + i * step + width + CASE WHEN i = {last} THEN 1e-12 ELSE 0 END AS b FROM f, range(0, {last} + 1) r(i) WHERE hi > lo AND pa > 0),
j AS (SELECT {K}, i, sum(pos) / max(pa) / (sum(n) / max(na)) AS f, max(lo + i * step + width / 2) AS mid FROM w JOIN c USING ({K}) WHERE s >= a AND s <= b GROUP BY ALL),
u AS (SELECT *, lead(f) OVER (PARTITION BY {K} ORDER BY i) AS nx FROM j), v AS (SELECT * FROM u WHERE nx IS NULL OR f <> nx),
z AS (SELECT *, rank() OVER (PARTITION BY {K} ORDER BY f) + (count(*) OVER (PARTITION BY {K}, f) - 1)::double / 2 AS rf, rank() OVER (PARTITION BY {K} ORDER BY mid) + (count(*) OVER (PARTITION BY {K}, mid) - 1)::double / 2 AS rm FROM v)
SELECT {K}, round(x, 6) + 0 AS {name} FROM g LEFT JOIN (SELECT {K}, CASE WHEN count(*) > 2 THEN corr(rm, rf) END AS x FROM z GROUP BY ALL) USING ({K})"""


@query("metric_boyce", _boyce_sql("(hi - lo) / 10", "(hi - lo - width) / 100", 100, "boyce"), PRED)
def metric_boyce(spark, d):
    return metrics.continuous_boyce(views.pred(spark, d), JOB)


@query("metric_boyce_fixed_bins", _boyce_sql("(hi - lo) / 8", "width", 7, "boyce"), PRED)
def metric_boyce_fixed_bins(spark, d):
    return metrics.continuous_boyce(views.pred(spark, d), JOB, n_bins=8)


def _newton_sql(rounds: int = 12) -> str:
    sql = f""", c AS (SELECT {K}, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS z, y::double AS y FROM pred),
ok AS (SELECT {K} FROM c GROUP BY ALL HAVING count(*) >= 3 AND sum(y) > 0 AND sum(y) < count(*) AND max(z) > min(z)), b0 AS (SELECT {K}, 0::double AS a, 0::double AS b FROM ok)"""
    for i in range(rounds):
        sql += f""",
s{i} AS (SELECT {K}, any_value(a) AS a, any_value(b) AS b, sum(w) AS h00, sum(w * z) AS h01, sum(w * z * z) AS h11, sum(y - m) AS g0, sum((y - m) * z) AS g1 FROM (SELECT *, greatest(m * (1 - m), 1e-12) AS w FROM (SELECT *, 1 / (1 + exp(-(a + b * z))) AS m FROM c JOIN b{i} USING ({K}))) GROUP BY ALL),
b{i + 1} AS (SELECT {K}, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s{i})"""
    return sql + f"\nSELECT {K}, round(a, 6) + 0 AS calibration_intercept, round(b, 6) + 0 AS calibration_slope FROM (SELECT DISTINCT {K} FROM pred) LEFT JOIN b{rounds} USING ({K})"


@query("metric_calibration_slope", _newton_sql(), PRED)
def metric_calibration_slope(spark, d):
    return metrics.miller_calibration(views.pred(spark, d), JOB)


@query("compute_metrics", None)
def compute_metrics(spark, d):
    return metrics.compute_metrics(views.pred(spark, d), JOB, metrics.METRICS)


BOARD = """SELECT model_name, count(DISTINCT CASE WHEN ok THEN region || '/' || species_id END) AS n_species, count(DISTINCT CASE WHEN ok THEN region END) AS n_regions, count(*) AS n_jobs, count(*) FILTER (ok) AS n_ok,
count(*) FILTER (status = 'FAILED') AS n_failed, count(*) FILTER (status LIKE 'SKIPPED%') AS n_skipped, avg(roc_auc) FILTER (ok) AS roc_auc_mean, quantile_cont(roc_auc, 0.5) FILTER (ok) AS roc_auc_median, stddev_samp(roc_auc) FILTER (ok) AS roc_auc_sd,
avg(runtime) FILTER (ok) AS runtime_mean, quantile_cont(runtime, 0.5) FILTER (ok) AS runtime_median, stddev_samp(runtime) FILTER (ok) AS runtime_sd FROM (SELECT *, status = 'OK' AS ok FROM results {where}) GROUP BY ALL"""
AUC_COLS = "model_name, n_species, n_regions, n_jobs, n_ok, n_failed, n_skipped, round(roc_auc_mean, 6) AS roc_auc_mean, round(roc_auc_median, 6) AS roc_auc_median, round(roc_auc_sd, 6) AS roc_auc_sd"
TIME_COLS = ", round(runtime_mean, 6) AS runtime_mean, round(runtime_median, 6) AS runtime_median, round(runtime_sd, 6) AS runtime_sd"
NONSPATIAL = "WHERE scenario = 'nonspatial'"


@query("leaderboard_roc_auc", f", b AS ({BOARD.format(where=NONSPATIAL)}) SELECT {AUC_COLS}, row_number() OVER (ORDER BY -roc_auc_mean NULLS LAST, model_name)::int AS rank FROM b", RESULTS)
def leaderboard_roc_auc(spark, d):
    return board.leaderboard(views.results(spark, d), "roc_auc", "nonspatial")


@query("board_by_runtime", f", b AS ({BOARD.format(where='')}) SELECT {AUC_COLS}{TIME_COLS}, row_number() OVER (ORDER BY runtime_mean NULLS LAST, model_name)::int AS rank FROM b", RESULTS)
def board_by_runtime(spark, d):
    return board.leaderboard(views.results(spark, d), "roc_auc", None, ("runtime",), sort_by="runtime")


@query("board_by_calibration", _newton_sql().rsplit("\nSELECT", 1)[0] + f", m AS (SELECT model_name, avg(b) AS mean, count(b) AS n FROM (SELECT DISTINCT {K} FROM pred) LEFT JOIN b12 USING ({K}) GROUP BY ALL) SELECT model_name, n, round(mean, 6) AS calibration_slope_mean, row_number() OVER (ORDER BY abs(mean - 1) NULLS LAST, model_name)::int AS rank FROM m", PRED)
def board_by_calibration(spark, d):
    slopes = metrics.miller_calibration(views.pred(spark, d), JOB)
    means = slopes.groupBy("model_name").agg(F.count("calibration_slope").alias("n"), F.avg("calibration_slope").alias("calibration_slope_mean"))
    return board.ranked(means, board.direction_key(F.col("calibration_slope_mean"), "calibration_slope"))


@query("summarise_metric", "SELECT model_name, scenario, count(roc_auc) AS n, round(avg(roc_auc), 6) AS mean, round(quantile_cont(roc_auc, 0.5), 6) AS median, round(stddev_samp(roc_auc), 6) AS sd, round(stddev_samp(roc_auc) / sqrt(count(roc_auc)), 6) AS se FROM results GROUP BY ALL", RESULTS)
def summarise_metric(spark, d):
    return board.summarise(views.results(spark, d), ["model_name", "scenario"], "roc_auc").drop("ci_low", "ci_high")


@query("summarise_interval", None)
def summarise_interval(spark, d):
    return board.summarise(views.results(spark, d), ["model_name", "scenario"], "roc_auc")


@query("per_species_pivot", "SELECT region, species_id, round(avg(roc_auc) FILTER (model_name = 'acct'), 6) AS acct, round(avg(roc_auc) FILTER (model_name = 'mod97'), 6) AS mod97, round(avg(roc_auc) FILTER (model_name = 'price'), 6) AS price FROM results WHERE status = 'OK' GROUP BY ALL", RESULTS)
def per_species_pivot(spark, d):
    return board.per_species(views.results(spark, d), models=["acct", "mod97", "price"])


MEANS = ", m AS (SELECT region, species_id, model_name, avg(roc_auc) AS v FROM results WHERE status = 'OK' AND scenario = 'nonspatial' AND roc_auc IS NOT NULL GROUP BY ALL)"


@query("common_species_board", MEANS + """, k AS (SELECT region, species_id FROM m GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT model_name) FROM m)), s AS (SELECT model_name, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS sd FROM m JOIN k USING (region, species_id) GROUP BY ALL)
SELECT model_name, n, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, row_number() OVER (ORDER BY -mean, model_name)::int AS rank FROM s""", RESULTS)
def common_species_board(spark, d):
    return board.common_species(views.results(spark, d), scenario="nonspatial").select("model_name", "n", "mean", "median", "sd", "rank")


@query("coverage_report", """SELECT model_name, scenario, count(*) FILTER (status = 'OK') AS "OK", count(*) FILTER (status = 'FAILED') AS "FAILED", count(*) FILTER (status = 'SKIPPED_DATA') AS "SKIPPED_DATA", count(*) FILTER (status = 'SKIPPED_DEPENDENCY') AS "SKIPPED_DEPENDENCY" FROM results GROUP BY ALL""", RESULTS)
def coverage_report(spark, d):
    return board.coverage(views.results(spark, d))


@query("status_counts", "SELECT status, count(*) AS n FROM results GROUP BY ALL", RESULTS)
def status_counts(spark, d):
    return board.status_counts(views.results(spark, d))


@query("metric_distribution", """, q AS (SELECT model_name, count(roc_auc) AS n, quantile_cont(roc_auc, 0.25) AS q1, quantile_cont(roc_auc, 0.5) AS median, quantile_cont(roc_auc, 0.75) AS q3 FROM results WHERE status = 'OK' GROUP BY ALL)
SELECT model_name, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, row_number() OVER (ORDER BY median, model_name)::int AS place FROM q""", RESULTS)
def metric_distribution(spark, d):
    return board.metric_distribution(views.results(spark, d))


@query("pareto_front", f", b AS ({BOARD.format(where='')}) SELECT model_name, round(roc_auc_mean, 6) AS roc_auc_mean, round(runtime_mean, 6) AS runtime_mean FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.runtime_mean < b.runtime_mean AND o.roc_auc_mean > b.roc_auc_mean)", RESULTS)
def pareto_front(spark, d):
    b = board.leaderboard(views.results(spark, d), "roc_auc", None, ("runtime",)).select("model_name", "roc_auc_mean", "runtime_mean")
    return board.pareto_front(b, "roc_auc_mean", "runtime_mean")


#: Results under names of ablation variants.
VARIANTS = {"price": "full", "acct": "full-minus-soil", "mod97": "only-climate"}
SCALES = {"price": "full-terrain@1km", "acct": "full-terrain@5km", "mod97": "full-terrain@1km"}


def _renamed(df, names):
    return df.withColumn("model_name", F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[F.col("model_name")])


def _renamed_sql(names):
    return "CASE model_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


@query("modality_ablation", f""", m AS (SELECT region, species_id, {_renamed_sql(VARIANTS)} AS name, avg(roc_auc) AS v FROM results WHERE status = 'OK' AND roc_auc IS NOT NULL GROUP BY ALL),
j AS (SELECT CASE WHEN m.name LIKE '%-minus-%' THEN 'leave_one_out' ELSE 'alone' END AS ablation, CASE WHEN m.name LIKE '%-minus-%' THEN regexp_extract(m.name, '-minus-(.+)$', 1) ELSE regexp_extract(m.name, 'only-(.+)$', 1) END AS modality, b.v AS base, m.v AS v FROM m JOIN m b USING (region, species_id) WHERE b.name = 'full' AND m.name <> 'full')
SELECT ablation, modality, round(avg(base), 6) AS baseline_mean, round(avg(v), 6) AS variant_mean, round(avg(v - base), 6) AS mean_difference, round(stddev_samp(v - base), 6) AS sd_difference, count(*) AS n, count(*) FILTER (v > base) AS wins, count(*) FILTER (v < base) AS losses FROM j GROUP BY ALL""", RESULTS)
def modality_ablation(spark, d):
    return board.modality_ablation(_renamed(views.results(spark, d), VARIANTS), "full")


@query("scale_ablation", f""", m AS (SELECT region, species_id, {_renamed_sql(SCALES)} AS name, avg(roc_auc) AS v FROM results WHERE status = 'OK' AND roc_auc IS NOT NULL GROUP BY ALL)
SELECT split_part(name, '@', 2) AS scale, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(*)), 6) AS se FROM m GROUP BY ALL""", RESULTS)
def scale_ablation(spark, d):
    return board.scale_ablation(_renamed(views.results(spark, d), SCALES), "terrain").drop("ci_low", "ci_high")


PAIRS = MEANS + ", p AS (SELECT a.model_name AS model_a, b.model_name AS model_b, region, species_id, a.v AS a, b.v AS b, a.v - b.v AS diff FROM m a JOIN m b USING (region, species_id) WHERE a.model_name < b.model_name)"
PAIR_SQL = """SELECT model_a, model_b, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(diff), 6) + 0 AS mean_difference, round(quantile_cont(diff, 0.5), 6) + 0 AS median_difference, round(stddev_samp(diff), 6) AS sd_difference,
round(CASE WHEN stddev_samp(diff) > 0 THEN avg(diff) / stddev_samp(diff) END, 6) + 0 AS cohen_dz, count(*) FILTER (diff > {tol}) AS wins, count(*) FILTER (diff < -{tol}) AS losses, count(*) FILTER (abs(diff) <= {tol}) AS ties FROM {p} GROUP BY ALL"""


@query("compare_all_pairs", PAIRS + PAIR_SQL.format(tol="0", p="p"), RESULTS)
def compare_all_pairs(spark, d):
    return compare.paired_summary(compare.paired(views.results(spark, d), scenario="nonspatial"))


@query("compare_pair", PAIRS + PAIR_SQL.format(tol="0", p="(SELECT * FROM p WHERE model_a = 'acct' AND model_b = 'price')"), RESULTS)
def compare_pair(spark, d):
    r = views.results(spark, d).where("model_name in ('acct', 'price')")
    return compare.paired_summary(compare.paired(r, scenario="nonspatial"))


@query("win_tie_loss", PAIRS + "SELECT model_a, model_b, count(*) FILTER (diff > 0.02) AS wins, count(*) FILTER (abs(diff) <= 0.02) AS ties, count(*) FILTER (diff < -0.02) AS losses FROM p GROUP BY ALL", RESULTS)
def win_tie_loss(spark, d):
    return compare.paired_summary(compare.paired(views.results(spark, d), scenario="nonspatial"), 0.02).select("model_a", "model_b", "wins", "ties", "losses")


@query("compare_reference", MEANS + ", p AS (SELECT a.model_name AS model_a, b.model_name AS model_b, a.v AS a, b.v AS b, a.v - b.v AS diff FROM m a JOIN m b USING (region, species_id) WHERE a.model_name <> b.model_name AND b.model_name = 'price') " + PAIR_SQL.format(tol="0", p="p"), RESULTS)
def compare_reference(spark, d):
    return compare.paired_summary(compare.paired(views.results(spark, d), scenario="nonspatial", reference="price"))


@query("wilcoxon_w", PAIRS + """, z AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(diff)) - 1)::double / 2 AS r FROM p WHERE diff <> 0)
SELECT model_a, model_b, count(*) AS n_nonzero, round(least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0)), 6) AS wilcoxon_w FROM z GROUP BY ALL""", RESULTS)
def wilcoxon_w(spark, d):
    return compare.wilcoxon_w(compare.paired(views.results(spark, d), scenario="nonspatial"))


@query("bootstrap_ci", PAIRS + """, o AS (SELECT *, row_number() OVER (PARTITION BY model_a, model_b ORDER BY region, species_id) - 1 AS i, count(*) OVER (PARTITION BY model_a, model_b) AS n FROM p),
g AS (SELECT DISTINCT model_a, model_b, n FROM o), k AS (SELECT model_a, model_b, n, rep, ('0x' || substr(md5('32639|' || rep || '|' || j), 1, 8))::bigint % n AS i FROM g, range(1, 10001) r(rep), range(0, n) s(j)),
s AS (SELECT model_a, model_b, any_value(k.n) AS n, rep, avg(diff) AS v FROM k JOIN o USING (model_a, model_b, i) GROUP BY model_a, model_b, rep)
SELECT model_a, model_b, max(n) AS n, round(quantile_cont(v, 0.025), 6) + 0 AS ci_low, round(quantile_cont(v, 0.975), 6) + 0 AS ci_high FROM s GROUP BY ALL""", RESULTS)
def bootstrap_ci(spark, d):
    return compare.bootstrap_ci(compare.paired(views.results(spark, d), scenario="nonspatial"), compare.PAIR, "diff", ["region", "species_id"])


@query("p_values", None)
def p_values(spark, d):
    return compare.p_values(compare.paired(views.results(spark, d), scenario="nonspatial"))


@query("compare_models", None)
def compare_models(spark, d):
    return compare.compare_models(views.results(spark, d), scenario="nonspatial")


P_SQL = ", q AS (SELECT region AS model_a, species_id AS model_b, CASE WHEN region <> 'ASIA' THEN avg(roc_auc) / 10 END AS p FROM results WHERE status = 'OK' AND scenario = 'nonspatial' GROUP BY region, species_id)"


def _some_p(spark, d):
    r = board.successful(board.in_scenario(views.results(spark, d), "nonspatial"))
    return r.groupBy(F.col("region").alias("model_a"), F.col("species_id").alias("model_b")).agg(F.when(F.col("region") != "ASIA", F.avg("roc_auc") / 10).alias("p"))


@query("holm_adjust", P_SQL + ", o AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, model_a, model_b) AS rn, count(p) OVER () AS n FROM q) SELECT model_a, model_b, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1, max((n - rn + 1) * p) OVER (ORDER BY rn)) END, 6) AS p_adjusted FROM o", RESULTS)
def holm_adjust(spark, d):
    return compare.adjust(_some_p(spark, d), "p")


@query("bonferroni_adjust", P_SQL + " SELECT model_a, model_b, round(p, 6) AS p, round(least(1, p * count(p) OVER ()), 6) AS p_adjusted FROM q", RESULTS)
def bonferroni_adjust(spark, d):
    return compare.adjust(_some_p(spark, d), "p", "bonferroni")


@query("verdict", PAIRS + ", s AS (SELECT model_a, model_b, count(*) AS n, avg(diff) AS m, min(diff) AS lo, max(diff) AS hi FROM p GROUP BY ALL) SELECT model_a, model_b, CASE WHEN n < 3 THEN 'INSUFFICIENT_DATA' WHEN NOT (lo > 0 OR hi < 0) THEN 'NO_RELIABLE_DIFFERENCE' WHEN m > 0 THEN model_a || '_BETTER' ELSE model_b || '_BETTER' END AS verdict FROM s", RESULTS)
def verdict(spark, d):
    t = compare.paired(views.results(spark, d), scenario="nonspatial").groupBy(*compare.PAIR).agg(F.count("*").alias("n"), F.avg("diff").alias("m"), F.min("diff").alias("lo"), F.max("diff").alias("hi"))
    return t.select(*compare.PAIR, compare.verdict("n", "lo", "hi", F.lit(0.01), "m").alias("verdict"))
