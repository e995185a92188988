"""Registered queries of summary tables at every level."""

from __future__ import annotations

from pyspark.sql import functions as F

from repselect.operators import levels as V, summaries as G
from repselect.plans.queries import CASE, curves, query, r, scores
from repselect.plans.queries_tables import CANDIDATE, COSTS, CURVE_CORR, CURVE_JOIN, CURVE_RANK, DEPTH, bandwidth_corr, sql

BANDWIDTH = (CURVE_JOIN, CURVE_RANK, CURVE_CORR, """ts AS (SELECT task_type, task, seed, k, avg(spearman) AS v, count(DISTINCT model_alias) AS n_models
    FROM cc GROUP BY task_type, task, seed, k),
  fs AS (SELECT task_type, seed, k, avg(v) AS v, count(DISTINCT task) AS n_tasks FROM ts GROUP BY task_type, seed, k),
  os AS (SELECT seed, k, avg(v) AS v FROM ts GROUP BY seed, k)""")
OVER = r("avg(v) AS mean", "var_samp(v) AS seed_variance", digits=6) + ", count(DISTINCT seed) AS n_seeds"


def tables(spark, sf_dir):
    return V.bandwidth_tables(bandwidth_corr(spark, sf_dir))


@query(sql(f"SELECT task_type, task, seed, k, {r('v', digits=6)}, n_models FROM ts", "curves_long", "scores_long", ctes=BANDWIDTH), digits=6)
def g13_task_seed(spark, sf_dir):
    return tables(spark, sf_dir)["task_seed"]


@query(sql(f"SELECT task_type, seed, k, {r('v', digits=6)}, n_tasks FROM fs", "curves_long", "scores_long", ctes=BANDWIDTH), digits=6)
def g13_family_seed(spark, sf_dir):
    return tables(spark, sf_dir)["family_seed"]


@query(sql(f"SELECT task_type, task, k, {OVER} FROM ts GROUP BY task_type, task, k", "curves_long", "scores_long", ctes=BANDWIDTH), digits=6)
def g13_task_curve(spark, sf_dir):
    return tables(spark, sf_dir)["task_curve"]


@query(sql(f"SELECT k, {OVER} FROM os GROUP BY k", "curves_long", "scores_long", ctes=BANDWIDTH), digits=6)
def g13_overall_curve(spark, sf_dir):
    return tables(spark, sf_dir)["overall_curve"]


MODE_CTES = """shares AS (SELECT model_alias, task, task_type, layer, k, mass, energy / sum(energy) OVER (PARTITION BY model_alias, task, layer) AS p FROM curves_long),
  centred AS (SELECT *, sum(k * p) OVER (PARTITION BY model_alias, task, layer) AS mu FROM shares),
  modes AS (SELECT model_alias, task, max(task_type) AS task_type, layer, max(mu) AS mean_mode, sqrt(sum(p * (k - mu) ** 2)) AS spread,
    min(k) FILTER (mass >= 0.9) AS k90, min(k) FILTER (mass >= 0.95) AS k95 FROM centred GROUP BY model_alias, task, layer),
  placed_modes AS (SELECT * FROM modes JOIN cdepth USING (model_alias, task, layer))"""
#: Depth of the candidates that have a curve.
MODES = (DEPTH.replace("depth AS", "cdepth AS", 1).replace("FROM scores_long", "FROM curves_long"), MODE_CTES)


def depth_sql(by: str) -> str:
    return f"""(SELECT task_type, {by}, avg(mean_mode) AS mean_mode, avg(spread) AS spread, count(*) AS n_tasks FROM (
    SELECT task_type, task, {by}, avg(mean_mode) AS mean_mode, avg(spread) AS spread FROM placed_modes GROUP BY ALL) GROUP BY task_type, {by})"""


def deep_curves(spark, sf_dir):
    return V.depth_candidates(curves(spark, sf_dir), CASE)


@query(sql(f"SELECT task_type, depth_bin, n_tasks, {r('mean_mode', 'spread', digits=8)} FROM {depth_sql('depth_bin')}", "curves_long", ctes=MODES), digits=8)
def g14_family_depth(spark, sf_dir):
    return V.depth_levels(deep_curves(spark, sf_dir), "depth_bin")


@query(sql(f"SELECT task_type, region, n_tasks, {r('mean_mode', 'spread', digits=8)} FROM {depth_sql('region')}", "curves_long", ctes=MODES), digits=8)
def g14_family_region(spark, sf_dir):
    return V.depth_levels(deep_curves(spark, sf_dir), "region")


@query(sql(f"""SELECT task_type, depth_bin, k, count(*) AS n_tasks, {r('avg(share) AS share', digits=8)} FROM (
  SELECT s.task_type, s.task, depth_bin, k, avg(p) AS share FROM shares s JOIN cdepth USING (model_alias, task, layer) GROUP BY ALL) GROUP BY task_type, depth_bin, k""",
           "curves_long", ctes=MODES), digits=8)
def g14_heat_by_k(spark, sf_dir):
    return V.depth_heat(curves(spark, sf_dir), deep_curves(spark, sf_dir), CASE)


REGIONS = ", ".join(f"max({c}) FILTER (region = '{x}') AS {x.lower()}_{c}" for x in ("Early", "Middle", "Late") for c in ("mean_mode", "spread"))
WIDE = [f"{x}_{c}" for x in ("early", "middle", "late") for c in ("mean_mode", "spread")]


@query(sql(f"""SELECT task_type, n_tasks, n_candidates, {r(*WIDE, 'k90_availability', 'k95_availability', 'median_k90', 'median_k95', digits=8)} FROM (
    SELECT task_type, {REGIONS} FROM {depth_sql('region')} GROUP BY task_type) JOIN (
    SELECT task_type, count(DISTINCT task) AS n_tasks, count(*) AS n_candidates, avg((k90 IS NOT NULL)::INT) AS k90_availability, median(k90) AS median_k90,
      avg((k95 IS NOT NULL)::INT) AS k95_availability, median(k95) AS median_k95 FROM placed_modes GROUP BY task_type) USING (task_type)""",
           "curves_long", ctes=MODES), digits=8)
def g15_depth_summary(spark, sf_dir):
    return V.depth_summary(deep_curves(spark, sf_dir))


@query(sql(f"""SELECT n_candidates, {r('cumulative_share', 'per_mode_share')},
  CASE WHEN cumulative_share >= 0.95 THEN 'cumulative' WHEN per_mode_share >= 0.95 THEN 'per_mode' ELSE 'unavailable' END AS semantics FROM (
  SELECT count(*) AS n_candidates, avg((lo >= -1e-8 AND hi <= 1.0001 AND NOT falls AND last >= 0.8)::INT) AS cumulative_share,
    avg((lo >= -1e-8 AND hi <= 1.0001 AND total BETWEEN 0.9 AND 1.1)::INT) AS per_mode_share FROM (
    SELECT min(mass) AS lo, max(mass) AS hi, sum(mass) AS total, max_by(mass, k) AS last, coalesce(bool_or(d < -1e-8), false) AS falls FROM (
      SELECT model_alias, task, layer, k, mass, mass - lag(mass) OVER (PARTITION BY model_alias, task, layer ORDER BY k) AS d FROM curves_long)
    GROUP BY model_alias, task, layer))""", "curves_long"))
def h19_mass_verdict(spark, sf_dir):
    return V.mass_verdict(curves(spark, sf_dir), CANDIDATE)


@query(sql(f"""SELECT n_candidates, {r('cumulative_share', 'per_mode_share')},
  CASE WHEN cumulative_share >= 0.95 THEN 'cumulative' WHEN per_mode_share >= 0.95 THEN 'per_mode' ELSE 'unavailable' END AS semantics FROM (
  SELECT count(*) AS n_candidates, avg((lo >= -1e-8 AND hi <= 1.0001 AND NOT falls AND last >= 0.8)::INT) AS cumulative_share,
    avg((lo >= -1e-8 AND hi <= 1.0001 AND total BETWEEN 0.9 AND 1.1)::INT) AS per_mode_share FROM (
    SELECT min(p) AS lo, max(p) AS hi, sum(p) AS total, max_by(p, k) AS last, coalesce(bool_or(d < -1e-8), false) AS falls FROM (
      SELECT model_alias, task, layer, k, p, p - lag(p) OVER (PARTITION BY model_alias, task, layer ORDER BY k) AS d FROM shares)
    GROUP BY model_alias, task, layer))""", "curves_long", ctes=MODES))
def h19_mass_verdict_per_mode(spark, sf_dir):
    c = curves(spark, sf_dir)
    total = c.groupBy(*CANDIDATE).agg(F.sum("energy").alias("e"))
    return V.mass_verdict(c.join(total, CANDIDATE).withColumn("mass", F.col("energy") / F.col("e")), CANDIDATE)


FIXED = 10
ELIGIBLE = f"""eligible AS (SELECT model_alias, task FROM curves_long WHERE k = {FIXED} GROUP BY ALL HAVING count(DISTINCT layer) >= 3),
  cutoffs AS (SELECT DISTINCT k AS cutoff FROM curves_long),
  held AS (SELECT cutoff, model_alias, task, count(*) AS n_layers FROM (SELECT c.cutoff, l.model_alias, l.task, l.layer
    FROM cutoffs c JOIN curves_long l ON l.k <= c.cutoff GROUP BY ALL HAVING count(DISTINCT l.k) = c.cutoff) GROUP BY ALL HAVING count(*) >= 3)"""


@query(sql(f"""SELECT cutoff, n_cases, n_tasks, {r('n_cases / (SELECT count(*) FROM eligible) AS case_retention',
  'n_tasks / (SELECT count(DISTINCT task) FROM eligible) AS task_retention')} FROM (
  SELECT cutoff, count(h.task) AS n_cases, count(DISTINCT h.task) AS n_tasks FROM cutoffs LEFT JOIN held h USING (cutoff) GROUP BY cutoff)""",
           "curves_long", ctes=(ELIGIBLE,)))
def h25_support_retention(spark, sf_dir):
    return V.support_retention(curves(spark, sf_dir), CASE, FIXED)


@query(sql("""SELECT (SELECT max(k) FROM curves_long) AS largest_k, (SELECT count(DISTINCT k) FROM curves_long) AS n_k,
  (SELECT count(*) FROM eligible) AS eligible_cases, (SELECT count(DISTINCT task) FROM eligible) AS eligible_tasks,
  count(*) AS retained_cases, count(DISTINCT task) AS retained_tasks, min(n_layers) AS least_layers, max(n_layers) AS most_layers
  FROM held WHERE cutoff = (SELECT max(k) FROM curves_long)""", "curves_long", ctes=(ELIGIBLE,)))
def h25_support_summary(spark, sf_dir):
    return V.support_summary(curves(spark, sf_dir), CASE, FIXED)


@query(sql(f"""SELECT count(*) AS n_tasks, sum(n)::BIGINT AS n_candidates, {r('sum(e) AS exhaustive_s', 'sum(s) AS screening_s', 'sum(l) AS shortlist_s',
  'sum(s + l) AS hybrid_s', 'sum(e) / sum(s + l) AS speedup', digits=8)}, count(*) FILTER (s + l <= e) AS n_break_even FROM (
  SELECT task, count(*) AS n, sum(eval_s)::DOUBLE AS e, sum(screen_s)::DOUBLE AS s, sum(eval_s) FILTER (rn <= 5)::DOUBLE AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(score, 12) DESC, candidate) AS rn FROM costs) GROUP BY task)""",
           "scores_long", ctes=(COSTS,)), digits=8)
def g18_runtime_totals(spark, sf_dir):
    c = scores(spark, sf_dir).groupBy(*CANDIDATE).agg(F.round(F.avg("primary_score"), 12).alias("score"), F.count("*").alias("c"))
    costs = c.select("task", F.concat_ws("::L", "model_alias", "layer").alias("candidate"), "score", (F.lit(0.01) * F.col("layer")).alias("screen_s"), (F.lit(0.1) * F.col("c")).alias("eval_s"))
    return V.runtime_totals(G.runtime_accounting(costs))
