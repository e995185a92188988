"""Registered queries of a study's inputs, summaries, controls and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from repselect.functions.scalars import rounded
from repselect.operators import ranking as H, sampling as C, statistics as I, study as K, vectors as D
from repselect.plans.queries import CASE, T, T_FAR, U, V, curves, items, metrics, query, r, rank_sql, reps, scores
from repselect.plans.queries_tables import CANDIDATE, DEPTH, DIFF, JOINED, PLACED, _metric_sql, candidates, deep, diffs, sql

# inputs


@query(sql("SELECT model_alias, task, layer, raw_value AS target_value FROM metrics_long WHERE feature = 'harmonic' AND layer % 3 = 0", "metrics_long"))
def b12_unique_targets(spark, sf_dir):
    regime = F.when(F.col("layer") % 3 == 0, "all").otherwise("near")
    m = metrics(spark, sf_dir).select(*CANDIDATE, F.lit("metric").alias("target_source"), F.col("feature").alias("target_name"), F.col("raw_value").alias("target_value"), regime.alias("gap_regime"))
    return K.unique_targets(m.unionByName(m), CANDIDATE, "metric", "harmonic")


@query(sql(f"SELECT model_alias, task, layer, k, {r('energy + 0.5::DOUBLE AS energy')}, mass FROM curves_long", "curves_long"))
def b13_collapse(spark, sf_dir):
    c = curves(spark, sf_dir).select(*CANDIDATE, "k", "energy", "mass")
    twice = c.unionByName(c.withColumn("energy", F.col("energy") + 1).withColumn("mass", F.col("mass") - 1))
    return K.collapse(twice, [*CANDIDATE, "k"], ["energy"], ["mass"], energy="energy")


CACHE = f"""cached AS (SELECT task, count(*) FILTER (source IS NOT NULL AND label IS NOT NULL) AS n_items, count(DISTINCT label) FILTER (source IS NOT NULL) AS n_classes FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY {U.format('7, item_id')}, item_id) AS p FROM items) WHERE p <= 40 GROUP BY task)"""


def cached(spark, sf_dir):
    return K.task_cache(C.uniform_cap(items(spark, sf_dir), ["task"], 40, 7), ["task"], "source", "label")


@query(sql("SELECT *, CASE WHEN n_items < 10 OR n_classes < 2 THEN 'warning' ELSE 'ok' END AS status FROM cached", "items", ctes=(CACHE,)))
def c3_task_cache(spark, sf_dir):
    return cached(spark, sf_dir)


@query(sql("SELECT task, n_items > 0 AND NOT (n_items < 10 OR n_classes < 2) AS usable FROM cached", "items", ctes=(CACHE,)))
def j2_sample_status(spark, sf_dir):
    return cached(spark, sf_dir).select("task", ((F.col("n_items") > 0) & (F.col("status") == "ok")).alias("usable"))


@query(sql(f"SELECT task, source, item_id FROM (SELECT *, row_number() OVER (PARTITION BY task, source ORDER BY {U.format('123, item_id')}, item_id) AS p FROM items) WHERE p <= 192", "items"))
def c6_deterministic_cohort(spark, sf_dir):
    return C.uniform_cap(items(spark, sf_dir), ["task", "source"], 192, 123).select("task", "source", "item_id")


@query(f"""{V} SELECT model_alias, layer, item_id, {r("sum(abs(x - m)) AS spread", digits=6)} FROM (SELECT *, avg(x) OVER (PARTITION BY model_alias, layer, d) AS m FROM long) GROUP BY ALL""", digits=6)
def d1_center(spark, sf_dir):
    z = D.standardize(reps(spark, sf_dir), scale=False)
    return z.select("model_alias", "layer", "item_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("spread"))


# joins


@query(sql(f"SELECT s.model_alias, s.task, s.layer, s.seed, primary_score, {r('top AS top_energy')} FROM scores_long s JOIN (SELECT model_alias, task, layer, max(energy) AS top FROM curves_long GROUP BY ALL) c ON s.model_alias = c.model_alias AND s.task = c.task AND s.layer = c.layer", "scores_long", "curves_long"))
def f3_matched_join(spark, sf_dir):
    left = scores(spark, sf_dir).withColumn("sample_hash", F.md5("task"))
    right = curves(spark, sf_dir).groupBy(*CANDIDATE).agg(F.max("energy").alias("top_energy")).withColumn("sample_hash", F.md5("task"))
    return K.matched_join(left, right, CANDIDATE).select(*CANDIDATE, "seed", "primary_score", "top_energy")


@query(sql(f"SELECT model_alias, task, layer, k, {r('energy / sum(energy) OVER (PARTITION BY model_alias, task, layer) AS share')} FROM curves_long", "curves_long"))
def f5_share_of_total(spark, sf_dir):
    return K.share_of_total(curves(spark, sf_dir), CANDIDATE, "energy").select(*CANDIDATE, "k", "share")


# summaries

MEASURES = ["ndcg_at_3", "regret_at_1"]
RANKED = f"detail AS (SELECT task, seed, feature, {_metric_sql()} FROM placed GROUP BY ALL)"


def detail(spark, sf_dir):
    return H.ranking_metrics(candidates(spark, sf_dir), ["task", "seed", "feature"], "x", "y", "candidate")


def _interval(m: str) -> str:
    sem = f"sqrt(v) / sqrt(n_tasks_{m})"
    half = f"coalesce({T}[n_tasks_{m} - 1] * {sem}, CASE WHEN n_tasks_{m} > 1 THEN {T_FAR.format(n='n_tasks_' + m)} * {sem} ELSE 0 END)"
    return f"SELECT feature, n_tasks_{m}, {r(f'm AS mean_{m}', f'sqrt(v) AS std_{m}', f'v AS variance_{m}', f'm - {half} AS ci_low_{m}', f'm + {half} AS ci_high_{m}', f's AS mean_seed_std_{m}', digits=7)} FROM (SELECT feature, count(m) AS n_tasks_{m}, avg(m) AS m, coalesce(var_samp(m), 0) AS v, avg(s) AS s FROM (SELECT feature, task, avg({m}) AS m, coalesce(stddev_samp({m}), 0) AS s FROM detail GROUP BY ALL) GROUP BY feature)"


@query(sql(f"SELECT * FROM ({_interval(MEASURES[0])}) JOIN ({_interval(MEASURES[1])}) USING (feature)", "metrics_long", "scores_long", ctes=(JOINED, PLACED, RANKED)), digits=7)
def g10_seed_then_task(spark, sf_dir):
    return K.seed_then_task(detail(spark, sf_dir), ["feature"], MEASURES)


BY_SEED = """methods AS (SELECT feature, avg(a) AS ndcg_at_3_mean, coalesce(var_samp(a), 0) AS ndcg_at_3_variance, avg(b) AS regret_at_1_mean, coalesce(var_samp(b), 0) AS regret_at_1_variance FROM (
  SELECT feature, seed, avg(ndcg_at_3) AS a, avg(regret_at_1) AS b FROM detail GROUP BY ALL) GROUP BY feature)"""


@query(sql(f"""SELECT feature, {r('ndcg_at_3_mean', 'ndcg_at_3_variance', 'regret_at_1_mean', 'regret_at_1_variance', digits=7)}, row_number() OVER (ORDER BY round(ndcg_at_3_mean, 12) DESC, feature)::INT AS place,
  max(ndcg_at_3_mean) OVER () - ndcg_at_3_mean <= 1e-12 AS ndcg_at_3_best, regret_at_1_mean - min(regret_at_1_mean) OVER () <= 1e-12 AS regret_at_1_best FROM methods""", "metrics_long", "scores_long", ctes=(JOINED, PLACED, RANKED, BY_SEED)), digits=7)
def g12_seed_summary_ranked(spark, sf_dir):
    return K.seed_summary_ranked(detail(spark, sf_dir), "feature", MEASURES, "ndcg_at_3", ["regret_at_1"])


@query(sql(f"SELECT feature, place, best_ndcg FROM (SELECT feature, row_number() OVER (ORDER BY round(ndcg_at_3_mean, 12) DESC, feature)::INT AS place, max(ndcg_at_3_mean) OVER () - ndcg_at_3_mean <= 1e-12 AS best_ndcg FROM methods)", "metrics_long", "scores_long", ctes=(JOINED, PLACED, RANKED, BY_SEED)))
def h27_overall_ranks(spark, sf_dir):
    return K.seed_summary_ranked(detail(spark, sf_dir), "feature", ["ndcg_at_3"], "ndcg_at_3").select("feature", "place", F.col("ndcg_at_3_best").alias("best_ndcg"))


TRIALS = "trials AS (SELECT model_alias, task, feature AS method, x AS gain, abs(y - x) AS gap FROM joined)"
MACRO = "macro AS (SELECT method, count(*) AS n_tasks, avg(gain) AS mean_gain, median(gain) AS median_gain, avg(gap) AS mean_gap, median(gap) AS median_gap FROM (SELECT method, task, avg(gain) AS gain, avg(gap) AS gap FROM (SELECT method, task, model_alias, avg(gain) AS gain, avg(gap) AS gap FROM trials GROUP BY ALL) GROUP BY ALL) GROUP BY method)"


def trials(spark, sf_dir):
    return candidates(spark, sf_dir).select("model_alias", "task", F.col("feature").alias("method"), F.col("x").alias("gain"), F.abs(F.col("y") - F.col("x")).alias("gap"))


@query(sql(f"SELECT method, n_tasks, {r('mean_gain', 'median_gain', 'mean_gap', 'median_gap', digits=8)} FROM macro", "metrics_long", "scores_long", ctes=(JOINED, TRIALS, MACRO)), digits=8)
def g17_macro_summary(spark, sf_dir):
    return K.macro_summary(trials(spark, sf_dir), "method", ["gain", "gap"])


VALID = f"""halves AS (SELECT model_alias, task, layer, round(avg(energy) FILTER (k % 2 = 0), 9) AS est, round(avg(energy) FILTER (k % 2 = 1), 9) AS held FROM curves_long GROUP BY ALL HAVING est IS NOT NULL AND held IS NOT NULL),
  hr AS (SELECT *, ({rank_sql('est', 'model_alias, task')})::DOUBLE AS a, ({rank_sql('held', 'model_alias, task')})::DOUBLE AS b FROM halves),
  valid AS (SELECT model_alias, task, median(est) AS estimate_median, stddev_pop(est) / greatest(avg(est), 1e-12) AS estimate_cv, max(est) - min(est) AS estimate_range,
    CASE WHEN count(*) >= 3 AND count(DISTINCT est) >= 2 AND count(DISTINCT held) >= 2 THEN corr(a, b) END AS spearman, count(*) AS n FROM hr GROUP BY model_alias, task)"""


def halves(spark, sf_dir):
    even = F.col("k") % 2 == 0
    c = curves(spark, sf_dir).groupBy(*CANDIDATE).agg(F.round(F.avg(F.when(even, F.col("energy"))), 9).alias("est"), F.round(F.avg(F.when(~even, F.col("energy"))), 9).alias("held"))
    return c.where("est is not null and held is not null")


@query(sql(f"SELECT model_alias, task, {r('estimate_median', 'estimate_cv', 'estimate_range', 'spearman', digits=10)}, n FROM valid", "curves_long", ctes=(VALID,)), digits=10)
def g20_validity(spark, sf_dir):
    return K.validity(halves(spark, sf_dir), CASE, "est", "held")


MATRIX = f"""ut AS (SELECT model_alias || '::L' || layer AS candidate, task, round(avg(primary_score), 9) AS u FROM scores_long GROUP BY ALL),
  sm AS (SELECT s.task, s.seed, s.model_alias || '::L' || s.layer AS candidate, s.primary_score AS s, u FROM scores_long s JOIN ut ON ut.task = s.task AND ut.candidate = s.model_alias || '::L' || s.layer),
  sp AS (SELECT task, seed, u, row_number() OVER (PARTITION BY task, seed ORDER BY s DESC, candidate) AS bs, row_number() OVER (PARTITION BY task, seed ORDER BY u DESC, candidate) AS bu, min(u) OVER (PARTITION BY task, seed) AS umin, max(u) OVER (PARTITION BY task, seed) AS umax,
    ({rank_sql('u', 'task, seed')})::DOUBLE AS ur FROM sm),
  views AS (SELECT task, seed, {_metric_sql()} FROM sp GROUP BY ALL)"""


@query(sql(f"SELECT task, count(*) AS n_views, {r('avg(exp_ndcg_at_5) AS ndcg', 'avg(scaled_regret_at_1) AS regret', 'avg(coverage_regret_at_5) AS coverage_regret', digits=12)} FROM views GROUP BY task", "scores_long", ctes=(MATRIX,)), digits=12)
def h14_score_matrix(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("candidate", F.concat_ws("::L", "model_alias", "layer"))
    u = s.groupBy("task", "candidate").agg(F.round(F.avg("primary_score"), 9).alias("u"))
    v = rounded(H.ranking_metrics(s.join(u, ["task", "candidate"]), ["task", "seed"], "primary_score", "u", "candidate"))
    return v.groupBy("task").agg(F.count("*").alias("n_views"), F.avg("exp_ndcg_at_5").alias("ndcg"), F.avg("scaled_regret_at_1").alias("regret"), F.avg("coverage_regret_at_5").alias("coverage_regret"))


@query(sql(f"SELECT task_type, task, depth_bin, {r('m', 'e AS early_baseline', '100.0::DOUBLE * (m - e) / e AS relative_change_pct', digits=10)} FROM (SELECT *, avg(m) FILTER ((depth_bin + 0.5::DOUBLE) / 11 <= 1.0::DOUBLE / 3) OVER (PARTITION BY task_type, task) AS e FROM (SELECT task_type, task, depth_bin, avg(primary_score) AS m FROM scores_long JOIN depth USING (model_alias, task, layer) GROUP BY ALL))", "scores_long", ctes=(DEPTH,)), digits=10)
def h22_relative_change(spark, sf_dir):
    by_bin = deep(spark, sf_dir).groupBy("task_type", "task", "depth_bin").agg(F.avg("primary_score").alias("m"))
    return K.relative_change(by_bin, "m")


# inference


@query(sql(f"""SELECT layer, seed, n, {r('avg((abs(s / n) >= abs(t / n) - 1e-15)::INT) AS p', digits=3)} FROM (SELECT layer, seed, n, list_sum(d) AS t, list_sum(list_transform(list_zip(d, range(n)), lambda x: CASE WHEN (mask >> x[2]::INT) & 1 = 0 THEN x[1] ELSE -x[1] END)) AS s FROM (
  SELECT *, unnest(range((1 << n)))::BIGINT AS mask FROM (SELECT layer, seed, list_sort(list(d)) AS d, count(*)::INT AS n FROM wide GROUP BY ALL))) GROUP BY ALL""", "scores_long", ctes=(DIFF, "wide AS (SELECT layer, seed, floor(d * 1048576) AS d FROM diffs WHERE abs(d) > 1e-5)")), digits=3)
def i7_sign_flip_without_zeros(spark, sf_dir):
    whole = F.floor(F.col("d") * 1048576).cast("double")  # whole numbers: sums are exact in any order
    d = diffs(spark, sf_dir).where("abs(d) > 1e-5").withColumn("d", whole)
    return I.sign_flip(d, ["layer", "seed"], "d", drop_zeros=True, tol=1e-15)


ALPHAS = [0.0, 0.5, 1.0, 2.0]


def objectives(spark, sf_dir):
    c = curves(spark, sf_dir)
    views = c.groupBy("task", "model_alias", "layer", (F.col("k") % 3).alias("view")).agg(F.sum("energy").alias("a"), F.sum(F.col("energy") * F.col("mass")).alias("c"))
    u = I.uncertainty(I.robust_variance(c, CANDIDATE, "energy"), CASE).select(*CANDIDATE, "uncertainty")
    return K.alpha_objectives(views.join(u, CANDIDATE).withColumn("candidate", F.concat_ws("::L", "model_alias", "layer")), ["task", "model_alias"], ALPHAS, 3)


@query(digits=6)
def i14_leave_one_task_out(spark, sf_dir):
    return K.leave_one_task_out(objectives(spark, sf_dir))


@query(sql(f"SELECT task, count(*) AS n, {r('max(d) AS max_error', 'median(d) AS median_error', 'avg((d <= 1e-6)::INT) AS within')} FROM (SELECT task, abs(h_k - ln(1 + s * (1 + 1e-7::DOUBLE))) AS d FROM (SELECT task, h_k, sum(energy) OVER (PARTITION BY model_alias, task, layer ORDER BY k) AS s FROM curves_long)) GROUP BY task", "curves_long"))
def i17_reconstruction(spark, sf_dir):
    again = F.expr("ln(1 + sum(energy) over (partition by model_alias, task, layer order by k) * (1 + 1e-7D))")
    return K.reconstruction(curves(spark, sf_dir).withColumn("again", again), ["task"], "again", "h_k")


# checks

HASHED = """hashed AS (SELECT *, CASE WHEN task_type = 'Classification' THEN md5(task || '|' || seed || CASE WHEN model_alias = 'm3' AND seed = 22 THEN 'x' ELSE '' END) END AS split_hash, (task_type IN ('Classification', 'Clustering')) <> (model_alias = 'm2') AS seed_affects FROM scores_long)"""


def hashed(spark, sf_dir):
    odd = F.when((F.col("model_alias") == "m3") & (F.col("seed") == 22), "x").otherwise("")
    own = F.md5(F.concat("task", F.lit("|"), F.col("seed").cast("string"), odd))
    return scores(spark, sf_dir).withColumn("split_hash", F.when(F.col("task_type") == "Classification", own)).withColumn(
        "seed_affects", F.col("task_type").isin("Classification", "Clustering") != (F.col("model_alias") == "m2"))


@query(sql("SELECT model_alias, task, count(DISTINCT seed_affects) = 1 AND bool_and(seed_affects = (task_type IN ('Classification', 'Clustering'))) AS seed_effect_ok FROM hashed GROUP BY ALL", "scores_long", ctes=(HASHED,)))
def j8_seed_effect(spark, sf_dir):
    return K.seed_effect(hashed(spark, sf_dir))


@query(sql("SELECT model_alias, task, seed, CASE WHEN max(task_type) = 'Classification' THEN count(DISTINCT split_hash) = 1 AND min(split_hash) = md5(task || '|' || seed) ELSE count(split_hash) = 0 END AS ok FROM hashed GROUP BY model_alias, task, seed", "scores_long", ctes=(HASHED,)))
def j9_split_alignment(spark, sf_dir):
    h = hashed(spark, sf_dir)
    manifest = h.select("task", "seed").distinct().withColumn("expected_hash", F.md5(F.concat("task", F.lit("|"), F.col("seed").cast("string"))))
    return K.split_alignment(h, manifest)


@query(sql("SELECT task, seed, count(DISTINCT split_hash) = 1 AS identical FROM hashed WHERE task_type = 'Classification' GROUP BY ALL", "scores_long", ctes=(HASHED,)))
def j11_split_identity(spark, sf_dir):
    return K.split_identity(hashed(spark, sf_dir))
