"""Registered queries over score, metric and curve tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from repselect.functions import scalars as S
from repselect.operators import evaluators as E, ranking as H, sampling as C, statistics as I, summaries as G, validation as J
from repselect.plans.queries import CASE, ORACLE_SQL, SEEDS, SPLIT, T, T_FAR, curves, items, metrics, query, r, rank_sql, scores
from repselect.sources.fixtures import sql_with

CANDIDATE = [*CASE, "layer"]
PROFILE = f"""profiles AS (SELECT model_alias, task, task_type, layer, count(*) AS n_seeds, avg(primary_score) AS score_mean, coalesce(var_samp(primary_score), 0) AS score_variance, min(primary_score) AS score_min, max(primary_score) AS score_max,
    string_agg(DISTINCT seed, ',' ORDER BY seed) AS seeds FROM scores_long GROUP BY model_alias, task, task_type, layer)"""
BEST = """best AS (SELECT model_alias, task, seed, min(layer) FILTER (abs(primary_score - top) <= 1e-8 + 1e-5 * abs(top)) AS best_layer, max(primary_score) AS best_score, max(layer) AS final_layer, max_by(primary_score, layer) AS final_score,
    max(primary_score) - max_by(primary_score, layer) AS gain FROM (SELECT *, max(primary_score) OVER (PARTITION BY model_alias, task, seed) AS top FROM scores_long) GROUP BY model_alias, task, seed)"""
MODE = """counts AS (SELECT model_alias, task, best_layer, count(*) AS c FROM best GROUP BY ALL),
  mode AS (SELECT model_alias, task, arg_min(best_layer, -c * 1000 + best_layer) AS modal_layer, max(c) AS modal_count, max(c)::DOUBLE / sum(c) AS modal_fraction, count(*) AS n_unique, sum(c)::BIGINT AS n_seeds FROM counts GROUP BY ALL)"""
JOINED = """joined AS (SELECT m.model_alias, m.task, m.layer, m.feature, m.direction * m.raw_value AS x, s.seed, s.primary_score AS y, s.task_type FROM metrics_long m JOIN scores_long s ON m.model_alias = s.model_alias AND m.task = s.task AND m.layer = s.layer)"""


def sql(body: str, *views: str, ctes: tuple[str, ...] = ()) -> str:
    return sql_with("X", *views).removesuffix(" X") + "".join(f", {c}" for c in ctes) + " " + body


def profiles(spark, sf_dir):
    return G.summarize_profiles(scores(spark, sf_dir), [*CASE, "task_type", "layer"])


def best(spark, sf_dir):
    return H.best_layers_by_seed(scores(spark, sf_dir), [*CASE, "seed"])


def joined(spark, sf_dir):
    m = metrics(spark, sf_dir).select(*CANDIDATE, "feature", (F.col("direction") * F.col("raw_value")).alias("x"))
    return m.join(scores(spark, sf_dir).withColumnRenamed("primary_score", "y"), CANDIDATE)


# aggregates


@query(sql(f"SELECT model_alias, task, task_type, layer, n_seeds, score_min, score_max, seeds, {r('score_mean', 'score_variance', 'sqrt(score_variance) AS score_std', 'sqrt(score_variance) / sqrt(n_seeds) AS score_sem', f'score_mean - coalesce({T}[n_seeds - 1] * sqrt(score_variance) / sqrt(n_seeds), 0) AS ci_low', f'score_mean + coalesce({T}[n_seeds - 1] * sqrt(score_variance) / sqrt(n_seeds), 0) AS ci_high')} FROM profiles", "scores_long", ctes=(PROFILE,)))
def g1_summarize_profiles(spark, sf_dir):
    return profiles(spark, sf_dir)


@query(sql(f"""SELECT task, feature, n, {r('m AS x_mean', 'v AS x_variance', 'sqrt(v) AS x_std', 'lo AS x_min', 'hi AS x_max', 'md AS x_median', 'sqrt(v) / sqrt(n) AS x_sem', f'm - coalesce({T}[n - 1] * sqrt(v) / sqrt(n), CASE WHEN n > 1 THEN {T_FAR.format(n="n")} * sqrt(v) / sqrt(n) ELSE 0 END) AS ci_low', f'm + coalesce({T}[n - 1] * sqrt(v) / sqrt(n), CASE WHEN n > 1 THEN {T_FAR.format(n="n")} * sqrt(v) / sqrt(n) ELSE 0 END) AS ci_high')} FROM (
  SELECT task, feature, count(*) AS n, avg(raw_value) AS m, coalesce(var_samp(raw_value), 0) AS v, min(raw_value) AS lo, max(raw_value) AS hi, median(raw_value) AS md FROM metrics_long GROUP BY task, feature)""", "metrics_long"))
def g2_sample_summary(spark, sf_dir):
    return G.sample_summary(metrics(spark, sf_dir), ["task", "feature"], "raw_value", "x")


@query(sql(f"SELECT model_alias, task, count(*) AS n, {r('avg(gain) AS gain_mean', 'coalesce(var_samp(gain), 0) AS gain_variance', 'min(gain) AS gain_min', 'max(gain) AS gain_max', 'avg(CASE WHEN gain > 1e-12 THEN 1.0::DOUBLE ELSE 0 END) AS fraction_positive')} FROM best GROUP BY ALL", "scores_long", ctes=(BEST,)))
def g3_final_vs_best(spark, sf_dir):
    return G.final_vs_best(best(spark, sf_dir), CASE)


@query(sql(f"""SELECT p.model_alias, p.task, best_mean_layer, final_layer, {r('best_mean_score', 'final_mean_score', 'gain_mean', 'gain_variance', 'modal_fraction')}, modal_layer, modal_count, n_unique FROM (
  SELECT model_alias, task, arg_min(layer, (-round(score_mean, 12), layer)) AS best_mean_layer, max(score_mean) AS best_mean_score, max(layer) AS final_layer, arg_max(score_mean, layer) AS final_mean_score FROM profiles GROUP BY ALL) p
  JOIN (SELECT model_alias, task, avg(gain) AS gain_mean, coalesce(var_samp(gain), 0) AS gain_variance FROM best GROUP BY ALL) g USING (model_alias, task) JOIN mode USING (model_alias, task)""", "scores_long", ctes=(PROFILE, BEST, MODE)))
def g4_best_layer_summary(spark, sf_dir):
    return G.best_layer_summary(profiles(spark, sf_dir).withColumn("score_mean", F.round("score_mean", 12)), best(spark, sf_dir), CASE)


@query(sql(f"""SELECT model_alias, task, modal_layer, modal_count, {r('modal_fraction', 'layer_mean', 'layer_variance')}, n_unique, n_seeds, by_seed FROM mode JOIN (SELECT model_alias, task, avg(best_layer) AS layer_mean, coalesce(var_samp(best_layer), 0) AS layer_variance,
  string_agg(seed || ':' || best_layer, ';' ORDER BY seed) AS by_seed FROM best GROUP BY ALL) USING (model_alias, task)""", "scores_long", ctes=(BEST, MODE)))
def g5_layer_selection_stability(spark, sf_dir):
    return G.layer_selection_stability(best(spark, sf_dir), CASE)


@query(sql(f"SELECT model_alias, task_type, count(*) AS n_tasks, {r('avg(m) AS mean', 'var_samp(m) AS variance')} FROM (SELECT model_alias, task_type, task, avg(score_mean) AS m FROM profiles GROUP BY ALL) GROUP BY ALL", "scores_long", ctes=(PROFILE,)))
def g6_family_summary(spark, sf_dir):
    by_task = profiles(spark, sf_dir).groupBy("model_alias", "task_type", "task").agg(F.avg("score_mean").alias("m"))
    return by_task.groupBy("model_alias", "task_type").agg(F.count("m").alias("n_tasks"), F.avg("m").alias("mean"), F.var_samp("m").alias("variance"))


RANKED = f"ranked AS (SELECT *, ({rank_sql('x', 'model_alias, task, seed, feature')})::DOUBLE AS rx, ({rank_sql('y', 'model_alias, task, seed, feature')})::DOUBLE AS ry FROM joined)"
CORR = f"""{RANKED}, flat AS (SELECT model_alias, task, seed, feature, max(task_type) AS task_type, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy, corr(x, y) AS p, corr(rx, ry) AS s FROM ranked GROUP BY model_alias, task, seed, feature),
  own AS (SELECT a.model_alias, a.task, a.seed, a.feature, a.layer, sum(abs(a.x - b.x)) AS ax, sum(abs(a.y - b.y)) AS ay, sum(abs(a.x - b.x) * abs(a.y - b.y)) AS xy, sum((a.x - b.x) ** 2) AS xx, sum((a.y - b.y) ** 2) AS yy,
    sum(sign(a.x - b.x) * sign(a.y - b.y)) AS sg, count(*) FILTER (a.x = b.x) AS tx, count(*) FILTER (a.y = b.y) AS ty FROM joined a JOIN joined b USING (model_alias, task, seed, feature) GROUP BY ALL),
  tot AS (SELECT model_alias, task, seed, feature, count(*)::DOUBLE AS n, sum(ax) AS sax, sum(ay) AS say, sum(xy) AS sxy, sum(xx) AS sxx, sum(yy) AS syy, sum(ax * ay) AS rxy, sum(ax * ax) AS rxx, sum(ay * ay) AS ryy, sum(sg) AS sg, sum(tx) AS tx, sum(ty) AS ty FROM own GROUP BY ALL),
  dc AS (SELECT *, sxy / n ** 2 - 2 * rxy / n ** 3 + sax * say / n ** 4 AS cxy, sxx / n ** 2 - 2 * rxx / n ** 3 + sax * sax / n ** 4 AS cxx, syy / n ** 2 - 2 * ryy / n ** 3 + say * say / n ** 4 AS cyy FROM tot),
  corrs AS (SELECT f.model_alias, f.task, f.task_type, f.seed, f.feature, f.n AS n_layers, CASE WHEN ok THEN p END AS pearson, CASE WHEN ok THEN s END AS spearman, CASE WHEN ok THEN sg / sqrt((d.n * d.n - tx) * (d.n * d.n - ty)) END AS kendall,
    CASE WHEN f.n >= 3 AND cxx > 1e-12 AND cyy > 1e-12 THEN sqrt(greatest(cxy, 0)) / sqrt(sqrt(cxx * cyy)) END AS distance
    FROM (SELECT *, n >= 3 AND sx > 1e-12 AND sy > 1e-12 AS ok FROM flat) f JOIN dc d USING (model_alias, task, seed, feature))"""


def per_seed(spark, sf_dir):
    return I.correlations(joined(spark, sf_dir), [*CASE, "seed", "feature"], "x", "y")


@query(sql(f"SELECT model_alias, task, seed, feature, n_layers, {r('pearson', 'spearman', 'kendall', 'distance', digits=6)} FROM corrs", "metrics_long", "scores_long", ctes=(JOINED, CORR)), digits=6)
def i3_layerwise_correlations(spark, sf_dir):
    return per_seed(spark, sf_dir)


@query(sql(f"""SELECT model_alias, task, feature, n, {r('m AS spearman_mean', 'v AS spearman_variance', 'sqrt(v) AS spearman_std', 'lo AS spearman_min', 'hi AS spearman_max', 'md AS spearman_median', 'positive_fraction', 'sign_consistency', 'sqrt(v) / sqrt(n) AS spearman_sem',
  f'm - coalesce({T}[n - 1] * sqrt(v) / sqrt(n), 0) AS ci_low', f'm + coalesce({T}[n - 1] * sqrt(v) / sqrt(n), 0) AS ci_high', digits=6)} FROM (SELECT model_alias, task, feature, count(s) AS n, avg(s) AS m, CASE WHEN count(s) > 1 THEN var_samp(s) WHEN count(s) = 1 THEN 0 END AS v, min(s) AS lo, max(s) AS hi, median(s) AS md,
  avg((s > 0)::INT) AS positive_fraction, greatest(avg((s >= 0)::INT), avg((s <= 0)::INT)) AS sign_consistency FROM (SELECT *, round(spearman, 12) AS s FROM corrs) GROUP BY ALL)""", "metrics_long", "scores_long", ctes=(JOINED, CORR)), digits=6)
def g7_correlation_seed_summary(spark, sf_dir):
    return G.correlation_seed_summary(per_seed(spark, sf_dir).withColumn("spearman", F.round("spearman", 12)), [*CASE, "feature"], "spearman")


@query(sql(f"SELECT feature, count(m) AS n_valid, {r('avg(m) AS mean_spearman', digits=6)} FROM (SELECT task, feature, avg(m) AS m FROM (SELECT model_alias, task, feature, avg(spearman) AS m FROM corrs GROUP BY ALL) GROUP BY ALL) GROUP BY ALL", "metrics_long", "scores_long", ctes=(JOINED, CORR)), digits=6)
def g8_mean_of_means(spark, sf_dir):
    return G.mean_of_means(per_seed(spark, sf_dir), "spearman", [[*CASE, "feature"], ["task", "feature"], ["feature"]])


@query(sql(f"SELECT task_type, feature, n, {r('m AS mean', f'm - {T}[n - 1] * sqrt(v) / sqrt(n) AS low', digits=6)} FROM (SELECT task_type, feature, count(m) AS n, avg(m) AS m, CASE WHEN count(m) > 1 THEN var_samp(m) END AS v FROM (SELECT task_type, task, feature, avg(spearman) AS m FROM corrs GROUP BY ALL) GROUP BY ALL)", "metrics_long", "scores_long", ctes=(JOINED, CORR)), digits=6)
def g9_family_correlations(spark, sf_dir):
    families = scores(spark, sf_dir).select("task", "task_type").distinct()
    by_task = per_seed(spark, sf_dir).groupBy("task", "feature").agg(F.avg("spearman").alias("m")).join(families, "task")
    s = G.sample_summary(by_task, ["task_type", "feature"], "m", "m")
    return s.select("task_type", "feature", "n", F.col("m_mean").alias("mean"), F.when(F.col("n") > 1, F.col("ci_low")).alias("low"))


@query(sql(f"SELECT feature, count(*) AS n, {r('avg(m) AS mean', 'quantile_cont(m, 0.25) AS q25', 'quantile_cont(m, 0.5) AS q50', 'quantile_cont(m, 0.75) AS q75', digits=6)}, count(*) FILTER (m > 0) AS positive FROM (SELECT model_alias, task, feature, round(avg(spearman), 9) AS m FROM corrs GROUP BY ALL HAVING avg(spearman) IS NOT NULL) GROUP BY ALL", "metrics_long", "scores_long", ctes=(JOINED, CORR)), digits=6)
def g11_quartile_cases(spark, sf_dir):
    cases = per_seed(spark, sf_dir).groupBy(*CASE, "feature").agg(F.round(F.avg("spearman"), 9).alias("m")).where("m is not null")
    return G.quartile_cases(cases, ["feature"], "m")


CURVE_JOIN = "cj AS (SELECT c.model_alias, c.task, c.task_type, c.layer, c.k, c.h_k, s.seed, s.primary_score FROM curves_long c JOIN scores_long s ON c.model_alias = s.model_alias AND c.task = s.task AND c.layer = s.layer)"
CURVE_RANK = f"cr AS (SELECT *, ({rank_sql('h_k', 'model_alias, task, seed, k')})::DOUBLE AS a, ({rank_sql('primary_score', 'model_alias, task, seed, k')})::DOUBLE AS b FROM cj)"
CURVE_CORR = "cc AS (SELECT model_alias, task, max(task_type) AS task_type, seed, k, CASE WHEN count(*) >= 3 AND count(DISTINCT h_k) >= 2 AND count(DISTINCT primary_score) >= 2 THEN corr(a, b) END AS spearman FROM cr GROUP BY model_alias, task, seed, k)"


def bandwidth_corr(spark, sf_dir):
    both = curves(spark, sf_dir).select(*CANDIDATE, "task_type", "k", "h_k").join(scores(spark, sf_dir).select(*CANDIDATE, "seed", "primary_score"), CANDIDATE)
    families = both.select("task", "task_type").distinct()
    return I.safe_spearman(both, [*CASE, "seed", "k"], "h_k", "primary_score").join(families, "task")


@query(sql(f"SELECT model_alias, task, task_type, seed, k, {r('spearman', digits=6)} FROM cc", "curves_long", "scores_long", ctes=(CURVE_JOIN, CURVE_RANK, CURVE_CORR)), digits=6)
def i4_safe_spearman(spark, sf_dir):
    return bandwidth_corr(spark, sf_dir).drop("n")


@query(sql(f"SELECT task_type, k, count(v) AS n_seeds, {r('avg(v) AS mean', 'var_samp(v) AS variance', digits=6)} FROM (SELECT task_type, seed, k, avg(v) AS v FROM (SELECT task_type, task, seed, k, avg(spearman) AS v FROM cc GROUP BY ALL) GROUP BY ALL) GROUP BY task_type, k", "curves_long", "scores_long", ctes=(CURVE_JOIN, CURVE_RANK, CURVE_CORR)), digits=6)
def g13_aggregate_bandwidth(spark, sf_dir):
    return G.aggregate_bandwidth(bandwidth_corr(spark, sf_dir))


DEPTH = """depth AS (SELECT *, CASE WHEN depth < 1.0::DOUBLE / 3 THEN 'Early' WHEN depth <= 2.0::DOUBLE / 3 THEN 'Middle' ELSE 'Late' END AS region, greatest(ceil(round(depth * 11, 9)) - 1, 0)::INT AS depth_bin FROM (
  SELECT model_alias, task, layer, CASE WHEN n > 1 THEN (rn - 1)::DOUBLE / (n - 1) ELSE 0.5 END AS depth FROM (SELECT model_alias, task, layer, row_number() OVER w AS rn, count(*) OVER (PARTITION BY model_alias, task) AS n FROM (SELECT DISTINCT model_alias, task, layer FROM scores_long) WINDOW w AS (PARTITION BY model_alias, task ORDER BY layer))))"""


def deep(spark, sf_dir):
    return H.relative_depth(scores(spark, sf_dir), CASE)


@query(sql(f"SELECT task_type, {r(*[f'avg(primary_score) FILTER (region = {chr(39)}{x}{chr(39)}) AS {x}' for x in ('Early', 'Middle', 'Late')], digits=12)} FROM scores_long JOIN depth USING (model_alias, task, layer) GROUP BY task_type", "scores_long", ctes=(DEPTH,)), digits=12)
def g15_depth_regions(spark, sf_dir):
    return G.depth_regions(deep(spark, sf_dir), ["task_type"], "primary_score")


@query(sql(f"SELECT task_type, depth_bin, count(*) AS n, {r('avg(m) AS mean')} FROM (SELECT task_type, task, depth_bin, avg(primary_score) AS m FROM scores_long JOIN depth USING (model_alias, task, layer) GROUP BY ALL) GROUP BY ALL", "scores_long", ctes=(DEPTH,)))
def g14_aggregate_depth(spark, sf_dir):
    by_task = deep(spark, sf_dir).groupBy("task_type", "task", "depth_bin").agg(F.avg("primary_score").alias("m"))
    return by_task.groupBy("task_type", "depth_bin").agg(F.count("m").alias("n"), F.avg("m").alias("mean"))


@query(sql(f"SELECT model_alias, task, layer, seed, {r('depth')}, region, depth_bin FROM scores_long JOIN depth USING (model_alias, task, layer)", "scores_long", ctes=(DEPTH,)))
def h17_relative_depth(spark, sf_dir):
    return deep(spark, sf_dir).drop("task_type", "primary_score")


@query(sql("SELECT least(floor(modal_fraction / 0.2), 4)::INT AS bin, count(*) AS n FROM mode GROUP BY ALL", "scores_long", ctes=(BEST, MODE)))
def g16_histogram(spark, sf_dir):
    return G.histogram(G.modal_layer(best(spark, sf_dir), CASE), "modal_fraction", 0.0, 1.0, 5)


COSTS = "costs AS (SELECT task, model_alias || '::L' || layer AS candidate, avg(primary_score) AS score, 0.01 * layer AS screen_s, 0.1 * count(*) AS eval_s FROM scores_long GROUP BY model_alias, task, layer)"


@query(sql(f"""SELECT *, {r('exhaustive_s / hybrid_s AS speedup')}, hybrid_s <= exhaustive_s AS break_even FROM (SELECT task, count(*) AS n_candidates, {r('sum(eval_s)::DOUBLE AS exhaustive_s', 'sum(screen_s)::DOUBLE AS screening_s', 'sum(eval_s) FILTER (rn <= 5)::DOUBLE AS shortlist_s', 'sum(screen_s)::DOUBLE + sum(eval_s) FILTER (rn <= 5)::DOUBLE AS hybrid_s')},
  string_agg(candidate, ';' ORDER BY rn) FILTER (rn <= 5) AS shortlist FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(score, 12) DESC, candidate) AS rn FROM costs) GROUP BY task)""", "scores_long", ctes=(COSTS,)))
def g18_runtime_accounting(spark, sf_dir):
    c = scores(spark, sf_dir).groupBy(*CANDIDATE).agg(F.round(F.avg("primary_score"), 12).alias("score"), F.count("*").alias("c"))
    return G.runtime_accounting(c.select("task", F.concat_ws("::L", "model_alias", "layer").alias("candidate"), "score", (F.lit(0.01) * F.col("layer")).alias("screen_s"), (F.lit(0.1) * F.col("c")).alias("eval_s")))


@query(sql(f"SELECT task, count(*) AS n, {r('regr_slope(ln(energy), ln(k)) AS slope', 'regr_r2(ln(energy), ln(k)) AS r2', digits=6)} FROM curves_long WHERE energy > 0 GROUP BY task", "curves_long"), digits=6)
def g19_loglog_fit(spark, sf_dir):
    return G.loglog_fit(curves(spark, sf_dir), ["task"], "k", "energy")


@query(sql("SELECT task, count(*) AS n_candidates FROM (SELECT DISTINCT task, model_alias, layer FROM scores_long) GROUP BY task", "scores_long"))
def g21_inventory(spark, sf_dir):
    return G.inventory(scores(spark, sf_dir), ["task"], ["model_alias", "layer"])


# joins


@query(sql("SELECT model_alias, task, layer, feature, x, seed, y, task_type FROM joined", "metrics_long", "scores_long", ctes=(JOINED,)))
def f1_metrics_join(spark, sf_dir):
    return joined(spark, sf_dir)


@query(sql("SELECT model_alias, task, layer, count(*) OVER (PARTITION BY model_alias, task)::BIGINT AS n_layers FROM (SELECT model_alias, task, layer FROM curves_long GROUP BY ALL HAVING count(DISTINCT k) = (SELECT count(DISTINCT k) FROM curves_long)) QUALIFY n_layers >= 3", "curves_long"))
def f4_common_support(spark, sf_dir):
    return H.common_support(curves(spark, sf_dir), CASE)


@query(sql("SELECT DISTINCT task FROM scores_long WHERE task NOT IN (SELECT task FROM metrics_long WHERE feature = 'participation' AND raw_value > 0.0405)", "scores_long", "metrics_long"))
def f8_excluded_tasks(spark, sf_dir):
    return scores(spark, sf_dir).select("task").distinct().join(metrics(spark, sf_dir).where("feature = 'participation' and raw_value > 0.0405"), "task", "left_anti")


@query(sql("SELECT model_alias, task, layer, alpha::DOUBLE AS alpha, round(m * alpha, 9) AS scaled FROM (SELECT model_alias, task, layer, avg(primary_score) AS m FROM scores_long GROUP BY ALL), (SELECT unnest([0.0, 0.5, 1.0]) AS alpha)", "scores_long"))
def f7_parameter_grid(spark, sf_dir):
    m = scores(spark, sf_dir).groupBy(*CANDIDATE).agg(F.avg("primary_score").alias("m"))
    return m.select(*CANDIDATE, "m", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("alpha")).select(*CANDIDATE, "alpha", (F.col("m") * F.col("alpha")).alias("scaled"))


# windows and ranks


@query(sql(f"SELECT model_alias, task, seed, best_layer, best_score, final_layer, final_score, {r('gain')} FROM best", "scores_long", ctes=(BEST,)))
def h1_best_layers_by_seed(spark, sf_dir):
    return best(spark, sf_dir)


@query(sql("SELECT model_alias, task, task_type, seed, layer, primary_score FROM (SELECT *, row_number() OVER (PARTITION BY task, seed ORDER BY model_alias, layer) AS rn FROM (SELECT *, max(primary_score) OVER (PARTITION BY task, seed) AS top FROM scores_long) WHERE abs(primary_score - top) <= 1e-8 + 1e-5 * abs(top)) WHERE rn = 1", "scores_long"))
def h2_task_oracle(spark, sf_dir):
    return H.task_oracle(scores(spark, sf_dir), ["task", "seed"], "primary_score")


@query(sql(f"SELECT model_alias, task, layer, {r('score_mean')} FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY model_alias, layer) AS rn FROM (SELECT *, max(score_mean) OVER (PARTITION BY task) AS top FROM profiles) WHERE abs(score_mean - top) <= 1e-8 + 1e-5 * abs(top)) WHERE rn = 1", "scores_long", ctes=(PROFILE,)))
def h3_task_oracle_summary(spark, sf_dir):
    return H.task_oracle(profiles(spark, sf_dir), ["task"], "score_mean").select(*CANDIDATE, "score_mean")


MODEL_SCORE = "ms AS (SELECT model_alias, task, round(max(score_mean), 9) AS score FROM profiles GROUP BY ALL)"
RANKS = f"ranks AS (SELECT *, ({rank_sql('-score', 'task')})::DOUBLE AS rank, CASE WHEN max(score) OVER (PARTITION BY task) > min(score) OVER (PARTITION BY task) THEN (score - min(score) OVER (PARTITION BY task)) / (max(score) OVER (PARTITION BY task) - min(score) OVER (PARTITION BY task)) ELSE 1 END AS minmax FROM ms)"


def ranks(spark, sf_dir):
    return H.model_task_ranks(profiles(spark, sf_dir).groupBy(*CASE).agg(F.round(F.max("score_mean"), 9).alias("score")))


@query(sql(f"SELECT model_alias, task, score, rank, {r('minmax')} FROM ranks", "scores_long", ctes=(PROFILE, MODEL_SCORE, RANKS)))
def h4_model_task_ranks(spark, sf_dir):
    return ranks(spark, sf_dir)


@query(sql(f"SELECT model_alias, count(*) AS n_tasks, {r('avg(rank) AS rank_mean', 'median(rank) AS rank_median', 'coalesce(var_samp(rank), 0) AS rank_variance', 'avg(minmax) AS minmax_mean')}, count(*) FILTER (abs(rank - 1) <= 1e-5 + 1e-8) AS wins FROM ranks GROUP BY ALL", "scores_long", ctes=(PROFILE, MODEL_SCORE, RANKS)))
def h5_rank_summary(spark, sf_dir):
    return H.rank_summary(ranks(spark, sf_dir))


def _metric_sql() -> str:
    out = []
    for k in (1, 3, 5):
        dcg = lambda gain, place: f"sum({gain} / log2({place} + 1)) FILTER ({place} <= {k})"
        lin, ex = "(u - umin)", "(2.0::DOUBLE ** (CASE WHEN umax > umin THEN (u - umin) / (umax - umin) ELSE 0 END) - 1)"
        out += [f"CASE WHEN max(umax) > max(umin) AND count(*) > 1 THEN {dcg(lin, 'bs')} / {dcg(lin, 'bu')} END AS ndcg_at_{k}", f"CASE WHEN max(umax) > max(umin) THEN {dcg(ex, 'bs')} / {dcg(ex, 'bu')} ELSE 1 END AS exp_ndcg_at_{k}",
                f"count(*) FILTER (bs <= {k} AND bu <= {k}) / {k}.0::DOUBLE AS topk_overlap_at_{k}", f"max(umax) - max(u) FILTER (bs <= {k}) AS coverage_regret_at_{k}"]
    return r(*out, "max(umax) - max(u) FILTER (bs = 1) AS regret_at_1", "CASE WHEN max(umax) > max(umin) THEN (max(umax) - max(u) FILTER (bs = 1)) / (max(umax) - max(umin)) ELSE 0 END AS scaled_regret_at_1", "(max(ur) FILTER (bs = 1) - 1) / greatest(count(*) - 1, 1) AS selected_percentile")


PLACED = f"""cand AS (SELECT task, seed, feature, model_alias || '::L' || layer AS candidate, model_alias, x, y FROM joined),
  placed AS (SELECT task, seed, feature, y AS u, row_number() OVER (PARTITION BY task, seed, feature ORDER BY x DESC, candidate) AS bs, row_number() OVER (PARTITION BY task, seed, feature ORDER BY y DESC, candidate) AS bu,
    min(y) OVER (PARTITION BY task, seed, feature) AS umin, max(y) OVER (PARTITION BY task, seed, feature) AS umax, ({rank_sql('y', 'task, seed, feature')})::DOUBLE AS ur FROM cand)"""


def candidates(spark, sf_dir):
    return joined(spark, sf_dir).withColumn("candidate", F.concat_ws("::L", "model_alias", "layer"))


@query(sql(f"SELECT task, seed, feature, count(*) AS n_candidates, max(umax) - max(u) FILTER (bs = 1) <= 0.05 * (max(umax) - max(umin)) AS near_oracle, {_metric_sql()} FROM placed GROUP BY ALL", "metrics_long", "scores_long", ctes=(JOINED, PLACED)))
def h6_ranking_metrics(spark, sf_dir):
    return H.ranking_metrics(candidates(spark, sf_dir), ["task", "seed", "feature"], "x", "y", "candidate")


@query(sql(f"""SELECT task, seed, feature, {r('avg(ok) FILTER (told) AS accuracy_all', 'avg(ok) FILTER (told AND same) AS accuracy_within', 'avg(ok) FILTER (told AND NOT same) AS accuracy_cross', 'avg(CASE WHEN abs(ds) > 1e-12 THEN ok ELSE 0.5 END) FILTER (abs(du) > 1e-12) AS half_accuracy')}, count(*) FILTER (told) AS n_pairs FROM (
  SELECT *, abs(ds) > 1e-12 AND abs(du) > 1e-12 AS told, (sign(ds) = sign(du))::INT::DOUBLE AS ok FROM (SELECT a.task, a.seed, a.feature, a.x - b.x AS ds, a.y - b.y AS du, a.model_alias = b.model_alias AS same FROM cand a JOIN cand b ON a.task = b.task AND a.seed = b.seed AND a.feature = b.feature AND a.candidate < b.candidate)) GROUP BY ALL""", "metrics_long", "scores_long", ctes=(JOINED, PLACED)))
def h11_preference_accuracy(spark, sf_dir):
    return H.preference_accuracy(candidates(spark, sf_dir), ["task", "seed", "feature"], "x", "y", "model_alias")


@query(f"""SELECT * FROM ({ORACLE_SQL['h6_ranking_metrics']}) JOIN ({ORACLE_SQL['h11_preference_accuracy']}) USING (task, seed, feature) JOIN (
  {sql(f"SELECT task, seed, feature, {r('CASE WHEN count(*) >= 3 AND count(DISTINCT x) >= 2 AND count(DISTINCT y) >= 2 THEN corr(a, b) END AS spearman', digits=7)}, count(*) AS n FROM (SELECT *, ({rank_sql('x', 'task, seed, feature')})::DOUBLE AS a, ({rank_sql('y', 'task, seed, feature')})::DOUBLE AS b FROM joined) GROUP BY ALL", "metrics_long", "scores_long", ctes=(JOINED,))}) USING (task, seed, feature)""")
def h16_candidate_alignment(spark, sf_dir):
    keys, c = ["task", "seed", "feature"], candidates(spark, sf_dir)
    metrics = S.rounded(H.ranking_metrics(c, keys, "x", "y", "candidate")).join(S.rounded(H.preference_accuracy(c, keys, "x", "y", "model_alias")), keys)
    return metrics.join(I.safe_spearman(c, keys, "x", "y").withColumn("spearman", F.round("spearman", 7)), keys)


@query(sql(f"""SELECT model_alias, task, layer, feature, {r('CASE WHEN z > 0 AND mid > 0 THEN ln(z / mid) END AS calibrated', digits=6)} FROM (SELECT *, median(z) OVER (PARTITION BY task, feature, model_alias) AS mid FROM (
  SELECT *, x + CASE WHEN lo <= 0 THEN -lo + greatest(hi - lo, abs(lo), abs(hi), 1.0::DOUBLE) * 1e-12::DOUBLE ELSE 0 END AS z FROM (SELECT model_alias, task, layer, feature, raw_value AS x, min(raw_value) OVER w AS lo, max(raw_value) OVER w AS hi FROM metrics_long WINDOW w AS (PARTITION BY task, feature, model_alias))))""", "metrics_long"), digits=6)
def h15_model_logratio(spark, sf_dir):
    return H.model_logratio(metrics(spark, sf_dir), ["task", "feature"], "model_alias", "raw_value").select(*CANDIDATE, "feature", "calibrated")


@query(sql(f"SELECT model_alias, task, layer, {r('sum(k * p) AS mean_mode', 'sqrt(sum(p * (k - mu) ** 2)) AS spread', 'max(p) AS top_share')} FROM (SELECT *, sum(k * p) OVER (PARTITION BY model_alias, task, layer) AS mu FROM (SELECT *, energy / sum(energy) OVER (PARTITION BY model_alias, task, layer) AS p FROM curves_long)) GROUP BY ALL", "curves_long"))
def h18_mode_moments(spark, sf_dir):
    return H.mode_moments(curves(spark, sf_dir), CANDIDATE)


@query(sql("SELECT model_alias, task, layer, min(mass) >= -1e-9 AS not_negative, max(mass) <= 1 + 1e-9 AS at_most_one, coalesce(min(d) >= -1e-9, true) AS monotone, max_by(mass, k) >= 0.8 AS full, min(mass) >= -1e-9 AND max(mass) <= 1 + 1e-9 AND coalesce(min(d) >= -1e-9, true) AND max_by(mass, k) >= 0.8 AS cumulative FROM (SELECT *, mass - lag(mass) OVER (PARTITION BY model_alias, task, layer ORDER BY k) AS d FROM curves_long) GROUP BY ALL", "curves_long").replace("AS full,", 'AS "full",'))
def h19_mass_semantics(spark, sf_dir):
    return H.mass_semantics(curves(spark, sf_dir), CANDIDATE)


@query(sql("SELECT model_alias, task, layer, min(k) FILTER (mass >= 0.9) AS k90, min(k) FILTER (mass >= 0.9) IS NOT NULL AS k90_available, min(k) FILTER (mass >= 0.95) AS k95, min(k) FILTER (mass >= 0.95) IS NOT NULL AS k95_available FROM curves_long GROUP BY ALL", "curves_long"))
def h20_k_at_mass(spark, sf_dir):
    return H.k_at_mass(curves(spark, sf_dir), CANDIDATE)


@query(sql(f"SELECT task, best_k, {r('best_value', 'fixed_value', 'best_value - fixed_value AS gap')} FROM (SELECT task, arg_max(k, (v, -k)) AS best_k, max(v) AS best_value, max(v) FILTER (k = 10) AS fixed_value FROM (SELECT task, k, round(avg(energy), 9) AS v FROM curves_long GROUP BY ALL) GROUP BY task)", "curves_long"))
def h24_best_bandwidth(spark, sf_dir):
    c = curves(spark, sf_dir).groupBy("task", "k").agg(F.round(F.avg("energy"), 9).alias("v"))
    return H.best_bandwidth(c, ["task"], "v")


@query(sql("""SELECT model_alias, task, layer, start, stop, length FROM (SELECT *, row_number() OVER (PARTITION BY model_alias, task, layer ORDER BY length DESC, start) AS rn FROM (
  SELECT model_alias, task, layer, min(k) AS start, max(k) AS stop, count(*) AS length FROM (SELECT *, k - row_number() OVER (PARTITION BY model_alias, task, layer ORDER BY k) AS g FROM curves_long WHERE energy < 26) GROUP BY model_alias, task, layer, g)) WHERE rn = 1""", "curves_long"))
def h23_longest_run(spark, sf_dir):
    return H.longest_run(curves(spark, sf_dir), CANDIDATE, "k", F.col("energy") < 26)


@query(sql("""SELECT cutoff, coalesce(n_cases, 0) AS n_cases, coalesce(n_tasks, 0) AS n_tasks FROM (SELECT DISTINCT k AS cutoff FROM curves_long) LEFT JOIN (SELECT cutoff, count(*) AS n_cases, count(DISTINCT task) AS n_tasks FROM (
  SELECT cutoff, model_alias, task FROM (SELECT c.cutoff, l.model_alias, l.task, l.layer FROM (SELECT DISTINCT k AS cutoff FROM curves_long) c JOIN curves_long l ON l.k <= c.cutoff GROUP BY ALL HAVING count(DISTINCT l.k) = c.cutoff) GROUP BY ALL HAVING count(*) >= 3) GROUP BY cutoff) USING (cutoff)""", "curves_long"))
def h25_support_audit(spark, sf_dir):
    return H.support_audit(curves(spark, sf_dir), CASE)


@query(sql(f"SELECT task, model_alias, layer, {r('score')}, place FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, candidate) AS place FROM (SELECT task, model_alias, layer, model_alias || '::L' || layer AS candidate, round(avg(primary_score), 9) AS score FROM scores_long GROUP BY ALL)) WHERE place <= 5", "scores_long"))
def h26_shortlist(spark, sf_dir):
    c = scores(spark, sf_dir).groupBy(*CANDIDATE).agg(F.round(F.avg("primary_score"), 9).alias("score")).withColumn("candidate", F.concat_ws("::L", "model_alias", "layer"))
    return H.shortlist(c, ["task"], "score", "candidate").select("task", "model_alias", "layer", "score", F.col("place").cast("long").alias("place"))


# inference


@query(digits=6)
def i5_bootstrap_mean(spark, sf_dir):
    return I.bootstrap_mean(profiles(spark, sf_dir).groupBy("task_type", "task").agg(F.avg("score_mean").alias("m")), ["task_type"], "m", 400)


DIFF = "diffs AS (SELECT layer, seed, task, round(avg(primary_score) FILTER (model_alias = 'm1') - avg(primary_score) FILTER (model_alias = 'm0'), 9) AS d FROM scores_long GROUP BY ALL)"


def diffs(spark, sf_dir):
    side = lambda m: F.avg(F.when(F.col("model_alias") == m, F.col("primary_score")))
    return scores(spark, sf_dir).groupBy("layer", "seed", "task").agg(F.round(side("m1") - side("m0"), 9).alias("d"))


@query(sql(f"""SELECT layer, seed, n, {r('avg((abs(s / n) >= abs(t / n) - 1e-12)::INT) AS p')} FROM (SELECT layer, seed, n, list_sum(d) AS t, list_sum(list_transform(list_zip(d, range(n)), lambda x: CASE WHEN (mask >> x[2]::INT) & 1 = 0 THEN x[1] ELSE -x[1] END)) AS s FROM (
  SELECT *, unnest(range((1 << n))) ::BIGINT AS mask FROM (SELECT layer, seed, list_sort(list(d)) AS d, count(*)::INT AS n FROM diffs WHERE d IS NOT NULL GROUP BY ALL))) GROUP BY ALL""", "scores_long", ctes=(DIFF,)))
def i6_sign_flip(spark, sf_dir):
    return I.sign_flip(diffs(spark, sf_dir), ["layer", "seed"], "d", max_exact=25, draws=None)


@query(sql(f"SELECT layer, seed, {r('coalesce(sum(sign(d) * rk) FILTER (abs(d) > 1e-12) / sum(rk) FILTER (abs(d) > 1e-12), 0) AS rank_biserial')} FROM (SELECT *, ({rank_sql('a', 'layer, seed')})::DOUBLE AS rk FROM (SELECT *, abs(d) AS a FROM diffs WHERE d IS NOT NULL AND abs(d) > 1e-12)) GROUP BY ALL", "scores_long", ctes=(DIFF,)))
def i8_rank_biserial(spark, sf_dir):
    return I.rank_biserial(diffs(spark, sf_dir), ["layer", "seed"], "d")


@query(sql(f"SELECT task_type, task, layer, {r('p', 'least(1, max(s) OVER (PARTITION BY task_type ORDER BY p, task, layer)) AS p_holm', digits=7)} FROM (SELECT *, (count(*) OVER (PARTITION BY task_type) - row_number() OVER (PARTITION BY task_type ORDER BY p, task, layer) + 1) * p AS s FROM (SELECT task_type, task, layer, round(var_samp(primary_score) * 100, 9) AS p FROM scores_long GROUP BY ALL HAVING count(*) > 1))", "scores_long"), digits=7)
def i9_holm(spark, sf_dir):
    p = scores(spark, sf_dir).groupBy("task_type", "task", "layer").agg(F.round(F.var_samp("primary_score") * 100, 9).alias("p")).where("p is not null")
    return I.holm(p, ["task_type"])


@query(sql(f"SELECT layer, count(*) AS n_units, {r('avg(d) AS mean_advantage', 'median(d) AS median_advantage', digits=8)}, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (d < -1e-12) AS losses, count(*) FILTER (abs(d) <= 1e-12) AS ties FROM (SELECT layer, task, round(avg(primary_score) FILTER (model_alias = 'm1'), 9) - round(avg(primary_score) FILTER (model_alias = 'm0'), 9) AS d FROM scores_long GROUP BY ALL) WHERE d IS NOT NULL GROUP BY layer", "scores_long"), digits=8)
def i10_paired_advantage(spark, sf_dir):
    s = scores(spark, sf_dir).where("model_alias in ('m0', 'm1')").groupBy("layer", "task", "model_alias").agg(F.round(F.avg("primary_score"), 9).alias("v"))
    return I.paired_tests(s, ["layer"], "task", "model_alias", "m0", "m1", "v").drop("p", "p_sign", "p_holm", "rank_biserial")


@query(digits=6)
def i10_paired_tests(spark, sf_dir):
    s = scores(spark, sf_dir).where("model_alias in ('m0', 'm1')").groupBy("layer", "task", "model_alias").agg(F.round(F.avg("primary_score"), 9).alias("v"))
    return I.paired_tests(s, ["layer"], "task", "model_alias", "m0", "m1", "v")


ROBUST = """robust AS (SELECT model_alias, task, coalesce(0.5 * max(v) + 0.5 * (1.4826 * median(abs(x - m))) ** 2, 0) AS lev FROM (SELECT *, median(x) OVER w AS m, var_samp(x) OVER w AS v FROM (
  SELECT model_alias, task, ln(1 + energy / median(CASE WHEN energy > 0 THEN energy END) OVER (PARTITION BY model_alias, task)) AS x FROM curves_long) WINDOW w AS (PARTITION BY model_alias, task)) GROUP BY model_alias, task)"""


def robust(spark, sf_dir):
    return I.robust_variance(curves(spark, sf_dir), CASE, "energy")


@query(sql(f"SELECT model_alias, task, {r('lev AS log_energy_variance')} FROM robust", "curves_long", ctes=(ROBUST,)))
def i11_robust_variance(spark, sf_dir):
    return robust(spark, sf_dir)


UNCERTAIN = "unc AS (SELECT *, CASE WHEN mid > 0 THEN (0.5 * lev + 0.5 * mid) / mid ELSE 0 END AS uncertainty FROM (SELECT *, median(lev) OVER (PARTITION BY task) AS mid FROM robust))"


@query(sql(f"SELECT model_alias, task, {r('lev AS log_energy_variance', 'uncertainty')} FROM unc", "curves_long", ctes=(ROBUST, UNCERTAIN)))
def i12_uncertainty(spark, sf_dir):
    return I.uncertainty(robust(spark, sf_dir), ["task"])


@query(sql(f"SELECT c.model_alias, c.task, c.layer, {r('uncertainty', 'a', 'c', 'ln(1 + greatest(a / (1 + uncertainty) + c, 0)) AS adaptive_score', 'ln(1 + greatest(a + c, 0)) AS fixed_score', 'ln(1 + greatest(c, 0)) AS no_precision_score', digits=7)} FROM (SELECT model_alias, task, layer, sum(energy) AS a, sum(energy * mass) AS c FROM curves_long GROUP BY ALL) c JOIN unc USING (model_alias, task)", "curves_long", ctes=(ROBUST, UNCERTAIN)), digits=7)
def i13_precision_scores(spark, sf_dir):
    energies = curves(spark, sf_dir).groupBy(*CANDIDATE).agg(F.sum("energy").alias("a"), F.sum(F.col("energy") * F.col("mass")).alias("c"))
    u = I.uncertainty(robust(spark, sf_dir), ["task"]).select(*CASE, "uncertainty")
    return I.precision_scores(energies.join(u, CASE))


@query(sql(f"""SELECT task, {r('avg(rk) AS mean_spearman', 'avg(inter / uni) AS topk_jaccard', 'avg(f) AS top1_agreement', digits=6)}, count(*) AS n_view_pairs FROM (SELECT a.task, a.seed AS v1, b.seed AS v2, corr(a.rk, b.rk) AS rk, count(*) FILTER (a.p <= 5 AND b.p <= 5)::DOUBLE AS inter, count(*) FILTER (a.p <= 5 OR b.p <= 5)::DOUBLE AS uni, max((a.p = 1 AND b.p = 1)::INT)::DOUBLE AS f
  FROM vr a JOIN vr b ON a.task = b.task AND a.candidate = b.candidate AND a.seed < b.seed GROUP BY ALL) GROUP BY task""", "scores_long", ctes=(f"vr AS (SELECT *, ({rank_sql('primary_score', 'task, seed')})::DOUBLE AS rk, row_number() OVER (PARTITION BY task, seed ORDER BY primary_score DESC, candidate) AS p FROM (SELECT *, model_alias || '::L' || layer AS candidate FROM scores_long))",)), digits=6)
def h13_view_stability(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("candidate", F.concat_ws("::L", "model_alias", "layer"))
    return I.view_stability(s, ["task"], "seed", "candidate", "primary_score")


# checks


@query(sql("SELECT m AS model_alias, t AS task, s::INT AS seed, 'missing' AS problem FROM (SELECT unnest(['m0', 'm1', 'm7']) AS m), (SELECT unnest(['t0', 't1']) AS t), (SELECT unnest([11, 22]) AS s) WHERE (m, t, s) NOT IN (SELECT DISTINCT (model_alias, task, seed::INT) FROM scores_long) UNION ALL SELECT DISTINCT model_alias, task, seed::INT, 'unexpected' FROM scores_long WHERE NOT (model_alias IN ('m0', 'm1', 'm7') AND task IN ('t0', 't1') AND seed IN (11, 22))", "scores_long"))
def j1_expected_cells(spark, sf_dir):
    return J.expected_cells(scores(spark, sf_dir), ["m0", "m1", "m7"], ["t0", "t1"], [11, 22])


#: The split under seed 11, and under seed 22 the same one spoilt: items left out, in both parts, or of other tasks.
SPOILT = f"""{SPLIT}, manifests AS (
  SELECT task, 11 AS seed, item_id, part FROM split UNION ALL
  SELECT task, 22, item_id, part FROM split WHERE item_id % 50 <> 3 UNION ALL
  SELECT task, 22, item_id, CASE WHEN part = 'test' THEN 'train' ELSE 'test' END FROM split WHERE item_id % 40 = 1 AND item_id % 50 <> 3 UNION ALL
  SELECT 'en', 22, item_id, 'train' FROM split WHERE item_id % 60 = 7 AND task <> 'en')"""


def manifests(spark, sf_dir):
    split = C.stratified_split(items(spark, sf_dir), ["task"], "label", 0.3, 11).select("task", "item_id", "part")
    left = split.where("item_id % 50 <> 3")
    both = left.where("item_id % 40 = 1").withColumn("part", F.when(F.col("part") == "test", "train").otherwise("test"))
    strange = split.where("item_id % 60 = 7 and task <> 'en'").select(F.lit("en").alias("task"), "item_id", F.lit("train").alias("part"))
    return split.withColumn("seed", F.lit(11)).unionByName(left.unionByName(both).unionByName(strange).withColumn("seed", F.lit(22)))


@query(sql("X", "items").removesuffix(" X") + f""", {SPOILT},
  once AS (SELECT task, seed, item_id, count(DISTINCT part) AS parts, bool_or(part = 'train') AS train, bool_or(part = 'test') AS test FROM manifests GROUP BY ALL),
  own AS (SELECT o.task, o.seed, count(*) FILTER (train) AS n_train, count(*) FILTER (test) AS n_test, count(*) FILTER (parts > 1) AS n_overlap,
    count(i.item_id) AS known, count(*) - count(i.item_id) AS n_unknown FROM once o LEFT JOIN (SELECT DISTINCT task, item_id FROM items) i
    ON i.task = o.task AND i.item_id = o.item_id GROUP BY o.task, o.seed),
  all_items AS (SELECT task, count(DISTINCT item_id) AS n FROM items GROUP BY task)
  SELECT task, seed, n_train, n_test, n_overlap, n - known AS n_missing, n_unknown,
    n_overlap = 0 AND n = known AND n_unknown = 0 AND n_train > 0 AND n_test > 0 AS valid FROM own JOIN all_items USING (task)""")
def j3_split_integrity(spark, sf_dir):
    return J.split_integrity(manifests(spark, sf_dir), items(spark, sf_dir), ["task", "seed"], ["task"])


@query(sql("X", "items").removesuffix(" X") + f""", {SPOILT}, three AS (
    SELECT task, seed, item_id FROM manifests WHERE part = 'test' UNION ALL SELECT task, 33, item_id FROM split WHERE part = 'test')
  SELECT task, count(*) AS n_seeds, count(DISTINCT h) AS n_splits FROM (SELECT task, seed, string_agg(item_id, ',' ORDER BY item_id) AS h FROM three GROUP BY ALL) GROUP BY task""")
def j4_split_diversity(spark, sf_dir):
    found = manifests(spark, sf_dir)
    return J.split_diversity(found.unionByName(found.where("seed = 11").withColumn("seed", F.lit(33))))


@query(sql("SELECT model_alias, task, count(DISTINCT seed) AS n_seeds, 4 - count(DISTINCT seed) AS n_missing FROM scores_long GROUP BY ALL", "scores_long"))
def j5_seed_coverage(spark, sf_dir):
    return J.seed_coverage(scores(spark, sf_dir), SEEDS)


@query(sql("SELECT task, count(DISTINCT task_type) AS n_task_type, count(DISTINCT seed) AS n_seed FROM scores_long GROUP BY ALL", "scores_long"))
def j6_hash_consistency(spark, sf_dir):
    return J.hash_consistency(scores(spark, sf_dir), ["task"], ["task_type", "seed"])


@query(sql("SELECT model_alias, task, count(DISTINCT l) AS n_layer_sets, max(rep) AS repeated, count(DISTINCT l) = 1 AND NOT max(rep) AS aligned FROM (SELECT model_alias, task, seed, string_agg(DISTINCT layer, ',' ORDER BY layer) AS l, count(*) <> count(DISTINCT layer) AS rep FROM scores_long GROUP BY ALL) GROUP BY ALL", "scores_long"))
def j7_layer_alignment(spark, sf_dir):
    return J.layer_alignment(scores(spark, sf_dir))


@query(sql(f"SELECT model_alias, task, {r('max(d) AS max_spread')}, max(d) = 0 AS identical FROM (SELECT model_alias, task, layer, max(primary_score) - min(primary_score) AS d FROM scores_long WHERE task_type IN ('PairClassification', 'STS') GROUP BY ALL) GROUP BY ALL", "scores_long"))
def j10_deterministic_seeds(spark, sf_dir):
    return J.deterministic_seeds(scores(spark, sf_dir), list(E.SEED_FREE))


@query()
def j_validate_integrity(spark, sf_dir):
    return J.validate_integrity(scores(spark, sf_dir), [f"m{k}" for k in range(7)], [f"t{k}" for k in range(11)], SEEDS, list(E.SEED_FREE))
