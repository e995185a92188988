"""Registered queries of score and utility alignment: seed-mean curves, calibrated candidates, contraction span."""

from __future__ import annotations

from pyspark.sql import functions as F

from repselect.functions.scalars import rounded
from repselect.operators import alignment as L, ranking as H, study as K
from repselect.plans.queries import CASE, curves, query, r, rank_sql
from repselect.plans.queries_tables import CANDIDATE, DEPTH, JOINED, PLACED, _metric_sql, candidates, joined, sql
from repselect.session import settled


def coefficients_sql(source: str, keys: str, row: str, name: str) -> str:
    """CTEs that end in ``name``: keys, n, pearson, spearman, kendall, distance of ``x`` and ``y``, from all pairs of rows."""
    return f"""{name}_rk AS (SELECT *, ({rank_sql('x', keys)})::DOUBLE AS rx, ({rank_sql('y', keys)})::DOUBLE AS ry FROM {source}),
  {name}_base AS (SELECT {keys}, count(*)::DOUBLE AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy, corr(x, y) AS p, corr(rx, ry) AS s
    FROM {name}_rk GROUP BY {keys}),
  {name}_own AS (SELECT {keys}, a.{row} AS id, sum(abs(a.x - b.x)) AS ax, sum(abs(a.y - b.y)) AS ay, sum(abs(a.x - b.x) * abs(a.y - b.y)) AS xy,
      sum((a.x - b.x) ** 2) AS xx, sum((a.y - b.y) ** 2) AS yy, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS sg,
      count(*) FILTER (a.x = b.x) AS tx, count(*) FILTER (a.y = b.y) AS ty FROM {source} a JOIN {source} b USING ({keys}) GROUP BY {keys}, a.{row}),
  {name}_tot AS (SELECT {keys}, sum(ax) AS sax, sum(ay) AS say, sum(xy) AS sxy, sum(xx) AS sxx, sum(yy) AS syy, sum(ax * ay) AS rxy, sum(ax * ax) AS rxx,
      sum(ay * ay) AS ryy, sum(sg) AS sg, sum(tx) AS tx, sum(ty) AS ty FROM {name}_own GROUP BY {keys}),
  {name}_dc AS (SELECT *, sxy / n ** 2 - 2 * rxy / n ** 3 + sax * say / n ** 4 AS cxy, sxx / n ** 2 - 2 * rxx / n ** 3 + sax * sax / n ** 4 AS cxx,
      syy / n ** 2 - 2 * ryy / n ** 3 + say * say / n ** 4 AS cyy, n >= 3 AND sx > 1e-12 AND sy > 1e-12 AS ok FROM {name}_base JOIN {name}_tot USING ({keys})),
  {name} AS (SELECT {keys}, n::BIGINT AS n, CASE WHEN ok THEN p END AS pearson, CASE WHEN ok THEN s END AS spearman,
      CASE WHEN ok THEN sg / sqrt((n * n - tx) * (n * n - ty)) END AS kendall,
      CASE WHEN n >= 3 AND cxx > 1e-12 AND cyy > 1e-12 THEN sqrt(greatest(cxy, 0)) / sqrt(sqrt(cxx * cyy)) END AS distance FROM {name}_dc)"""


# seed-mean curves

MEAN_CURVE = "mean_curve AS (SELECT model_alias, task, feature, layer, max(x) AS x, round(avg(y), 12) AS y FROM joined GROUP BY ALL)"
BY_CASE = coefficients_sql("mean_curve", "model_alias, task, feature", "layer", "by_case")
FOUR = ("pearson", "spearman", "kendall", "distance")


def by_mean_curve(spark, sf_dir):
    rows = joined(spark, sf_dir).groupBy("model_alias", "task", "feature", "layer").agg(F.max("x").alias("x"), F.round(F.avg("y"), 12).alias("y"))
    return L.mean_curve_correlations(rows, [*CASE, "feature"], "x", "y")


@query(sql(f"SELECT model_alias, task, feature, n AS n_layers, {r(*FOUR, digits=6)} FROM by_case", "metrics_long", "scores_long",
           ctes=(JOINED, MEAN_CURVE, BY_CASE)), digits=6)
def i3_mean_curve_correlations(spark, sf_dir):
    return by_mean_curve(spark, sf_dir)


@query(sql(f"""SELECT task, feature, {r(*[f'avg({c}) AS {c}' for c in FOUR], digits=6)}, {', '.join(f'count({c}) AS n_valid_{c}' for c in FOUR)}
  FROM by_case GROUP BY task, feature""", "metrics_long", "scores_long", ctes=(JOINED, MEAN_CURVE, BY_CASE)), digits=6)
def g8_mean_curve_task_level(spark, sf_dir):
    return L.task_level(by_mean_curve(spark, sf_dir), [["task", "feature"]])


# calibrated candidates of a task

#: Both calibrations under one name, so that the common texts on ``joined`` serve.
CALIBRATED = """plain AS (SELECT m.model_alias, m.task, m.layer, m.feature, m.direction * m.raw_value AS v, s.seed, s.primary_score AS y, s.task_type
    FROM metrics_long m JOIN scores_long s ON m.model_alias = s.model_alias AND m.task = s.task AND m.layer = s.layer),
  moved AS (SELECT *, v + CASE WHEN lo <= 0 THEN -lo + greatest(hi - lo, abs(lo), abs(hi), 1.0::DOUBLE) * 1e-12::DOUBLE ELSE 0 END AS z
    FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM plain WINDOW w AS (PARTITION BY task, seed, feature, model_alias))),
  joined AS (SELECT model_alias, task, task_type, seed, layer, feature || '|raw' AS feature, v AS x, y FROM plain UNION ALL
    SELECT model_alias, task, task_type, seed, layer, feature || '|model_logratio', round(CASE WHEN z > 0 AND mid > 0 THEN ln(z / mid) END, 9), y
    FROM (SELECT *, median(z) OVER (PARTITION BY task, seed, feature, model_alias) AS mid FROM moved))"""
KEYS = "task, seed, feature"
PAIRS = f"""pairs AS (SELECT a.task, a.seed, a.feature, a.x - b.x AS ds, a.y - b.y AS du, a.model_alias = b.model_alias AS same
    FROM cand a JOIN cand b ON a.task = b.task AND a.seed = b.seed AND a.feature = b.feature AND a.candidate < b.candidate),
  preferred AS (SELECT {KEYS}, avg(ok) AS accuracy_all, avg(ok) FILTER (same) AS accuracy_within, avg(ok) FILTER (NOT same) AS accuracy_cross, count(*) AS n_pairs
    FROM (SELECT *, (sign(ds) = sign(du))::INT::DOUBLE AS ok FROM pairs WHERE abs(ds) > 1e-12 AND abs(du) > 1e-12) GROUP BY {KEYS})"""
ALIGNED = f"""{coefficients_sql('cand', KEYS, 'candidate', 'agreed')},
  measured AS (SELECT {KEYS}, {_metric_sql()} FROM placed GROUP BY {KEYS}),
  models AS (SELECT {KEYS}, max(task_type) AS task_type, count(*) AS n_candidates, count(DISTINCT model_alias) AS n_models FROM joined GROUP BY {KEYS}),
  aligned AS (SELECT * FROM models JOIN agreed USING ({KEYS}) JOIN measured USING ({KEYS}) LEFT JOIN preferred USING ({KEYS}))"""
NAMES = "split_part(feature, '|', 1) AS feature, split_part(feature, '|', 2) AS calibration"
ALL = ["pearson", "spearman", "kendall", "distance", "accuracy_all", "accuracy_within", "accuracy_cross", "regret_at_1", "selected_percentile",
       *[f"{m}_at_{k}" for m in ("ndcg", "topk_overlap") for k in (1, 3, 5)]]
CHAIN = (CALIBRATED, PLACED, PAIRS, ALIGNED)


def aligned(spark, sf_dir):
    c = candidates(spark, sf_dir)
    both = L.calibrated(c, ["task", "seed", "feature"], "model_alias", "x")
    both = settled(both.withColumn("score", F.when(F.col("calibration") == "raw", F.col("score")).otherwise(F.round("score", 9))))
    found = L.candidate_alignment(both, ["task", "seed", "feature", "calibration"], "score", "y", "model_alias", "candidate")
    return settled(found.join(both.select("task", "task_type").distinct(), "task"))


@query(sql(f"SELECT task, seed, {NAMES}, task_type, n_candidates, n_models, coalesce(n_pairs, 0) AS n_pairs, {r(*ALL, digits=6)} FROM aligned",
           "metrics_long", "scores_long", ctes=CHAIN), digits=6)
def h16_calibrated_alignment(spark, sf_dir):
    return aligned(spark, sf_dir).select("task", "seed", "feature", "calibration", "task_type", "n_candidates", "n_models", "n_pairs", *ALL)


#: Measures are rounded before they are averaged, and the averages to more digits, which have no ties.
OVER_SEEDS = f"nine AS (SELECT task, task_type, seed, feature, {r(*ALL[:7], digits=9)}, {', '.join(ALL[7:])} FROM aligned), " + "by_task AS (SELECT task, task_type, feature, count(DISTINCT seed) AS n_seeds, " + ", ".join(
    f"avg({m}) AS {m}, CASE WHEN count({m}) > 0 THEN coalesce(stddev_samp({m}), 0) END AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in ALL
) + " FROM nine GROUP BY task, task_type, feature)"


@query(sql(f"""SELECT task, task_type, {NAMES}, n_seeds, {r(*[x for m in ALL for x in (
    m, f'{m}_std AS {m}_seed_std', f'{m}_min AS {m}_seed_min', f'{m}_max AS {m}_seed_max')], digits=12)} FROM by_task""",
           "metrics_long", "scores_long", ctes=(*CHAIN, OVER_SEEDS)), digits=12)
def g10_alignment_by_task(spark, sf_dir):
    return L.seeds_within_tasks(rounded(aligned(spark, sf_dir), 9), ["feature", "calibration"], ALL)


@query(sql(f"""SELECT task_type, {NAMES}, count(DISTINCT task) AS n_tasks, {r(
    'avg(spearman) AS mean_spearman', 'stddev_samp(spearman) AS std_spearman', 'avg(spearman_std) AS mean_seed_std_spearman',
    'avg(accuracy_cross) AS mean_cross_model_preference', 'avg(regret_at_1) AS mean_regret_at_1', 'avg(topk_overlap_at_1) AS mean_top1_overlap',
    'avg(topk_overlap_at_3) AS mean_top3_overlap', digits=12)} FROM by_task GROUP BY task_type, feature""",
           "metrics_long", "scores_long", ctes=(*CHAIN, OVER_SEEDS)), digits=12)
def g10_alignment_by_family(spark, sf_dir):
    return L.family_alignment(L.seeds_within_tasks(rounded(aligned(spark, sf_dir), 9), ["feature", "calibration"], ALL), ["feature", "calibration"])


# contraction

MOMENTS = """shares AS (SELECT model_alias, task, layer, k, energy / sum(energy) OVER (PARTITION BY model_alias, task, layer) AS p FROM curves_long),
  centred AS (SELECT *, sum(k * p) OVER (PARTITION BY model_alias, task, layer) AS mu FROM shares),
  moments AS (SELECT model_alias, task, layer, max(mu) AS mean_mode, sqrt(sum(p * (k - mu) ** 2)) AS spread FROM centred GROUP BY ALL),
  binned AS (SELECT model_alias, task, depth_bin, (depth_bin + 0.5::DOUBLE) / 11 AS depth_center, avg(mean_mode) AS m, avg(spread) AS s
    FROM moments JOIN depth USING (model_alias, task, layer) GROUP BY ALL),
  based AS (SELECT *, avg(m) FILTER (depth_center <= 1.0::DOUBLE / 3) OVER (PARTITION BY model_alias, task) AS em,
    avg(s) FILTER (depth_center <= 1.0::DOUBLE / 3) OVER (PARTITION BY model_alias, task) AS es FROM binned),
  middles AS (SELECT model_alias, depth_center, median(round(100.0::DOUBLE * (m - em) / em, 9)) AS a, median(round(100.0::DOUBLE * (s - es) / es, 9)) AS b
    FROM based GROUP BY model_alias, depth_center),
  placed_bins AS (SELECT *, row_number() OVER w AS pos, depth_center - lag(depth_center) OVER w AS step
    FROM middles WINDOW w AS (PARTITION BY model_alias ORDER BY depth_center)),
  falling AS (SELECT *, pos - row_number() OVER (PARTITION BY model_alias ORDER BY pos) AS g FROM placed_bins WHERE a < 0 AND b < 0),
  runs AS (SELECT model_alias, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM falling GROUP BY model_alias, g
    QUALIFY row_number() OVER (PARTITION BY model_alias ORDER BY count(*) DESC, min(pos)) = 1),
  core AS (SELECT model_alias, start + (n >= 4)::INT AS f, stop - (n >= 4)::INT AS t FROM runs),
  half AS (SELECT model_alias, 0.5 * coalesce(median(step) FILTER (step > 0), 0.1) AS h FROM placed_bins GROUP BY model_alias)"""


@query(sql(f"""SELECT model_alias, {r('greatest(0, l.depth_center - h) AS lo', 'least(1, u.depth_center + h) AS hi')}
  FROM core JOIN half USING (model_alias) JOIN placed_bins l USING (model_alias) JOIN placed_bins u USING (model_alias) WHERE l.pos = f AND u.pos = t""",
           "curves_long", "scores_long", ctes=(DEPTH, MOMENTS)))
def h23_joint_contraction_span(spark, sf_dir):
    c = curves(spark, sf_dir)
    deep = H.relative_depth(c.select(*CANDIDATE).distinct(), CASE)
    binned = H.mode_moments(c, CANDIDATE).join(deep, CANDIDATE).withColumn("depth_center", (F.col("depth_bin") + 0.5) / 11)
    by_task = settled(binned.groupBy(*CASE, "depth_bin", "depth_center").agg(F.avg("mean_mode").alias("m"), F.avg("spread").alias("s")))
    change = lambda v: K.relative_change(by_task, v, tuple(CASE)).withColumn("relative_change_pct", F.round("relative_change_pct", 9))
    return H.joint_span(change("m"), change("s"), ["model_alias"], "depth_center", "relative_change_pct").withColumnsRenamed({"left": "lo", "right": "hi"})
