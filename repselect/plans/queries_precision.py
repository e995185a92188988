"""Registered queries of the adaptive-precision study, from views to verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from repselect.operators import precision as P, study as K
from repselect.plans.queries import U, curves, query, r, rank_sql, scores
from repselect.plans.queries_tables import sql
from repselect.session import settled

FRACTIONS, VIEWS, SHUFFLES, DRAWS, SEED, TOP = (0.25, 0.5, 1.0), 12, 10, 200, 17, 5

PARTED = f"""parted AS (SELECT fraction, task, model_alias, layer, k, energy, mass, k <= round(fraction * {VIEWS}) AS calibration
  FROM curves_long, (SELECT unnest([{', '.join(map(str, FRACTIONS))}]::DOUBLE[]) AS fraction))"""
KEYS = "fraction, task, model_alias, layer"
VARIANCES = f"""logs AS (SELECT {KEYS}, calibration,
    ln(1 + energy / median(CASE WHEN energy > 0 THEN energy END) OVER (PARTITION BY {KEYS}, calibration)) AS x FROM parted),
  lev AS (SELECT {KEYS}, calibration, coalesce(0.5 * max(v) + 0.5 * (1.4826 * median(abs(x - m))) ** 2, 0) AS lev
    FROM (SELECT *, median(x) OVER w AS m, var_samp(x) OVER w AS v FROM logs WINDOW w AS (PARTITION BY {KEYS}, calibration))
    GROUP BY {KEYS}, calibration),
  est AS (SELECT a.fraction, a.task, a.model_alias, a.layer, a.lev AS log_energy_variance, b.lev AS heldout_variance,
      median(a.lev) OVER (PARTITION BY a.fraction, a.task) AS mid, round(a.fraction * {VIEWS}) / (round(a.fraction * {VIEWS}) + 5) AS w
    FROM lev a LEFT JOIN lev b ON NOT b.calibration AND a.fraction = b.fraction AND a.task = b.task AND a.model_alias = b.model_alias
      AND a.layer = b.layer WHERE a.calibration),
  uncertain AS (SELECT {KEYS}, log_energy_variance, heldout_variance,
    CASE WHEN fraction = 1 OR mid <= 0 THEN 0 ELSE (w * log_energy_variance + (1 - w) * mid) / mid END AS uncertainty FROM est)"""
SCORED = f"""base AS (SELECT fraction, task, model_alias, layer, a, c, uncertainty,
    row_number() OVER (PARTITION BY fraction, task, model_alias ORDER BY layer) AS rn FROM uncertain
    JOIN (SELECT {KEYS}, sum(energy) AS a, sum(energy * mass) AS c FROM parted WHERE calibration GROUP BY {KEYS}) USING ({KEYS})),
  dealt AS (SELECT fraction, task, model_alias, shuffle, uncertainty, row_number() OVER (
    PARTITION BY fraction, task, model_alias, shuffle ORDER BY {U.format('layer, shuffle')}, layer) AS rn
    FROM base, (SELECT unnest(range({SHUFFLES})) AS shuffle)),
  scored AS (SELECT {KEYS}, method, shuffle, round(ln(1 + greatest(s, 0)), 9) AS score FROM (
    SELECT {KEYS}, 'adaptive_precision' AS method, -1 AS shuffle, a / (1 + uncertainty) + c AS s FROM base UNION ALL
    SELECT {KEYS}, 'fixed_precision', -1, a + c FROM base UNION ALL
    SELECT {KEYS}, 'no_precision', -1, c FROM base UNION ALL
    SELECT b.fraction, b.task, b.model_alias, b.layer, 'shuffled_precision', d.shuffle, b.a / (1 + d.uncertainty) + b.c
    FROM base b JOIN dealt d ON b.fraction = d.fraction AND b.task = d.task AND b.model_alias = d.model_alias AND b.rn = d.rn))"""
GROUP = "fraction, task, method, shuffle"
OUTCOMES = f"""utility AS (SELECT task, model_alias, layer, round(avg(primary_score), 9) AS u FROM scores_long GROUP BY ALL),
  ranked AS (SELECT {GROUP}, score, u, row_number() OVER (PARTITION BY {GROUP} ORDER BY score DESC, model_alias || '::L' || layer) AS bs,
      row_number() OVER (PARTITION BY {GROUP} ORDER BY u DESC, model_alias || '::L' || layer) AS bu,
      min(u) OVER (PARTITION BY {GROUP}) AS lo, max(u) OVER (PARTITION BY {GROUP}) AS hi,
      ({rank_sql('score', GROUP)})::DOUBLE AS rs, ({rank_sql('u', GROUP)})::DOUBLE AS ru FROM scored JOIN utility USING (task, model_alias, layer)),
  gains AS (SELECT *, 2.0::DOUBLE ** (CASE WHEN hi > lo THEN (u - lo) / (hi - lo) ELSE 0 END) - 1 AS g FROM ranked),
  single AS (SELECT {GROUP},
      CASE WHEN max(hi) > max(lo) THEN sum(g / log2(bs + 1)) FILTER (bs <= {TOP}) / sum(g / log2(bu + 1)) FILTER (bu <= {TOP}) ELSE 1 END AS ndcg,
      CASE WHEN count(*) >= 3 AND count(DISTINCT score) >= 2 AND count(DISTINCT u) >= 2 THEN corr(rs, ru) END AS spearman FROM gains GROUP BY {GROUP}),
  outcomes AS (SELECT fraction, task, method, outcome, round(avg(v), 12) AS value FROM (
    SELECT {GROUP}, 'ndcg_at_k' AS outcome, ndcg AS v FROM single UNION ALL SELECT {GROUP}, 'utility_spearman', spearman FROM single) GROUP BY ALL)"""


def bootstrap_sql(name: str, source: str, keys: str, value: str) -> str:
    """CTEs that end in ``name``: keys, n, mean, ci_low, ci_high of ``source``, as ``bootstrap_mean`` draws them."""
    return f"""{name}_rows AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS rn,
      count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE {value} IS NOT NULL),
  {name}_drawn AS (SELECT s.*, b, i, floor({U.format(f'{SEED}, b, i')} * n)::BIGINT AS rn FROM (SELECT DISTINCT {keys}, n FROM {name}_rows) s,
      (SELECT unnest(range({DRAWS})) AS b), LATERAL (SELECT unnest(range(n)) AS i)),
  {name}_means AS (SELECT {keys}, b, avg(v) AS m FROM {name}_drawn JOIN {name}_rows USING ({keys}, rn) GROUP BY {keys}, b),
  {name} AS (SELECT {keys}, n, mean, ci_low, ci_high FROM (SELECT {keys}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high
      FROM {name}_means GROUP BY {keys}) JOIN (SELECT {keys}, max(n) AS n, avg(v) AS mean FROM {name}_rows GROUP BY {keys}) USING ({keys}))"""


TEST = "fraction, outcome, baseline"
TESTS = f"""d AS (SELECT o.fraction, o.outcome, o.method AS baseline, o.task, round(p.value - o.value, 9) AS d FROM outcomes o
    JOIN outcomes p ON p.fraction = o.fraction AND p.outcome = o.outcome AND p.task = o.task AND p.method = 'adaptive_precision'
    WHERE o.method <> 'adaptive_precision'),
  {bootstrap_sql('boot', 'd', TEST, 'd')},
  flips AS (SELECT {TEST}, round(avg((abs(s / n) >= abs(t / n) - 1e-12)::INT), 9) AS p FROM (SELECT {TEST}, n, list_sum(d) AS t,
      list_sum(list_transform(list_zip(d, range(n)), lambda x: CASE WHEN (mask >> x[2]::INT) & 1 = 0 THEN x[1] ELSE -x[1] END)) AS s
    FROM (SELECT *, unnest(range((1 << n)))::BIGINT AS mask FROM (
      SELECT {TEST}, list_sort(list(d)) AS d, count(*)::INT AS n FROM d WHERE d IS NOT NULL GROUP BY ALL))) GROUP BY ALL),
  stepped AS (SELECT *, p * (count(*) OVER (PARTITION BY fraction, outcome) + 1
      - row_number() OVER (PARTITION BY fraction, outcome ORDER BY p, baseline)) AS s FROM boot JOIN flips USING ({TEST})),
  tests AS (SELECT {TEST}, n AS n_tasks, mean AS mean_advantage, ci_low, ci_high, p,
    least(1, max(s) OVER (PARTITION BY fraction, outcome ORDER BY p, baseline ROWS UNBOUNDED PRECEDING)) AS p_holm FROM stepped)"""
VALIDITY = f"""vr AS (SELECT fraction, task, round(log_energy_variance, 9) AS e, round(heldout_variance, 9) AS h FROM uncertain
    WHERE fraction < 1 AND heldout_variance IS NOT NULL AND log_energy_variance IS NOT NULL),
  vk AS (SELECT *, ({rank_sql('e', 'fraction, task')})::DOUBLE AS a, ({rank_sql('h', 'fraction, task')})::DOUBLE AS b FROM vr),
  valid AS (SELECT fraction, task, count(*) AS n,
    CASE WHEN count(*) >= 3 AND count(DISTINCT e) >= 2 AND count(DISTINCT h) >= 2 THEN corr(a, b) END AS spearman FROM vk GROUP BY fraction, task),
  {bootstrap_sql('vboot', '(SELECT fraction, round(spearman, 9) AS s FROM valid)', 'fraction', 's')}"""
CONTROL = """macro AS (SELECT method, outcome, avg(value) AS v FROM outcomes WHERE fraction = 1 GROUP BY ALL),
  control AS (SELECT outcome, max(v) FILTER (method = 'adaptive_precision') AS adaptive_value, max(v) FILTER (method = 'fixed_precision') AS fixed_value
    FROM macro GROUP BY outcome)"""
CHAIN = (PARTED, VARIANCES, SCORED, OUTCOMES)


def parted(spark, sf_dir):
    return P.by_fraction(curves(spark, sf_dir), FRACTIONS, VIEWS)


def uncertain(spark, sf_dir):
    return P.fraction_uncertainty(parted(spark, sf_dir), VIEWS)


def outcomes(spark, sf_dir):
    scored = P.study_scores(parted(spark, sf_dir), settled(uncertain(spark, sf_dir)), SHUFFLES)
    utility = scores(spark, sf_dir).groupBy(*P.CANDIDATE).agg(F.round(F.avg("primary_score"), 9).alias("u"))
    return settled(P.study_outcomes(scored, utility, TOP))


def control(found):
    return K.negative_control(P.control_summary(found), "method", P.PRIMARY, "fixed_precision", list(P.OUTCOMES))


@query(sql(f"SELECT {KEYS}, {r('log_energy_variance', 'heldout_variance', 'uncertainty', digits=8)} FROM uncertain", "curves_long",
           ctes=(PARTED, VARIANCES)), digits=8)
def i12_uncertainty_by_fraction(spark, sf_dir):
    return uncertain(spark, sf_dir)


@query(sql(f"SELECT fraction, task, method, outcome, {r('value', digits=8)} FROM outcomes", "curves_long", "scores_long", ctes=CHAIN), digits=8)
def i13_method_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir)


@query(sql(f"SELECT {TEST}, n_tasks, {r('mean_advantage', 'ci_low', 'ci_high', 'p', 'p_holm', digits=7)} FROM tests", "curves_long", "scores_long",
           ctes=(*CHAIN, TESTS)), digits=7)
def i10_precision_tests(spark, sf_dir):
    return P.study_tests(outcomes(spark, sf_dir), DRAWS, SEED)


@query(sql(f"SELECT fraction, n AS n_tasks, {r('mean AS mean_correlation', 'ci_low', 'ci_high', digits=7)} FROM vboot", "curves_long",
           ctes=(PARTED, VARIANCES, VALIDITY)), digits=7)
def g20_validity_by_fraction(spark, sf_dir):
    return P.validity_tests(P.study_validity(uncertain(spark, sf_dir)), DRAWS, SEED)


@query(sql(f"""SELECT outcome, {r('adaptive_value', 'fixed_value', 'abs(adaptive_value - fixed_value) AS absolute_difference')},
  abs(adaptive_value - fixed_value) <= 1e-10 AS passed FROM control""", "curves_long", "scores_long", ctes=(*CHAIN, CONTROL)))
def i15_negative_control(spark, sf_dir):
    return control(outcomes(spark, sf_dir))


GAINED = "mean_advantage > 0 AND ci_low > 0 AND p_holm < 0.05"


@query(sql(f"""SELECT *, uncertainty_validated AND low_sample_utility AND ndcg_gain AND not_inferior AND control_passed AS supported FROM (SELECT
  (SELECT bool_and(mean > 0 AND ci_low > 0) FROM vboot) AS uncertainty_validated,
  (SELECT bool_and({GAINED}) FROM tests WHERE fraction = {min(FRACTIONS)} AND outcome = 'utility_spearman' AND baseline <> 'no_precision') AS low_sample_utility,
  (SELECT bool_or(g) FROM (SELECT bool_and({GAINED}) AS g FROM tests WHERE fraction < 1 AND outcome = 'ndcg_at_k' GROUP BY fraction)) AS ndcg_gain,
  (SELECT bool_and(ci_low > -0.02) FROM tests WHERE fraction < 1 AND baseline = 'no_precision') AS not_inferior,
  (SELECT bool_and(abs(adaptive_value - fixed_value) <= 1e-10) FROM control) AS control_passed)""",
           "curves_long", "scores_long", ctes=(*CHAIN, TESTS, VALIDITY, CONTROL)))
def i16_verdict(spark, sf_dir):
    found = outcomes(spark, sf_dir)
    valid = P.validity_tests(P.study_validity(uncertain(spark, sf_dir)), DRAWS, SEED)
    return K.verdict(settled(P.study_tests(found, DRAWS, SEED)), valid, control(found))
