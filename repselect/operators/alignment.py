"""How metric scores agree with utility: over a case's layers, and over all candidates of a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repselect.operators.ranking import model_logratio, preference_accuracy, ranking_metrics
from repselect.operators.statistics import correlations

COEFFICIENTS = ["pearson", "spearman", "kendall", "distance"]


def mean_curve_correlations(rows: DataFrame, case: list[str], x: str, y: str, layer: str = "layer", min_layers: int = 3) -> DataFrame:
    """Coefficients of each case over its layers, the utility ``y`` averaged over seeds at every layer first. ``rows``
    have one value of ``x`` a case and layer, repeated for each seed."""
    curve = rows.groupBy(*case, layer).agg(F.avg(y).alias("_y"), F.max(x).alias("_x"))
    return correlations(curve, case, "_x", "_y", min_layers)


def task_level(by_case: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Means of the coefficients by the first keys, then of those by the next, and so on, with ``n_valid_`` of the last
    step; missing values are left out."""
    out = by_case
    for keys in levels:
        out = out.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in COEFFICIENTS], *[F.count(c).alias(f"n_valid_{c}") for c in COEFFICIENTS])
    return out


def calibrated(rows: DataFrame, keys: list[str], model: str, value: str) -> DataFrame:
    """``rows`` twice, with ``calibration`` and ``score``: ``raw``, and ``model_logratio`` within each key."""
    raw = rows.withColumn("calibration", F.lit("raw")).withColumn("score", F.col(value))
    ratio = model_logratio(rows, keys, model, value).withColumn("calibration", F.lit("model_logratio")).withColumn("score", F.col("calibrated"))
    return raw.unionByName(ratio.select(raw.columns))


def candidate_alignment(rows: DataFrame, keys: list[str], score: str, utility: str, model: str, tie: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """All measures of each key's candidates: coefficients, preference accuracies, regret, percentile of the chosen
    one, NDCG and top-k overlap, with the number of candidates and models."""
    ranked = ranking_metrics(rows, keys, score, utility, tie, ks)
    names = ["n_candidates", "regret_at_1", "selected_percentile", *[f"{m}_at_{k}" for m in ("ndcg", "topk_overlap") for k in ks]]
    models = rows.groupBy(*keys).agg(F.count_distinct(model).alias("n_models"))
    out = ranked.select(*keys, *names).join(models, keys).join(correlations(rows, keys, score, utility).drop("n_layers"), keys)
    return out.join(preference_accuracy(rows, keys, score, utility, model).drop("half_accuracy"), keys)


def seeds_within_tasks(detail: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Mean, deviation, least and greatest value over seeds of each measure, by task and ``keys``."""
    std = lambda m: F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0)))
    return detail.groupBy("task", "task_type", *keys).agg(
        F.count_distinct("seed").alias("n_seeds"), *[x for m in measures for x in (F.avg(m).alias(m), std(m).alias(f"{m}_seed_std"), F.min(m).alias(f"{m}_seed_min"), F.max(m).alias(f"{m}_seed_max"))])


def family_alignment(by_task: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the tasks of a family, tasks of equal weight."""
    return by_task.groupBy("task_type", *keys).agg(
        F.count_distinct("task").alias("n_tasks"), F.avg("spearman").alias("mean_spearman"), F.stddev_samp("spearman").alias("std_spearman"), F.avg("spearman_seed_std").alias("mean_seed_std_spearman"),
        F.avg("accuracy_cross").alias("mean_cross_model_preference"), F.avg("regret_at_1").alias("mean_regret_at_1"), F.avg("topk_overlap_at_1").alias("mean_top1_overlap"), F.avg("topk_overlap_at_3").alias("mean_top3_overlap"))
