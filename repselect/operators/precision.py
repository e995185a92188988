"""The adaptive-precision study: does an estimate of uncertainty from part of the views help to rank candidates?

A fraction of each candidate's views calibrates an uncertainty, the others are held out to judge it. Scores with
adaptive, fixed, no and shuffled precision rank the candidates of a task; paired tests over tasks compare them, and a
verdict joins the rules. With all views there is no sampling uncertainty, so adaptive and fixed must agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repselect.functions.scalars import finite
from repselect.operators.ranking import ranking_metrics
from repselect.operators.statistics import bootstrap_mean, holm, precision_scores, robust_variance, safe_spearman, shuffled, sign_flip

CANDIDATE = ["task", "model_alias", "layer"]
METHODS = {"adaptive_precision": "adaptive_score", "fixed_precision": "fixed_score", "no_precision": "no_precision_score", "shuffled_precision": "shuffled_score"}
PRIMARY = "adaptive_precision"
BASELINES = ("fixed_precision", "shuffled_precision", "no_precision")
OUTCOMES = ("utility_spearman", "ndcg_at_k")


def by_fraction(views: DataFrame, fractions: tuple[float, ...], n_views: int, view: str = "k") -> DataFrame:
    """``views`` (numbered from 1 in ``view``) once a fraction, with ``calibration``: whether it is among the first
    ``fraction * n_views``."""
    grid = views.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    return grid.withColumn("calibration", F.col(view) <= F.round(F.col("fraction") * n_views))


def fraction_uncertainty(parted: DataFrame, n_views: int, value: str = "energy") -> DataFrame:
    """``fraction``, candidate, ``log_energy_variance``, ``heldout_variance`` and ``uncertainty``.

    Robust log variances of the calibration and the held-out views; the former are shrunk to their task's median with
    weight ``v / (v + 5)`` for ``v`` calibration views and divided by it. At fraction 1 the uncertainty is 0 and
    nothing is held out.
    """
    keys = ["fraction", *CANDIDATE]
    sides = [robust_variance(parted.where(F.col("calibration") == side), keys, value).withColumnRenamed("log_energy_variance", name)
             for side, name in ((True, "log_energy_variance"), (False, "heldout_variance"))]
    mid = sides[0].groupBy("fraction", "task").agg(F.median("log_energy_variance").alias("_m"))
    v = F.round(F.col("fraction") * n_views)
    w = v / (v + 5.0)
    own = F.when(F.col("fraction") >= 1 - 1e-12, 0.0).when(F.col("_m") > 0, (w * F.col("log_energy_variance") + (1 - w) * F.col("_m")) / F.col("_m")).otherwise(0.0)
    both = sides[0].join(sides[1], keys, "left").join(mid, ["fraction", "task"])
    return both.withColumn("uncertainty", own).drop("_m")


def study_scores(parted: DataFrame, uncertain: DataFrame, shuffles: int) -> DataFrame:
    """``fraction``, candidate, ``method``, ``shuffle``, ``score``, from the energies of the calibration views.

    Shuffled precision deals the uncertainties of a model's layers to one another, ``shuffles`` times; other
    methods have shuffle -1.
    """
    keys = ["fraction", *CANDIDATE]
    energies = parted.where("calibration").groupBy(*keys).agg(F.sum("energy").alias("a"), F.sum(F.col("energy") * F.col("mass")).alias("c"))
    rows = energies.join(uncertain.select(*keys, "uncertainty"), keys)
    dealt = shuffled(rows, ["fraction", "task", "model_alias"], "uncertainty", shuffles).select(*keys, "shuffle", "a", "c", F.col("shuffled_uncertainty").alias("uncertainty"))
    plain = precision_scores(rows).withColumn("shuffle", F.lit(-1))
    melted = [plain.select(*keys, F.lit(m).alias("method"), "shuffle", F.col(METHODS[m]).alias("score")) for m in METHODS if m != "shuffled_precision"]
    melted.append(precision_scores(dealt).select(*keys, F.lit("shuffled_precision").alias("method"), "shuffle", F.col("adaptive_score").alias("score")))
    out = melted[0]
    for one in melted[1:]:
        out = out.unionByName(one)
    return out.withColumn("score", F.round("score", 9))


def study_outcomes(scored: DataFrame, utility: DataFrame, k: int = 5) -> DataFrame:
    """``fraction, task, method, outcome, value``: Spearman with the utility ``u`` of the candidates and NDCG of the
    first ``k``, averaged over shuffles."""
    keys = ["fraction", "task", "method", "shuffle"]
    rows = scored.join(utility, CANDIDATE).withColumn("candidate", F.concat_ws("::L", "model_alias", "layer"))
    ndcg = ranking_metrics(rows, keys, "score", "u", "candidate", (k,)).select(*keys, F.lit("ndcg_at_k").alias("outcome"), F.col(f"exp_ndcg_at_{k}").alias("value"))
    rank = safe_spearman(rows, keys, "score", "u").select(*keys, F.lit("utility_spearman").alias("outcome"), F.col("spearman").alias("value"))
    return ndcg.unionByName(rank).groupBy("fraction", "task", "method", "outcome").agg(F.round(F.avg("value"), 12).alias("value"))


def study_tests(outcomes: DataFrame, draws: int = 1000, seed: int = 0, primary: str = PRIMARY, baselines: tuple[str, ...] = BASELINES, max_exact: int = 20) -> DataFrame:
    """Paired over tasks, ``primary`` less each baseline by fraction and outcome: ``n_tasks``, ``mean_advantage`` with
    its bootstrap interval, exact sign-flip ``p`` and ``p_holm`` among the baselines."""
    keys = ["fraction", "outcome", "baseline"]
    own = outcomes.where(F.col("method") == primary).select("fraction", "outcome", "task", F.col("value").alias("_own"))
    other = outcomes.where(F.col("method").isin(*baselines)).withColumnRenamed("method", "baseline")
    d = other.join(own, ["fraction", "outcome", "task"]).withColumn("d", F.round(F.col("_own") - F.col("value"), 9)).where(finite("d"))
    told = bootstrap_mean(d, keys, "d", draws, seed).join(sign_flip(d, keys, "d", max_exact=max_exact).select(*keys, "p"), keys)
    named = told.select(*keys, F.col("n").alias("n_tasks"), F.col("mean").alias("mean_advantage"), "ci_low", "ci_high", F.round("p", 9).alias("p"))
    return holm(named, ["fraction", "outcome"])


def study_validity(uncertain: DataFrame) -> DataFrame:
    """``fraction, task, spearman, n``: of estimated with held-out variances over a task's candidates, below fraction 1."""
    rounded = [F.round(c, 9).alias(c) for c in ("log_energy_variance", "heldout_variance")]
    return safe_spearman(uncertain.where(F.col("fraction") < 1 - 1e-12).select("fraction", "task", *rounded), ["fraction", "task"], "log_energy_variance", "heldout_variance")


def validity_tests(validities: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """``fraction, n_tasks, mean_correlation, ci_low, ci_high`` over tasks."""
    told = bootstrap_mean(validities.withColumn("spearman", F.round("spearman", 9)), ["fraction"], "spearman", draws, seed)
    return told.select("fraction", F.col("n").alias("n_tasks"), F.col("mean").alias("mean_correlation"), "ci_low", "ci_high")


def control_summary(outcomes: DataFrame) -> DataFrame:
    """``method, mean_<outcome>`` over tasks at fraction 1, where adaptive and fixed must agree."""
    full = outcomes.where(F.col("fraction") >= 1 - 1e-12)
    return full.groupBy("method").agg(*[F.avg(F.when(F.col("outcome") == o, F.col("value"))).alias(f"mean_{o}") for o in OUTCOMES])
