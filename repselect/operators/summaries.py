"""Aggregates of profiles, correlations and curves; every level is an equal-weight mean of the one below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from repselect.functions.scalars import number, t_975


def sample_aggs(value: str, name: str) -> list[Column]:
    """n, mean, variance (0 for one value), std, min, max, median of the finite values."""
    v = number(value)
    var = F.when(F.count(v) > 1, F.var_samp(v)).when(F.count(v) == 1, 0.0)
    return [F.count(v).alias("n"), F.avg(v).alias(f"{name}_mean"), var.alias(f"{name}_variance"), F.sqrt(var).alias(f"{name}_std"),
            F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), F.median(v).alias(f"{name}_median")]


def with_interval(df: DataFrame, name: str) -> DataFrame:
    """Standard error and 95 % t interval from ``n``, mean and std; one value has no width."""
    sem = F.col(f"{name}_std") / F.sqrt(F.col("n"))
    half = F.coalesce(t_975(F.col("n")) * sem, F.lit(0.0))
    return df.withColumn(f"{name}_sem", sem).withColumn("ci_low", F.col(f"{name}_mean") - half).withColumn("ci_high", F.col(f"{name}_mean") + half)


def sample_summary(df: DataFrame, keys: list[str], value: str, name: str = "score") -> DataFrame:
    return with_interval(df.groupBy(*keys).agg(*sample_aggs(value, name)), name)


def summarize_profiles(scores: DataFrame, keys: list[str], score: str = "primary_score", seed: str = "seed") -> DataFrame:
    """Seed summary of each layer; null keys are groups of their own."""
    own = scores.groupBy(*keys).agg(*sample_aggs(score, "score"), F.array_join(F.sort_array(F.collect_set(seed)), ",").alias("seeds"))
    return with_interval(own, "score").drop("score_median").withColumnRenamed("n", "n_seeds")


def final_vs_best(best: DataFrame, keys: list[str]) -> DataFrame:
    """Gain of the best over the final layer across seeds."""
    gain = number("gain")
    return best.groupBy(*keys).agg(
        F.count(gain).alias("n"), F.avg(gain).alias("gain_mean"), F.coalesce(F.var_samp(gain), F.lit(0.0)).alias("gain_variance"),
        F.min(gain).alias("gain_min"), F.max(gain).alias("gain_max"), F.avg((gain > 1e-12).cast("double")).alias("fraction_positive"))


def modal_layer(best: DataFrame, keys: list[str], layer: str = "best_layer") -> DataFrame:
    """Most frequent best layer (smallest of ties), how often, and the number of distinct ones."""
    counts = best.groupBy(*keys, layer).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(
        F.min_by(layer, F.struct(-F.col("c"), F.col(layer))).alias("modal_layer"), F.max("c").alias("modal_count"),
        (F.max("c") / F.sum("c")).alias("modal_fraction"), F.count("*").alias("n_unique"), F.sum("c").alias("n_seeds"))


def layer_selection_stability(best: DataFrame, keys: list[str]) -> DataFrame:
    stats = best.groupBy(*keys).agg(
        F.avg("best_layer").alias("layer_mean"), F.coalesce(F.var_samp("best_layer"), F.lit(0.0)).alias("layer_variance"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seed", "best_layer"))), lambda s: F.concat_ws(":", s["seed"], s["best_layer"])), ";").alias("by_seed"))
    return modal_layer(best, keys).join(stats, keys)


def best_layer_summary(profiles: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Best layer of the mean profile, its last layer, and how seeds agree."""
    means = profiles.groupBy(*keys).agg(
        F.min_by("layer", F.struct(-F.col("score_mean"), F.col("layer"))).alias("best_mean_layer"), F.max("score_mean").alias("best_mean_score"),
        F.max("layer").alias("final_layer"), F.max_by("score_mean", "layer").alias("final_mean_score"))
    return means.join(final_vs_best(best, keys).select(*keys, "gain_mean", "gain_variance"), keys).join(modal_layer(best, keys).drop("n_seeds"), keys)


def mean_of_means(df: DataFrame, value: str, levels: list[list[str]]) -> DataFrame:
    """Means by the first keys, then means of those by the next, and so on; missing values are left out."""
    out = df.withColumn("_v", number(value))
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg("_v").alias("_v"), F.count("_v").alias("n_valid"))
    return out.withColumnRenamed("_v", f"mean_{value}")


def correlation_seed_summary(corr: DataFrame, keys: list[str], coefficient: str) -> DataFrame:
    """Summary over seeds with the share of positive ones and their agreement in sign."""
    v = number(coefficient)
    up, down = F.avg((v >= 0).cast("double")), F.avg((v <= 0).cast("double"))
    return with_interval(corr.groupBy(*keys).agg(
        *sample_aggs(coefficient, coefficient), F.avg((v > 0).cast("double")).alias("positive_fraction"), F.greatest(up, down).alias("sign_consistency")), coefficient)


def quartile_cases(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles by linear interpolation."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *[F.percentile(value, p).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)], F.sum((F.col(value) > 0).cast("long")).alias("positive"))


def aggregate_bandwidth(by_case: DataFrame, value: str = "spearman") -> DataFrame:
    """Family curve over K: mean over models by task and seed, over tasks by seed, then over seeds."""
    task_seed = by_case.groupBy("task_type", "task", "seed", "k").agg(F.avg(value).alias("v"))
    family_seed = task_seed.groupBy("task_type", "seed", "k").agg(F.avg("v").alias("v"))
    return family_seed.groupBy("task_type", "k").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.count("v").alias("n_seeds"))


def depth_regions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean by third of depth, one column a region."""
    return df.groupBy(*keys).pivot("region", ["Early", "Middle", "Late"]).agg(F.avg(value))


def runtime_accounting(costs: DataFrame, shortlist: int = 5) -> DataFrame:
    """Seconds of evaluating all candidates of a task against scoring all and evaluating the top ones.

    ``costs``: task, candidate, score, screen_s, eval_s.
    """
    rank = F.row_number().over(Window.partitionBy("task").orderBy(F.col("score").desc(), "candidate"))
    top = F.col("rn") <= shortlist
    out = costs.withColumn("rn", rank).groupBy("task").agg(
        F.count("*").alias("n_candidates"), F.sum("eval_s").alias("exhaustive_s"), F.sum("screen_s").alias("screening_s"), F.sum(F.when(top, F.col("eval_s"))).alias("shortlist_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(top, F.struct("rn", "candidate")))), lambda s: s["candidate"]), ";").alias("shortlist"))
    return out.withColumn("hybrid_s", F.col("screening_s") + F.col("shortlist_s")).withColumn("speedup", F.col("exhaustive_s") / F.col("hybrid_s")).withColumn("break_even", F.col("hybrid_s") <= F.col("exhaustive_s"))


def loglog_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and R squared of ``ln y`` over ``ln x``."""
    lx, ly = F.ln(x), F.ln(y)
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_r2(ly, lx).alias("r2"), F.count("*").alias("n"))


def inventory(df: DataFrame, keys: list[str], candidate: list[str]) -> DataFrame:
    """Distinct candidates of each key."""
    return df.select(*keys, *candidate).distinct().groupBy(*keys).agg(F.count("*").alias("n_candidates"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by equal bins; the last one holds its upper bound."""
    width = (high - low) / bins
    return df.withColumn("bin", F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.count("*").alias("n"))
