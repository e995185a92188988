"""Winners, ranks, top-k and regret measures over groups of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from repselect.functions.scalars import average_rank, finite, is_close
from repselect.operators.pairs import preference_parts


def best_layers_by_seed(scores: DataFrame, keys: list[str], score: str = "primary_score") -> DataFrame:
    """First layer that is close to the best, the last layer, and the gain between them."""
    top = F.max(score).over(Window.partitionBy(*keys))
    near = is_close(F.col(score), F.col("_top"))
    out = scores.withColumn("_top", top).groupBy(*keys).agg(
        F.min(F.when(near, F.col("layer"))).alias("best_layer"), F.max(score).alias("best_score"), F.max("layer").alias("final_layer"), F.max_by(score, "layer").alias("final_score"))
    return out.withColumn("gain", F.col("best_score") - F.col("final_score"))


def task_oracle(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Winner over models and layers; close scores go to the first model, then layer."""
    marked = scores.withColumn("_top", F.max(score).over(Window.partitionBy(*keys))).where(is_close(F.col(score), F.col("_top")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("model_alias", "layer"))
    return marked.withColumn("_rn", first).where("_rn = 1").drop("_top", "_rn")


def model_task_ranks(df: DataFrame, score: str = "score") -> DataFrame:
    """Average rank of models within a task, the best first, and min-max score (1 if flat)."""
    w = Window.partitionBy("task")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("rank", average_rank(["task"], score, True)).withColumn("minmax", F.when(high - low > 0, (F.col(score) - low) / (high - low)).otherwise(1.0))


def rank_summary(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("model_alias").agg(
        F.count("*").alias("n_tasks"), F.avg("rank").alias("rank_mean"), F.median("rank").alias("rank_median"), F.coalesce(F.var_samp("rank"), F.lit(0.0)).alias("rank_variance"),
        F.avg("minmax").alias("minmax_mean"), F.sum(is_close(F.col("rank"), F.lit(1.0)).cast("long")).alias("wins"))


def _placed(df: DataFrame, keys: list[str], score: str, utility: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.select(
        *keys, F.col(score).alias("s"), F.col(utility).alias("u"),
        F.row_number().over(w.orderBy(F.col(score).desc(), tie)).alias("by_s"), F.row_number().over(w.orderBy(F.col(utility).desc(), tie)).alias("by_u"),
        F.min(utility).over(w).alias("u_min"), F.max(utility).over(w).alias("u_max"), F.count("*").over(w).alias("n"), average_rank(keys, utility).alias("u_rank"))


def _dcg(gain: Column, place: str, k: int) -> Column:
    return F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1)))


def ranking_metrics(df: DataFrame, keys: list[str], score: str, utility: str, tie: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """NDCG (linear and exponential gain), top-k overlap, regret and hits of ranking ``utility`` by ``score``.

    Order among equal scores follows ``tie``. Linear NDCG is null for flat utilities or fewer than two
    rows; exponential NDCG is then 1.
    """
    p = _placed(df, keys, score, utility, tie)
    linear = F.col("u") - F.col("u_min")
    span = F.col("u_max") - F.col("u_min")
    gain = F.pow(F.lit(2.0), F.when(span > 0, linear / span).otherwise(0.0)) - 1
    chosen = F.max(F.when(F.col("by_s") == 1, F.col("u")))
    aggs = [F.count("*").alias("n_candidates"), F.first("u_max").alias("_max"), F.first("u_min").alias("_min"), chosen.alias("selected"),
            F.max(F.when(F.col("by_s") == 1, F.col("u_rank"))).alias("_rank")]
    for k in ks:
        aggs += [_dcg(linear, "by_s", k).alias(f"_l{k}"), _dcg(linear, "by_u", k).alias(f"_il{k}"), _dcg(gain, "by_s", k).alias(f"_e{k}"), _dcg(gain, "by_u", k).alias(f"_ie{k}"),
                 (F.sum(((F.col("by_s") <= k) & (F.col("by_u") <= k)).cast("double")) / F.lit(float(k))).alias(f"topk_overlap_at_{k}"), F.max(F.when(F.col("by_s") <= k, F.col("u"))).alias(f"_best{k}")]
    g = p.groupBy(*keys).agg(*aggs)
    span = F.col("_max") - F.col("_min")
    out = [*keys, "n_candidates", (F.col("_max") - F.col("selected")).alias("regret_at_1"), F.when(span > 0, (F.col("_max") - F.col("selected")) / span).otherwise(0.0).alias("scaled_regret_at_1"),
           ((F.col("_rank") - 1) / F.greatest(F.col("n_candidates") - 1, F.lit(1))).alias("selected_percentile"), (F.col("_max") - F.col("selected") <= 0.05 * span).alias("near_oracle")]
    for k in ks:
        out += [F.when((span > 0) & (F.col("n_candidates") > 1), F.col(f"_l{k}") / F.col(f"_il{k}")).alias(f"ndcg_at_{k}"), F.when(span > 0, F.col(f"_e{k}") / F.col(f"_ie{k}")).otherwise(1.0).alias(f"exp_ndcg_at_{k}"),
                f"topk_overlap_at_{k}", (F.col("_max") - F.col(f"_best{k}")).alias(f"coverage_regret_at_{k}")]
    return g.select(*out)


def preference_accuracy(df: DataFrame, keys: list[str], score: str, utility: str, model: str, eps: float = 1e-12) -> DataFrame:
    """Share of candidate pairs that score and utility order alike: all, within and across models; ties
    are left out. ``half_accuracy`` leaves out ties of utility only and counts ties of score half.

    Rows without a finite score and utility are left out; a null model is a model. Pairs are counted by sorting
    (``pairs``), so a group may be of any size; groups of one row have no pair and null shares.
    """
    rows = df.where(finite(score) & finite(utility)).select(*keys, F.col(model).alias("m"), F.col(score).cast("double").alias("s"), F.col(utility).cast("double").alias("u"))
    found = preference_parts(rows, keys, "s", "u", "m", eps)
    share = lambda a, b: F.when(b > 0, a / b)
    told, right, useful = F.col("told"), F.col("right"), F.col("useful")
    return found.select(
        *keys, share(right, told).alias("accuracy_all"), share(F.col("right_within"), F.col("told_within")).alias("accuracy_within"),
        share(right - F.col("right_within"), told - F.col("told_within")).alias("accuracy_cross"), told.alias("n_pairs"), share(right + (useful - told) * 0.5, useful).alias("half_accuracy"))


def model_logratio(df: DataFrame, group: list[str], model: str, value: str) -> DataFrame:
    """``calibrated``: log of each value over its model's median, shifted to be positive if need be."""
    w = group + [model]
    ends = df.groupBy(*w).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    shift = F.when(F.col("_lo") <= 0, -F.col("_lo") + F.greatest(F.col("_hi") - F.col("_lo"), F.abs("_lo"), F.abs("_hi"), F.lit(1.0)) * 1e-12).otherwise(0.0)
    moved = df.join(ends, w).withColumn("_x", F.col(value) + shift)
    mid = moved.groupBy(*w).agg(F.median("_x").alias("_mid"))
    return moved.join(mid, w).withColumn("calibrated", F.when((F.col("_x") > 0) & (F.col("_mid") > 0), F.ln(F.col("_x") / F.col("_mid")))).drop("_lo", "_hi", "_x", "_mid")


def relative_depth(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of a layer among its model's layers, 0 to 1; 0.5 for a single layer. Adds third and bin."""
    layers = df.select(*keys, "layer").distinct()
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    layers = layers.withColumn("depth", F.when(n > 1, (F.row_number().over(w.orderBy("layer")) - 1) / (n - 1)).otherwise(0.5))
    region = F.when(F.col("depth") < 1 / 3, "Early").when(F.col("depth") <= 2 / 3, "Middle").otherwise("Late")
    return df.join(layers.withColumn("region", region).withColumn("depth_bin", F.greatest(F.ceil(F.round(F.col("depth") * 11, 9)) - 1, F.lit(0)).cast("int")), [*keys, "layer"])


def mode_moments(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Energy shares over modes: mean mode and spread, in two passes."""
    w = Window.partitionBy(*keys)
    shared = curves.withColumn("_p", F.col("energy") / F.sum("energy").over(w)).withColumn("_mu", F.sum(F.col("k") * F.col("_p")).over(w))
    return shared.groupBy(*keys).agg(F.sum(F.col("k") * F.col("_p")).alias("mean_mode"), F.sqrt(F.sum(F.col("_p") * F.pow(F.col("k") - F.col("_mu"), 2))).alias("spread"), F.max("_p").alias("top_share"))


def mass_semantics(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each curve's mass is a cumulative share: within [0, 1], never falling, and 0.8 at its end."""
    w = Window.partitionBy(*keys).orderBy("k")
    steps = curves.withColumn("_d", F.col("mass") - F.lag("mass").over(w))
    return steps.groupBy(*keys).agg(
        (F.min("mass") >= -1e-9).alias("not_negative"), (F.max("mass") <= 1 + 1e-9).alias("at_most_one"), F.coalesce(F.min("_d") >= -1e-9, F.lit(True)).alias("monotone"),
        (F.max_by("mass", "k") >= 0.8).alias("full")).withColumn("cumulative", F.col("not_negative") & F.col("at_most_one") & F.col("monotone") & F.col("full"))


def k_at_mass(curves: DataFrame, keys: list[str], shares: tuple[int, ...] = (90, 95)) -> DataFrame:
    """First K whose cumulative mass reaches each share, and whether there is one."""
    first = {s: F.min(F.when(F.col("mass") >= s / 100, F.col("k"))) for s in shares}
    return curves.groupBy(*keys).agg(*[x for s in shares for x in (first[s].alias(f"k{s}"), first[s].isNotNull().alias(f"k{s}_available"))])


def best_bandwidth(curve: DataFrame, keys: list[str], value: str, fixed: int = 10) -> DataFrame:
    """Value at a fixed K, the best K (first of ties) and the gap."""
    best = curve.groupBy(*keys).agg(F.max_by("k", F.struct(F.col(value), -F.col("k"))).alias("best_k"), F.max(value).alias("best_value"), F.max(F.when(F.col("k") == fixed, F.col(value))).alias("fixed_value"))
    return best.withColumn("gap", F.col("best_value") - F.col("fixed_value"))


def longest_run(df: DataFrame, keys: list[str], position: str, flag: Column) -> DataFrame:
    """Longest run of consecutive positions at which ``flag`` holds (the first of equals)."""
    on = df.where(flag).withColumn("_g", F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position)))
    runs = on.groupBy(*keys, "_g").agg(F.min(position).alias("start"), F.max(position).alias("stop"), F.count("*").alias("length"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("start", "stop", "length"), F.struct(F.col("length"), -F.col("start"))).alias("r")).select(*keys, "r.*")


def joint_span(means: DataFrame, spreads: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """``left, right`` of each key: the core of the longest run of positions (the first of equals) at which the medians
    of ``value`` are below zero in both tables. Runs of four or more lose a position on either side; half the median
    step is added to the ends, within 0 and 1. A key without such a run has no row. Positions are few: depth bins.
    """
    middle = lambda df, name: df.groupBy(*keys, position).agg(F.median(value).alias(name))
    order = Window.partitionBy(*keys).orderBy(position)
    both = middle(means, "_a").join(middle(spreads, "_b"), [*keys, position])
    steps = both.withColumn("_at", F.row_number().over(order)).withColumn("_step", F.col(position) - F.lag(position).over(order))
    half = steps.groupBy(*keys).agg((0.5 * F.coalesce(F.median(F.when(F.col("_step") > 0, F.col("_step"))), F.lit(0.1))).alias("_half"))
    runs = longest_run(steps, keys, "_at", (F.col("_a") < 0) & (F.col("_b") < 0))
    trim = (F.col("length") >= 4).cast("int")
    core = runs.select(*keys, (F.col("start") + trim).alias("_from"), (F.col("stop") - trim).alias("_to"))
    inside = steps.join(core, keys).where((F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to")))
    ends = inside.groupBy(*keys).agg(F.min(position).alias("_l"), F.max(position).alias("_r")).join(half, keys)
    return ends.select(*keys, F.greatest(F.lit(0.0), F.col("_l") - F.col("_half")).alias("left"), F.least(F.lit(1.0), F.col("_r") + F.col("_half")).alias("right"))


def shortlist(df: DataFrame, keys: list[str], score: str, tie: str, s: int = 5) -> DataFrame:
    """The ``s`` best candidates of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie))).where(F.col("place") <= s)


def common_support(curves: DataFrame, case: list[str], min_layers: int = 3) -> DataFrame:
    """Layers of each case present for every K of all, for cases with enough of them."""
    n = curves.select("k").distinct().agg(F.count("*").alias("_all"))  # one row
    full = curves.groupBy(*case, "layer").agg(F.count_distinct("k").alias("_k")).join(F.broadcast(n)).where("_k = _all").select(*case, "layer")
    return full.withColumn("n_layers", F.count("*").over(Window.partitionBy(*case))).where(F.col("n_layers") >= min_layers)


def support_audit(curves: DataFrame, case: list[str], min_layers: int = 3) -> DataFrame:
    """For each cutoff K the cases and tasks with enough layers present for all K up to it, in one pass."""
    w = Window.partitionBy(*case, "layer").orderBy("k")
    ks = curves.select(*case, "layer", "k").distinct().withColumn("_rn", F.row_number().over(w))
    reach = ks.groupBy(*case, "layer").agg(F.coalesce(F.max(F.when(F.col("k") == F.col("_rn"), F.col("k"))), F.lit(0)).alias("reach"))
    place = F.row_number().over(Window.partitionBy(*case).orderBy(F.col("reach").desc(), "layer"))
    cases = reach.withColumn("_p", place).where(F.col("_p") == min_layers).select(*case, F.col("reach").alias("upto"))
    cutoffs = curves.select(F.col("k").alias("cutoff")).distinct()
    held = cases.where("upto > 0").select(*case, F.explode(F.sequence(F.lit(1), F.col("upto").cast("int"))).alias("cutoff"))
    got = held.groupBy("cutoff").agg(F.count("*").alias("n_cases"), F.count_distinct("task").alias("n_tasks"))
    return cutoffs.join(got, "cutoff", "left").select("cutoff", F.coalesce("n_cases", F.lit(0)).alias("n_cases"), F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"))
