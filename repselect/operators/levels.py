"""Summary tables at every level: bandwidth curves, depth profiles, mass semantics, support, runtime totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repselect.operators.ranking import common_support, k_at_mass, mode_moments, relative_depth, support_audit


def bandwidth_tables(by_case: DataFrame, value: str = "spearman") -> dict[str, DataFrame]:
    """Curves over K from cases (``task_type, task, model_alias, seed, k``): models are averaged within task and seed, then
    tasks of equal weight within family and seed, or within seed, then seeds. The variance over seeds is null for one."""
    over_seeds = lambda df, keys: df.groupBy(*keys, "k").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("seed_variance"), F.count_distinct("seed").alias("n_seeds"))
    task_seed = by_case.groupBy("task_type", "task", "seed", "k").agg(F.avg(value).alias("v"), F.count_distinct("model_alias").alias("n_models"))
    means = lambda keys: task_seed.groupBy(*keys, "seed", "k").agg(F.avg("v").alias("v"), F.count_distinct("task").alias("n_tasks"))
    return {
        "task_seed": task_seed, "family_seed": means(["task_type"]), "family_curve": over_seeds(means(["task_type"]), ["task_type"]),
        "overall_curve": over_seeds(means([]), []), "task_curve": over_seeds(task_seed, ["task_type", "task"])}


def depth_candidates(curves: DataFrame, case: list[str]) -> DataFrame:
    """A row a candidate of mode curves (case, layer, ``task_type, k, energy, mass``): mean mode and spread, K90 and K95
    of its mass, relative depth, third and bin."""
    keys = [*case, "layer"]
    names = curves.select(*keys, "task_type").distinct()
    return relative_depth(mode_moments(curves, keys).join(k_at_mass(curves, keys), keys).join(names, keys), case)


def depth_levels(candidates: DataFrame, by: str) -> DataFrame:
    """Candidates -> task and ``by`` (a bin or a third) -> family and ``by``: mean mode, spread, tasks."""
    both = lambda: [F.avg(c).alias(c) for c in ("mean_mode", "spread")]
    task = candidates.groupBy("task_type", "task", by).agg(*both())
    return task.groupBy("task_type", by).agg(*both(), F.count_distinct("task").alias("n_tasks"))


def depth_heat(curves: DataFrame, candidates: DataFrame, case: list[str]) -> DataFrame:
    """Share of energy by family, depth bin and K, from candidates over tasks of equal weight."""
    keys = [*case, "layer"]
    total = curves.groupBy(*keys).agg(F.sum("energy").alias("_e"))
    rows = curves.join(total, keys).join(candidates.select(*keys, "depth_bin"), keys).withColumn("share", F.col("energy") / F.col("_e"))
    task = rows.groupBy("task_type", "task", "depth_bin", "k").agg(F.avg("share").alias("share"))
    return task.groupBy("task_type", "depth_bin", "k").agg(F.avg("share").alias("share"), F.count_distinct("task").alias("n_tasks"))


def depth_summary(candidates: DataFrame) -> DataFrame:
    """A row a family: tasks, candidates, mean mode and spread of each third (tasks of equal weight), and for K90 and
    K95 the share of candidates that reach it and their median."""
    regions = ("Early", "Middle", "Late")
    wide = depth_levels(candidates, "region").groupBy("task_type").agg(*[
        F.max(F.when(F.col("region") == x, F.col(c))).alias(f"{x.lower()}_{c}") for x in regions for c in ("mean_mode", "spread")])
    reach = [x for n in ("k90", "k95") for x in (F.avg(F.col(f"{n}_available").cast("double")).alias(f"{n}_availability"), F.median(F.when(F.col(f"{n}_available"), F.col(n))).alias(f"median_{n}"))]
    own = candidates.groupBy("task_type").agg(F.count_distinct("task").alias("n_tasks"), F.count("*").alias("n_candidates"), *reach)
    return own.join(wide, "task_type")


def mass_verdict(curves: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """One row: whether the masses of the candidates are cumulative, per mode or neither (``unavailable``), which the given
    share of them decides, with the shares. Cumulative: within [0, 1], never falling, 0.8 at the end; per mode: within
    [0, 1] and a sum of 0.9 to 1.1. Missing masses are left out."""
    known = curves.where(F.col("mass").isNotNull() & ~F.isnan("mass"))
    steps = F.array_sort(F.collect_list(F.struct("k", "mass")))  # a candidate has few K
    rows = known.groupBy(*keys).agg(steps.alias("_c"), F.sum("mass").alias("_sum"), F.min("mass").alias("_lo"), F.max("mass").alias("_hi"))
    mass = F.transform("_c", lambda s: s["mass"])
    falls = F.exists(F.zip_with(F.slice(mass, 2, F.size("_c")), F.slice(mass, 1, F.size("_c") - 1), lambda b, a: b - a), lambda d: d < -1e-8)
    within = (F.col("_lo") >= -1e-8) & (F.col("_hi") <= 1.0001)
    cumulative, per_mode = within & ~falls & (F.element_at(mass, -1) >= 0.8), within & F.col("_sum").between(0.9, 1.1)
    part = lambda c: F.avg(c.cast("double"))
    told = rows.agg(F.count("*").alias("n_candidates"), part(cumulative).alias("cumulative_share"), part(per_mode).alias("per_mode_share"))
    return told.withColumn("semantics", F.when(F.col("cumulative_share") >= share, "cumulative").when(F.col("per_mode_share") >= share, "per_mode").otherwise("unavailable"))


def support_retention(curves: DataFrame, case: list[str], fixed_k: int, min_layers: int = 3) -> DataFrame:
    """``support_audit`` with the shares of the cases and tasks that have enough layers at ``fixed_k``."""
    at = curves.where(F.col("k") == fixed_k).groupBy(*case).agg(F.count_distinct("layer").alias("n")).where(F.col("n") >= min_layers)
    whole = at.agg(F.count("*").alias("_cases"), F.count_distinct("task").alias("_tasks"))  # one row
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return support_audit(curves, case, min_layers).crossJoin(F.broadcast(whole)).select(
        "cutoff", "n_cases", "n_tasks", part("n_cases", "_cases").alias("case_retention"), part("n_tasks", "_tasks").alias("task_retention"))


def support_summary(curves: DataFrame, case: list[str], fixed_k: int, min_layers: int = 3) -> DataFrame:
    """One row: the largest K, how many K there are, cases and tasks at ``fixed_k`` and in the support common to all K,
    and the least and most layers of a case in it."""
    grid = curves.agg(F.max("k").alias("largest_k"), F.count_distinct("k").alias("n_k"))
    at = curves.where(F.col("k") == fixed_k).groupBy(*case).agg(F.count_distinct("layer").alias("n")).where(F.col("n") >= min_layers)
    fixed = at.agg(F.count("*").alias("eligible_cases"), F.count_distinct("task").alias("eligible_tasks"))
    kept = common_support(curves, case, min_layers).select(*case, "n_layers").distinct()
    left = kept.agg(F.count("*").alias("retained_cases"), F.count_distinct("task").alias("retained_tasks"), F.min("n_layers").alias("least_layers"), F.max("n_layers").alias("most_layers"))
    return grid.crossJoin(fixed).crossJoin(left)  # one row each


def runtime_totals(by_task: DataFrame) -> DataFrame:
    """One row from ``runtime_accounting``: sums over tasks, the ratio of sums and the tasks that break even."""
    sums = ("exhaustive_s", "screening_s", "shortlist_s", "hybrid_s")
    out = by_task.agg(F.count("*").alias("n_tasks"), F.sum("n_candidates").alias("n_candidates"), *[F.sum(c).alias(c) for c in sums], F.sum(F.col("break_even").cast("long")).alias("n_break_even"))
    return out.withColumn("speedup", F.col("exhaustive_s") / F.col("hybrid_s"))
