"""Inputs of a study (targets, caches, matched joins) and its outcome: macro means, controls and a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from repselect.functions.scalars import EPS, is_close, number
from repselect.operators.statistics import safe_spearman, view_stability
from repselect.operators.summaries import sample_aggs, with_interval


def unique_targets(targets: DataFrame, keys: list[str], source: str, name: str, value: str = "target_value") -> DataFrame:
    """``keys, value`` of one target by its source and name.

    Rows of ``gap_regime`` ``all`` go first where that column has such rows at all. A key whose values lie
    more than 1e-12 apart raises an error when it is read.
    """
    rows = targets.where((F.col("target_source") == source) & (F.col("target_name") == name))
    if "gap_regime" in rows.columns and not rows.where("gap_regime = 'all'").isEmpty():
        rows = rows.where("gap_regime = 'all'")
    one = F.when(F.max(value) - F.min(value) > 1e-12, F.raise_error(F.lit("targets of one key differ")).cast("double")).otherwise(F.min(value))
    return rows.groupBy(*keys).agg(one.alias(value))


def collapse(df: DataFrame, keys: list[str], means: list[str], largest: list[str] = (), energy: str | None = None) -> DataFrame:
    """One row a key: means, and the largest value of ``largest``; a negative ``energy`` raises an error."""
    if energy:
        df = df.withColumn(energy, F.when(F.col(energy) < 0, F.raise_error(F.lit("negative energy")).cast("double")).otherwise(F.col(energy)))
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], *[F.max(c).alias(c) for c in largest])


def task_cache(sample: DataFrame, keys: list[str], text: str, label: str | None, least_items: int = 10, least_pairs: int = 3) -> DataFrame:
    """``n_items, n_classes, status`` of sampled items, after those without text or label are left out.

    ``status`` is ``warning`` below ``least_items`` items or two classes; without ``label`` (pairs) below
    ``least_pairs`` items. Keys whose items are all left out stay, with none.
    """
    usable = F.col(text).isNotNull() & (F.col(label).isNotNull() if label else F.lit(True))
    n = F.sum(usable.cast("long"))
    classes = F.count_distinct(F.when(usable, F.col(label))) if label else F.lit(None).cast("long")
    out = sample.groupBy(*keys).agg(n.alias("n_items"), classes.alias("n_classes"))
    few = (F.col("n_items") < least_items) | (F.col("n_classes") < 2) if label else F.col("n_items") < least_pairs
    return out.withColumn("status", F.when(few, "warning").otherwise("ok"))


def matched_join(left: DataFrame, right: DataFrame, keys: list[str], optional: str = "sample_hash") -> DataFrame:
    """Inner many-to-one join; ``optional`` is a key too if both sides have values of it.

    A key that stands twice on the right raises an error. Rows of the right with a null key match nothing.
    """
    known = lambda df: optional in df.columns and not df.where(F.col(optional).isNotNull()).isEmpty()
    on = [*keys, optional] if known(left) and known(right) else keys
    if not right.groupBy(*on).count().where(F.col("count") > 1).isEmpty():
        raise ValueError("keys repeat on the side that must be unique")
    if on == keys and optional in left.columns and optional in right.columns:
        right = right.drop(optional)
    return left.join(right, on)


def share_of_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``share``: each value over the sum of its key; null where that is zero."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("share", F.when(total != 0, F.col(value) / total))


def seed_then_task(detail: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``mean_, std_, variance_, ci_low_, ci_high_, mean_seed_std_`` of each measure by ``keys``.

    Seeds are summed up within a task first, then tasks of equal weight.
    """
    by_task = detail.groupBy(*keys, "task").agg(*[x for m in measures for x in (F.avg(number(m)).alias(m), sample_aggs(m, m)[3].alias(f"{m}_seed_std"))])
    parts = []
    for m in measures:
        s = with_interval(by_task.groupBy(*keys).agg(*sample_aggs(m, m), F.avg(f"{m}_seed_std").alias("_seed")), m)
        parts.append(s.select(
            *keys, F.col("n").alias(f"n_tasks_{m}"), F.col(f"{m}_mean").alias(f"mean_{m}"), F.col(f"{m}_std").alias(f"std_{m}"), F.col(f"{m}_variance").alias(f"variance_{m}"),
            F.col("ci_low").alias(f"ci_low_{m}"), F.col("ci_high").alias(f"ci_high_{m}"), F.col("_seed").alias(f"mean_seed_std_{m}")))
    return reduce(lambda a, b: a.join(b, keys), parts)


def seed_summary_ranked(detail: DataFrame, method: str, measures: list[str], by: str, falling: list[str] = ()) -> DataFrame:
    """Mean over tasks by seed, then mean and variance over seeds of each measure; ``place`` by the mean of
    ``by`` (ties by name) and, for each measure, whether a method has its best mean, the least for ``falling``."""
    seeds = detail.groupBy(method, "task", "seed").agg(*[F.avg(number(m)).alias(m) for m in measures]).groupBy(method, "seed").agg(*[F.avg(m).alias(m) for m in measures])
    out = seeds.groupBy(method).agg(*[x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.var_samp(m), F.lit(0.0)).alias(f"{m}_variance"))])
    rows = Window.partitionBy()  # one row a method
    out = out.withColumn("place", F.row_number().over(rows.orderBy(F.round(f"{by}_mean", 12).desc(), method)))
    for m in measures:
        end = (F.min if m in falling else F.max)(f"{m}_mean").over(rows)
        out = out.withColumn(f"{m}_best", is_close(F.col(f"{m}_mean"), end, 0.0, 1e-12))
    return out


def macro_summary(trials: DataFrame, method: str, outcomes: list[str]) -> DataFrame:
    """Trials -> model and task -> task -> method: mean and median over tasks of equal weight, ``n_tasks``."""
    out = trials
    for keys in ([method, "task", "model_alias"], [method, "task"]):
        out = out.groupBy(*keys).agg(*[F.avg(number(o)).alias(o) for o in outcomes])
    return out.groupBy(method).agg(F.count("*").alias("n_tasks"), *[x for o in outcomes for x in (F.avg(o).alias(f"mean_{o}"), F.median(o).alias(f"median_{o}"))])


def validity(df: DataFrame, keys: list[str], estimate: str, heldout: str) -> DataFrame:
    """Spearman of an estimate with what was held out, and how far the estimate varies (cv, range, median)."""
    spread = df.groupBy(*keys).agg(
        F.median(estimate).alias("estimate_median"), (F.stddev_pop(estimate) / F.greatest(F.avg(estimate), F.lit(EPS))).alias("estimate_cv"), (F.max(estimate) - F.min(estimate)).alias("estimate_range"))
    return spread.join(safe_spearman(df, keys, estimate, heldout), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def relative_change(depths: DataFrame, value: str, keys: tuple[str, ...] = ("task_type", "task"), bins: int = 11) -> DataFrame:
    """``relative_change_pct`` of ``value`` against its mean over bins whose centre lies in the early third.

    A task without such a bin, or with a mean that is not positive, raises an error when it is read.
    """
    early = (F.col("depth_bin") + 0.5) / bins <= 1 / 3
    base = F.avg(F.when(early, F.col(value))).over(Window.partitionBy(*keys))
    safe = F.when(F.coalesce(base <= 0, F.lit(True)), F.raise_error(F.lit("no positive early baseline")).cast("double")).otherwise(base)
    return depths.withColumn("early_baseline", safe).withColumn("relative_change_pct", 100.0 * (F.col(value) - F.col("early_baseline")) / F.col("early_baseline"))


def alpha_objectives(views: DataFrame, keys: list[str], alphas: list[float], k: int = 5) -> DataFrame:
    """``selection_objective`` of each adaptive strength: half mean rank agreement of views, 0.4 overlap of
    their top ``k``, 0.1 agreement of the first.

    ``views``: keys, view, candidate, retained energy ``a``, Laplacian energy ``c`` and ``uncertainty``.
    """
    grid = views.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    scored = grid.withColumn("score", F.log1p(F.greatest(F.col("a") / (1 + F.col("alpha") * F.col("uncertainty")) + F.col("c"), F.lit(0.0))))
    s = view_stability(scored, [*keys, "alpha"], "view", "candidate", "score", k)
    return s.withColumn("selection_objective", 0.5 * F.col("mean_spearman") + 0.4 * F.col("topk_jaccard") + 0.1 * F.col("top1_agreement"))


def leave_one_task_out(objectives: DataFrame, value: str = "selection_objective", tolerance: float = 1e-10) -> DataFrame:
    """``task, selected_alpha, training_objective, n_training_tasks``: for each task the smallest strength
    whose mean over the other tasks is within ``tolerance`` of the best. A single task gives no row."""
    by_task = objectives.groupBy("task", "alpha").agg(F.avg(value).alias("v"))
    every = Window.partitionBy("alpha")
    n = F.count("v").over(every)
    others = by_task.withColumn("n_training_tasks", n - 1).withColumn("training_objective", F.when(n > 1, (F.sum("v").over(every) - F.col("v")) / (n - 1)))
    near = F.col("training_objective") >= F.max("training_objective").over(Window.partitionBy("task")) - tolerance
    return others.withColumn("_near", near).where("_near").groupBy("task").agg(
        F.min("alpha").alias("selected_alpha"), F.min_by("training_objective", "alpha").alias("training_objective"), F.min_by("n_training_tasks", "alpha").alias("n_training_tasks"))


def negative_control(summary: DataFrame, method: str, adaptive: str, fixed: str, outcomes: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Each outcome of two methods on whole data, where they must agree: difference and ``passed``.

    Empty if either method is missing.
    """
    long = summary.select(method, F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"mean_{o}").alias("v")) for o in outcomes])).alias("s")).select(method, "s.*")
    value = lambda m: F.max(F.when(F.col(method) == m, F.col("v")))
    both = long.groupBy("outcome").agg(value(adaptive).alias("adaptive_value"), value(fixed).alias("fixed_value")).where("adaptive_value is not null and fixed_value is not null")
    off = F.abs(F.col("adaptive_value") - F.col("fixed_value"))
    return both.withColumn("absolute_difference", off).withColumn("passed", off <= tolerance)


def verdict(tests: DataFrame, validities: DataFrame, control: DataFrame, margin: float = 0.02, none: str = "no_precision", fixed: tuple[str, ...] = ("fixed_precision", "shuffled_precision")) -> DataFrame:
    """One row of the rules and their conjunction ``supported``.

    ``tests``: fraction, outcome, baseline, mean_advantage, ci_low, p_holm; ``validities``: fraction,
    mean_correlation, ci_low; ``control``: passed. Only fractions below 1 count. A rule that lacks one of its
    rows, or has nothing to test, does not hold.
    """
    part = tests.where(F.col("fraction") < 1 - 1e-12)
    fractions = part.select("fraction").distinct()
    gained = F.coalesce((F.col("mean_advantage") > 0) & (F.col("ci_low") > 0) & (F.col("p_holm") < 0.05), F.lit(False))
    held = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    among = lambda names: F.array(*map(F.lit, names))

    def expected(grid: DataFrame, outcomes: tuple[str, ...], baselines: tuple[str, ...]) -> DataFrame:
        cells = grid.withColumn("outcome", F.explode(among(outcomes))).withColumn("baseline", F.explode(among(baselines)))
        return cells.join(part, ["fraction", "outcome", "baseline"], "left")

    seen = fractions.join(validities, "fraction", "left")
    valid = seen.agg(held(F.coalesce((F.col("mean_correlation") > 0) & (F.col("ci_low") > 0), F.lit(False))).alias("uncertainty_validated"))
    low = fractions.agg(F.min("fraction").alias("fraction")).where("fraction is not null")
    utility = expected(low, ("utility_spearman",), fixed).agg(held(gained).alias("low_sample_utility"))
    ndcg = expected(fractions, ("ndcg_at_k",), (*fixed, none)).groupBy("fraction").agg(F.bool_and(gained).alias("all")).agg(F.coalesce(F.bool_or("all"), F.lit(False)).alias("ndcg_gain"))
    inferior = expected(fractions, ("utility_spearman", "ndcg_at_k"), (none,)).agg(held(F.coalesce(F.col("ci_low") > -margin, F.lit(False))).alias("not_inferior"))
    passed = control.agg(held(F.col("passed")).alias("control_passed"))
    one = reduce(DataFrame.crossJoin, (valid, utility, ndcg, inferior, passed))  # one row each
    return one.withColumn("supported", reduce(lambda a, b: a & b, [F.col(c) for c in one.columns]))


def reconstruction(df: DataFrame, keys: list[str], got: str, want: str, tolerance: float = 1e-6) -> DataFrame:
    """Absolute error of ``got`` against ``want``: n, max, median, share within ``tolerance``."""
    off = F.abs(number(got) - number(want))
    return df.groupBy(*keys).agg(F.count(off).alias("n"), F.max(off).alias("max_error"), F.median(off).alias("median_error"), F.avg((off <= tolerance).cast("double")).alias("within"))


def seed_effect(scores: DataFrame, flag: str = "seed_affects", seeded: tuple[str, ...] = ("Classification", "Clustering")) -> DataFrame:
    """Whether each case has one value of ``flag``, the one its family calls for."""
    want: Column = F.col("task_type").isin(*seeded)
    right = (F.count_distinct(flag) == 1) & (F.count(flag) == F.count("*")) & F.bool_and(F.col(flag) == want)
    return scores.groupBy("model_alias", "task").agg(F.coalesce(right, F.lit(False)).alias("seed_effect_ok"))


def split_alignment(scores: DataFrame, manifest: DataFrame, family: str = "Classification") -> DataFrame:
    """``ok`` by model, task and seed: in ``family`` one split hash, that of ``manifest(task, seed,
    expected_hash)``; elsewhere none at all."""
    seen = scores.groupBy("model_alias", "task", "task_type", "seed").agg(F.count_distinct("split_hash").alias("n_hashes"), F.min("split_hash").alias("_hash")).join(manifest, ["task", "seed"], "left")
    own = F.coalesce((F.col("n_hashes") == 1) & (F.col("_hash") == F.col("expected_hash")), F.lit(False))
    return seen.select("model_alias", "task", "seed", F.when(F.col("task_type") == family, own).otherwise(F.col("n_hashes") == 0).alias("ok"))


def split_identity(scores: DataFrame, family: str = "Classification") -> DataFrame:
    """Whether all models of a task and seed share one split."""
    return scores.where(F.col("task_type") == family).groupBy("task", "seed").agg((F.count_distinct("split_hash") == 1).alias("identical"))
