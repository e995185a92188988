"""Correlations, resampling, paired tests and adjustments, grouped by keys."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from repselect.functions.scalars import EPS, average_rank, correlation, finite, number, uniform
from repselect.operators.pairs import correlation_parts


def correlations(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Pearson, Spearman, Kendall tau-b and distance correlation of finite pairs in each group.

    Fewer than ``min_n`` pairs give nulls; so do flat values, but for the distance correlation, which has a
    test of its own. Pairs of rows are counted and summed by sorting (``pairs``), so a group may be of any size.
    """
    rows = df.where(finite(x) & finite(y)).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    found = correlation_parts(rows, keys, "x", "y")
    varied = (F.col("n") >= min_n) & (F.col("sx") > EPS) & (F.col("sy") > EPS)
    told = (F.col("n") >= min_n) & (F.col("cxx") > EPS) & (F.col("cyy") > EPS)
    return found.select(
        *keys, *[F.when(varied, F.nanvl(c, F.lit(None))).alias(name) for c, name in (("pearson", "pearson"), ("spearman", "spearman"), ("tau", "kendall"))],
        F.when(told, F.sqrt(F.greatest("cxy", F.lit(0.0))) / F.sqrt(F.sqrt(F.col("cxx") * F.col("cyy")))).alias("distance"), F.col("n").cast("long").alias("n_layers"))


def safe_spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Spearman of finite pairs; null below ``min_n`` pairs or for flat values."""
    rows = df.where(finite(x) & finite(y)).withColumn("rx", average_rank(keys, x)).withColumn("ry", average_rank(keys, y))
    ok = (F.count("*") >= min_n) & (F.count_distinct(x) >= 2) & (F.count_distinct(y) >= 2)
    return rows.groupBy(*keys).agg(F.when(ok, correlation("rx", "ry")).alias("spearman"), F.count("*").alias("n"))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean of each group over ``draws`` resamples; one value is its own interval.

    Resamples are spread over the cluster; the index of each draw is a hash of seed, resample and place.
    """
    w = Window.partitionBy(*keys)
    rows = df.where(finite(value)).select(*keys, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("rn"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    drawn = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b")).select(*keys, "n", "b", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    drawn = drawn.withColumn("rn", F.floor(uniform(F.lit(seed), F.col("b"), F.col("i")) * F.col("n")).cast("int"))
    means = drawn.join(rows, [*keys, "rn"]).groupBy(*keys, "b").agg(F.avg("v").alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high")).join(sizes, keys)


#: Most values of which all sign vectors are counted: two halves of at most 2^22 sums.
HALVES = 44


def sign_flip_count(d: np.ndarray, tol: float = 1e-12) -> int:
    """How many of the 2^n sign vectors give a mean at least as far from zero as the given one, less ``tol``.

    The sums of either half are listed and sorted; for each sum of the first half a search counts those of the second
    that bring the whole far enough, on either side.
    """
    n = len(d)
    whole = abs(sum(d[:n // 2].tolist()) + sum(d[n // 2:].tolist()))  # in the order in which the halves are added up
    far = min(whole, n * (whole / n - tol))
    if far <= 0:
        return 1 << n
    left, right = np.zeros(1), np.zeros(1)
    for x in d[:n // 2]:
        left = np.concatenate((left + x, left - x))
    for x in d[n // 2:]:
        right = np.concatenate((right + x, right - x))
    left.sort()
    right.sort()
    return int((len(right) - np.searchsorted(right, far - left, side="left")).sum() + np.searchsorted(right, -far - left, side="right").sum())


def sign_flip(df: DataFrame, keys: list[str], value: str, drop_zeros: bool = False, tol: float = 1e-12, max_exact: int = 20, draws: int | None = 200_000) -> DataFrame:
    """Sign-flip p of the mean: over all sign vectors up to ``max_exact`` values (``HALVES`` at most), else over random
    ones with one added to hits and draws. Without ``draws`` the test is exact up to ``HALVES`` values, and larger
    groups raise an error. With ``drop_zeros`` differences within 1e-12 go first."""
    rows = df.where(finite(value))
    rows = rows.where(F.abs(value) > 1e-12) if drop_zeros else rows
    most = HALVES if draws is None else min(max_exact, HALVES)
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("d")).withColumn("n", F.size("d"))
    if draws is None:
        g = g.withColumn("n", F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit("too many values for all sign vectors"))))
    kinds = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def count(batches):
        for pdf in batches:
            yield pdf[keys].assign(p=[sign_flip_count(np.asarray(d), tol) / 2.0 ** len(d) for d in pdf.d], n=pdf.n)

    exact = g.where(F.col("n") <= most).select(*keys, "d", "n").mapInPandas(count, f"{kinds}, p double, n int")
    if draws is None:
        return exact
    total = lambda sign: F.aggregate(F.transform("d", lambda x, i: x * sign(i)), F.lit(0.0), lambda a, b: a + b)
    hit = lambda s: (F.abs(s / F.col("n")) >= F.abs(total(lambda i: F.lit(1.0)) / F.col("n")) - tol).cast("double")
    # one row a sign vector: the work spreads over the cluster
    sampled = g.where(F.col("n") > most).select(*keys, "d", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("mask"))
    coin = lambda i: F.when(uniform(F.expr("mask"), i) < 0.5, 1.0).otherwise(-1.0)
    sampled = sampled.groupBy(*keys).agg(((F.sum(hit(total(coin))) + 1) / (F.count("*") + 1)).alias("p"), F.first("n").alias("n"))
    return exact.unionByName(sampled)


def rank_biserial(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Paired rank-biserial of the non-zero differences; 0 if none."""
    rows = df.where(finite(value)).withColumn("_a", F.when(F.abs(value) > 1e-12, F.abs(value)))
    ranked = rows.where("_a is not null").withColumn("_r", average_rank(keys, "_a"))
    some = ranked.groupBy(*keys).agg((F.sum(F.signum(value) * F.col("_r")) / F.sum("_r")).alias("rb"))
    return rows.select(*keys).distinct().join(some, keys, "left").select(*keys, F.coalesce("rb", F.lit(0.0)).alias("rank_biserial"))


def holm(df: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """``p_holm``: step-down adjusted within each family; missing p stay missing."""
    known = df.where(finite(p))
    w = Window.partitionBy(*family)
    step = (F.count("*").over(w) - F.row_number().over(w.orderBy(p)) + 1) * F.col(p)
    out = known.withColumn("_s", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")
    return out.unionByName(df.where(~finite(p)).withColumn("p_holm", F.lit(None).cast("double")))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign-test p of any number of decided units; null without any.

    Both tails are as heavy, so the lighter one's binomial terms are summed and doubled; a term follows from the
    one before in logarithms, which no number of units lets vanish.
    """
    n = wins + losses
    log_term = lambda k, x: x + F.ln((n - k + 1).cast("double")) - F.ln(k.cast("double"))
    start = F.struct((-n * math.log(2)).alias("x"), F.exp(-n * math.log(2)).alias("p"))
    steps = F.slice(F.sequence(F.lit(0).cast("long"), F.least(wins, losses)), 2, 1 << 30)
    tail = F.aggregate(steps, start, lambda a, k: F.struct(log_term(k, a["x"]).alias("x"), (a["p"] + F.exp(log_term(k, a["x"]))).alias("p")), lambda a: a["p"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def paired_tests(df: DataFrame, keys: list[str], unit: str, method: str, base: str, other: str, value: str, higher: bool = True, draws: int = 200_000) -> DataFrame:
    """Differences of two methods by unit: mean and median advantage, wins, losses, ties, sign-flip p,
    sign-test p, rank-biserial and Holm-adjusted p over all keys."""
    wide = df.groupBy(*keys, unit).pivot(method, [base, other]).agg(F.avg(number(value)))
    d = wide.withColumn("d", (F.col(other) - F.col(base)) * (1 if higher else -1)).where("d is not null")
    win, loss = F.sum((F.col("d") > 1e-12).cast("long")), F.sum((F.col("d") < -1e-12).cast("long"))
    out = d.groupBy(*keys).agg(F.count("*").alias("n_units"), F.avg("d").alias("mean_advantage"), F.median("d").alias("median_advantage"), win.alias("wins"), loss.alias("losses"))
    out = out.withColumn("ties", F.col("n_units") - F.col("wins") - F.col("losses"))
    out = out.withColumn("p_sign", sign_test(F.col("wins"), F.col("losses")))
    out = out.join(sign_flip(d, keys, "d", draws=draws).select(*keys, "p"), keys).join(rank_biserial(d, keys, "d"), keys)
    return holm(out.withColumn("_f", F.lit(1)), ["_f"]).drop("_f")


def robust_variance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Half the variance plus half the squared scaled MAD of ``log1p(x / scale)``; the scale is the median of
    the positive values, and without one the result is 0."""
    scale = df.groupBy(*keys).agg(F.median(F.when(F.col(value) > 0, F.col(value))).alias("_s"))
    logs = df.join(scale, keys).withColumn("_x", F.log1p(F.col(value) / F.col("_s")))
    mid = logs.groupBy(*keys).agg(F.median("_x").alias("_m"), F.var_samp("_x").alias("_v"))
    dev = logs.join(mid, keys).groupBy(*keys).agg(F.first("_v").alias("_v"), F.median(F.abs(F.col("_x") - F.col("_m"))).alias("_mad"))
    return dev.select(*keys, F.coalesce(0.5 * F.col("_v") + 0.5 * F.pow(1.4826 * F.col("_mad"), 2), F.lit(0.0)).alias("log_energy_variance"))


def uncertainty(variances: DataFrame, group: list[str], views: int = 5) -> DataFrame:
    """Variances shrunk to their group's median with weight ``v / (v + 5)`` and divided by it; 0 if it is 0."""
    mid = variances.groupBy(*group).agg(F.median("log_energy_variance").alias("_m"))
    w = views / (views + 5.0)
    return variances.join(mid, group).withColumn("uncertainty", F.when(F.col("_m") > 0, (w * F.col("log_energy_variance") + (1 - w) * F.col("_m")) / F.col("_m")).otherwise(0.0)).drop("_m")


def precision_scores(df: DataFrame, sigma2: float = 1.0) -> DataFrame:
    """Scores ``log1p(p * A + C)`` of retained energy ``a`` and Laplacian energy ``c``: adaptive, fixed, none."""
    p = (1.0 / sigma2) / (1 + F.col("uncertainty"))
    score = lambda q: F.log1p(F.greatest(q * F.col("a") + F.col("c"), F.lit(0.0)))
    return df.withColumn("adaptive_score", score(p)).withColumn("fixed_score", score(F.lit(1.0 / sigma2))).withColumn("no_precision_score", F.log1p(F.greatest(F.col("c"), F.lit(0.0))))


def shuffled(df: DataFrame, keys: list[str], value: str, shuffles: int) -> DataFrame:
    """Each value dealt to another row of its group, once a shuffle, by hashed order."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_rn", F.row_number().over(w.orderBy("layer")))
    dealt = rows.select(*keys, "layer", F.col(value).alias(f"shuffled_{value}"), F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle"))
    dealt = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "shuffle").orderBy(uniform(F.col("layer"), F.col("shuffle")), "layer"))).drop("layer")
    return rows.join(dealt, [*keys, "_rn"]).drop("_rn")


def view_stability(df: DataFrame, keys: list[str], view: str, candidate: str, score: str, k: int = 5) -> DataFrame:
    """Mean over pairs of views: Spearman, Jaccard of the top k and agreement of the first."""
    w = Window.partitionBy(*keys, view)
    rows = df.select(*keys, view, candidate, average_rank([*keys, view], score).alias("r"), F.row_number().over(w.orderBy(F.col(score).desc(), candidate)).alias("p"))
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*keys, candidate]]
    pairs = a.join(b, [*on, F.col(f"a.{view}") < F.col(f"b.{view}")]).groupBy(*[F.col(f"a.{c}").alias(c) for c in keys], F.col(f"a.{view}").alias("v1"), F.col(f"b.{view}").alias("v2")).agg(
        correlation("a.r", "b.r").alias("rank"), F.sum(((F.col("a.p") <= k) & (F.col("b.p") <= k)).cast("double")).alias("both"), F.sum(((F.col("a.p") <= k) | (F.col("b.p") <= k)).cast("double")).alias("either"),
        F.max(((F.col("a.p") == 1) & (F.col("b.p") == 1)).cast("double")).alias("first"))
    return pairs.groupBy(*keys).agg(F.avg("rank").alias("mean_spearman"), F.avg(F.col("both") / F.col("either")).alias("topk_jaccard"), F.avg("first").alias("top1_agreement"), F.count("*").alias("n_view_pairs"))
