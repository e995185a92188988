"""Labelled utility of candidates: classification, clustering, pairs and similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from repselect.operators.order import running, sorted_parts
from repselect.operators.vectors import CANDIDATE, _matrix
from repselect.session import settled

#: Fixed words that stand for a positive label.
POSITIVE = ["1", "true", "yes", "positive", "duplicate", "entailment", "match"]
SEED_FREE = ("PairClassification", "STS")


def v_measure(clusters: DataFrame, keys: list[str], label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Harmonic mean of homogeneity and completeness; each is 1 where its entropy is 0."""
    w = Window.partitionBy(*keys)
    t = clusters.groupBy(*keys, label, cluster).agg(F.count("*").cast("double").alias("c"))
    t = t.withColumn("n", F.sum("c").over(w)).withColumn("nl", F.sum("c").over(Window.partitionBy(*keys, label))).withColumn("nc", F.sum("c").over(Window.partitionBy(*keys, cluster)))
    p = F.col("c") / F.col("n")
    g = t.groupBy(*keys).agg(
        F.sum(-p * F.ln(F.col("nl") / F.col("n"))).alias("hl"), F.sum(-p * F.ln(F.col("nc") / F.col("n"))).alias("hc"),
        F.sum(-p * F.ln(F.col("c") / F.col("nc"))).alias("hl_c"), F.sum(-p * F.ln(F.col("c") / F.col("nl"))).alias("hc_l"))
    h = F.when(F.col("hl") > 1e-15, 1 - F.col("hl_c") / F.col("hl")).otherwise(1.0)
    c = F.when(F.col("hc") > 1e-15, 1 - F.col("hc_l") / F.col("hc")).otherwise(1.0)
    return g.select(*keys, h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"))


def positive_label(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``is_positive`` by known words; if all or none is such a word, the largest label is positive."""
    word = F.lower(F.trim(F.col(label).cast("string"))).isin(POSITIVE)
    ends = df.groupBy(*keys).agg(F.max(word).alias("_any"), F.min(word).alias("_all"), F.max(label).alias("_top"))  # one row a key
    told = df.join(ends, keys).withColumn("is_positive", F.when(F.col("_any") & ~F.col("_all"), word).otherwise(F.col(label) == F.col("_top")))
    return told.select(*df.columns, "is_positive")


def average_precision(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Sum of precision over the steps of recall; equal scores are one threshold; null without positives."""
    steps = df.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("double")).alias("tp"), F.count("*").cast("double").alias("c")).withColumn("_down", -F.col(score))
    run = running(sorted_parts(steps, keys, ["_down"]), keys, ["tp", "c"])
    precision = (F.col("ahead_tp") + F.col("tp")) / (F.col("ahead_c") + F.col("c"))
    g = run.groupBy(*keys).agg(F.sum("tp").alias("_p"), F.sum(F.col("tp") * precision).alias("_s"))
    return g.select(*keys, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("average_precision"))


def spearman_similarity(df: DataFrame, keys: list[str], gold: str, score: str) -> DataFrame:
    """``spearman, n`` of rows with both values; null where either side is flat. Equal pairs are counted first, and
    ranks come from running counts of values, so no task holds a key's rows. Keys must not be null."""
    told = df.where(F.col(gold).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    pairs = settled(told.groupBy(*keys, F.col(gold).alias("_g"), F.col(score).alias("_s")).agg(F.count("*").alias("_w")))
    ranked = pairs
    for c in ("_g", "_s"):
        counts = pairs.groupBy(*keys, c).agg(F.sum("_w").alias("_n"))
        ends = running(sorted_parts(counts, keys, [c]), keys, ["_n"])
        ranked = ranked.join(ends.select(*keys, c, (F.col("ahead__n") + (F.col("_n") + 1) / 2).alias(f"{c}_rank")), [*keys, c])
    n = ranked.groupBy(*keys).agg(F.sum("_w").alias("n"))
    off = lambda c: F.col(f"{c}_rank") - (F.col("n") + 1) / 2
    total = lambda a, b: F.sum(F.col("_w") * off(a) * off(b))
    sums = ranked.join(n, keys).groupBy(*keys).agg(F.max("n").alias("n"), total("_g", "_s").alias("gs"), total("_g", "_g").alias("gg"), total("_s", "_s").alias("ss"))
    return sums.select(*keys, F.when((F.col("gg") > 0) & (F.col("ss") > 0), F.col("gs") / F.sqrt(F.col("gg") * F.col("ss"))).alias("spearman"), "n")


# kernels of one candidate and seed


def softmax_regression(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 200) -> np.ndarray:
    """Weights (d + 1 x classes) of multinomial regression by accelerated gradient descent."""
    xb = np.hstack((x, np.ones((len(x), 1))))
    k, n = int(y.max()) + 1, len(x)
    want = np.eye(k)[y]
    w = v = np.zeros((xb.shape[1], k))
    keep = np.ones((xb.shape[1], 1))
    keep[-1] = 0
    rate = 1 / (0.5 * np.linalg.norm(xb, 2) ** 2 / n + l2)
    for t in range(steps):
        z = xb @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - rate * (xb.T @ (p - want) / n + l2 * keep * v)
        v, w = new + t / (t + 3) * (new - w), new
    return w


def accuracy(x: np.ndarray, y: np.ndarray, test: np.ndarray) -> float:
    """Accuracy on the test rows of a regression fitted on the train rows, scaled by these alone."""
    mean, std = x[~test].mean(0), x[~test].std(0)
    z = (x - mean) / np.where(std > 0, std, 1)
    names, code = np.unique(y, return_inverse=True)
    w = softmax_regression(z[~test], code[~test], 1 / max((~test).sum(), 1))
    best = np.argmax(np.hstack((z[test], np.ones((test.sum(), 1)))) @ w, axis=1)
    return float((best == code[test]).mean())


def k_means(x: np.ndarray, k: int, seed: int, n_init: int = 4, steps: int = 50) -> np.ndarray:
    """Cluster of each row; the best of ``n_init`` starts (spread seeding) by inertia."""
    best, least = np.zeros(len(x), int), np.inf
    rng = np.random.default_rng(seed)
    for _ in range(n_init):
        centre = x[[rng.integers(len(x))]]
        while len(centre) < k:
            d = ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.vstack((centre, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]))
        for _ in range(steps):
            d = ((x[:, None] - centre[None]) ** 2).sum(2)
            own = d.argmin(1)
            new = np.stack([x[own == c].mean(0) if (own == c).any() else centre[c] for c in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        inertia = d.min(1).sum()
        if inertia < least:
            best, least = own, inertia
    return best


def classification_profile(reps: DataFrame, splits: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """``seed, primary_score``: test accuracy of each candidate and seed. ``splits``: item_id, label, seed, part."""
    joined = reps.select(*keys, "item_id", "vec").join(splits.select("item_id", F.col("label").cast("string").alias("label"), "seed", "part"), "item_id")

    def run(key, pdf):
        pdf = pdf.sort_values("item_id", kind="stable")
        return pd.DataFrame([(*key, accuracy(_matrix(pdf), pdf.label.to_numpy(str), (pdf.part == "test").to_numpy()))], columns=[*keys, "seed", "primary_score"])

    kinds = ", ".join(f"{k} {t}" for k, t in reps.select(*keys).dtypes)
    return joined.groupBy(*keys, "seed").applyInPandas(run, f"{kinds}, seed int, primary_score double")


def clustering_profile(reps: DataFrame, labels: DataFrame, seeds: list[int], keys: list[str] = CANDIDATE, n_init: int = 4) -> DataFrame:
    """``seed`` and V-measure of k-means with as many clusters as labels."""
    joined = reps.select(*keys, "item_id", "vec").join(labels.select("item_id", F.col("label").cast("string").alias("label")), "item_id").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))

    def run(key, pdf):
        pdf = pdf.sort_values("item_id", kind="stable")
        own = k_means(_matrix(pdf), pdf.label.nunique(), int(key[-1]), n_init)
        return pd.DataFrame({**{k: v for k, v in zip([*keys, "seed"], key)}, "label": pdf.label.to_numpy(), "cluster": own})

    kinds = ", ".join(f"{k} {t}" for k, t in reps.select(*keys).dtypes)
    found = joined.groupBy(*keys, "seed").applyInPandas(run, f"{kinds}, seed int, label string, cluster int")
    return v_measure(found, [*keys, "seed"])


def for_all_seeds(profile: DataFrame, seeds: list[int]) -> DataFrame:
    """Results of seed-free families, repeated for every seed."""
    return profile.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
