"""Checks of a score table against what was expected: rows of severity, check, status and detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from repselect.functions.scalars import content_hash

CASE = ["model_alias", "task"]


def _row(df: DataFrame, check: str, bad: Column, severity: str = "error") -> DataFrame:
    """One row from all rows of ``df``: fails if ``bad`` holds for any."""
    n = F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0))
    return df.agg(n.alias("n_bad")).select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.when(F.col("n_bad") == 0, "ok").otherwise("fail").alias("status"), "n_bad")


def expected_cells(scores: DataFrame, models: list[str], tasks: list[str], seeds: list[int]) -> DataFrame:
    """Cells of model, task and seed that are missing or not expected."""
    spark = scores.sparkSession
    grid = spark.createDataFrame([(m, t, s) for m in models for t in tasks for s in seeds], "model_alias string, task string, seed int")
    seen = scores.select("model_alias", "task", F.col("seed").cast("int").alias("seed")).distinct()
    return grid.exceptAll(seen).withColumn("problem", F.lit("missing")).unionByName(seen.exceptAll(grid).withColumn("problem", F.lit("unexpected")))


def seed_coverage(scores: DataFrame, seeds: list[int]) -> DataFrame:
    """Number of expected seeds that each model and task lacks."""
    return scores.groupBy(*CASE).agg(F.count_distinct(F.when(F.col("seed").isin(seeds), F.col("seed"))).alias("n_seeds")).withColumn("n_missing", F.lit(len(seeds)) - F.col("n_seeds"))


def layer_alignment(scores: DataFrame) -> DataFrame:
    """Whether all seeds of a case have the same layers, each once."""
    by_seed = scores.groupBy(*CASE, "seed").agg(F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("layers"), (F.count("*") != F.count_distinct("layer")).alias("repeated"))
    return by_seed.groupBy(*CASE).agg(F.count_distinct("layers").alias("n_layer_sets"), F.max("repeated").alias("repeated")).withColumn("aligned", (F.col("n_layer_sets") == 1) & ~F.col("repeated"))


def hash_consistency(scores: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct hashes of each key; null ones are left out."""
    return scores.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def deterministic_seeds(scores: DataFrame, families: list[str]) -> DataFrame:
    """Largest spread across seeds of the layers of seed-free families."""
    return scores.where(F.col("task_type").isin(families)).groupBy(*CASE, "layer").agg((F.max("primary_score") - F.min("primary_score")).alias("d")).groupBy(*CASE).agg(F.max("d").alias("max_spread"), (F.max("d") == 0).alias("identical"))


def split_integrity(splits: DataFrame, items: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """Of each split (``keys``): its sizes, items in two parts, items of its task (``of``, among ``keys``) in no part,
    items that are not the task's, and ``valid`` if there are none of these and no part is empty."""
    parts = splits.groupBy(*keys, "item_id").agg(F.count_distinct("part").alias("n_parts"), F.max((F.col("part") == "train").cast("int")).alias("train"), F.max((F.col("part") == "test").cast("int")).alias("test"))
    known = items.select(*of, "item_id").distinct()
    sizes = known.groupBy(*of).agg(F.count("*").alias("n_items"))
    own = parts.join(known.withColumn("_known", F.lit(1)), [*of, "item_id"], "left").groupBy(*keys).agg(
        F.sum("train").alias("n_train"), F.sum("test").alias("n_test"), F.sum((F.col("n_parts") > 1).cast("long")).alias("n_overlap"),
        F.count("_known").alias("n_known"), (F.count("*") - F.count("_known")).alias("n_unknown"))
    out = own.join(sizes, of, "left").withColumn("n_missing", F.coalesce("n_items", F.lit(0)) - F.col("n_known"))
    sound = reduce(Column.__and__, [F.col(c) == 0 for c in ("n_overlap", "n_missing", "n_unknown")])
    return out.select(*keys, "n_train", "n_test", "n_overlap", "n_missing", "n_unknown", (sound & (F.col("n_train") > 0) & (F.col("n_test") > 0)).alias("valid"))


def split_diversity(splits: DataFrame) -> DataFrame:
    """Distinct test sets over seeds of each task. A set's hash adds up those of its items, so no row holds them all."""
    tests = splits.where("part = 'test'").groupBy("task", "seed").agg(content_hash(F.col("item_id")).alias("split_hash"))
    return tests.groupBy("task").agg(F.count("*").alias("n_seeds"), F.count_distinct("split_hash").alias("n_splits"))


def validate_integrity(scores: DataFrame, models: list[str], tasks: list[str], seeds: list[int], seed_free: list[str]) -> DataFrame:
    """All checks of a score table, one row each."""
    cells = expected_cells(scores, models, tasks, seeds)
    rows = [
        _row(cells, "expected_cells", F.lit(True)), _row(seed_coverage(scores, seeds), "seed_coverage", F.col("n_missing") > 0), _row(layer_alignment(scores), "layer_alignment", ~F.col("aligned")),
        _row(hash_consistency(scores, ["task"], ["task_type"]), "one_family_a_task", F.col("n_task_type") != 1), _row(deterministic_seeds(scores, seed_free), "deterministic_seeds", ~F.col("identical"), "warning"),
        _row(scores, "finite_scores", F.isnan("primary_score") | F.col("primary_score").isNull())]
    return reduce(DataFrame.unionByName, rows)
