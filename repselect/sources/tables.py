"""Readers and writers of result tables, representation caches and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from repselect.functions.scalars import content_hash

SEED_RESULT = "model_alias string, task string, task_type string, seed int, layer_indices array<int>, primary_scores array<double>"


def read_seed_results(spark: SparkSession, path: str) -> DataFrame:
    """Seed result documents below ``path``, with the file of each."""
    return spark.read.schema(SEED_RESULT).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("result_file", F.input_file_name())


def explode_results(results: DataFrame) -> DataFrame:
    """One row a layer; arrays of unlike length or a score that is not finite raise an error."""
    equal = F.size("layer_indices") == F.size("primary_scores")
    fine = F.forall("primary_scores", lambda x: x.isNotNull() & ~F.isnan(x))
    rest = [c for c in results.columns if c not in ("layer_indices", "primary_scores")]
    checked = F.when(equal & fine, F.arrays_zip(F.col("layer_indices").alias("layer"), F.col("primary_scores").alias("primary_score"))).otherwise(F.raise_error(F.lit("layers and scores do not match")))
    return results.select(*rest, F.inline(checked).alias("layer", "primary_score"))


def nest_results(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of layers and scores in the order of layers."""
    nested = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("layer", "primary_score"))).alias("s"))
    return nested.select(*keys, F.col("s.layer").alias("layer_indices"), F.col("s.primary_score").alias("primary_scores"))


def read_long(spark: SparkSession, path: str, schema: str, kind: str = "parquet", required: tuple[str, ...] = ()) -> DataFrame:
    """A long table by explicit schema; required columns are checked by name."""
    df = spark.read.schema(schema).options(header=True).format(kind).load(path)
    if missing := set(required) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def select_by_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their own names, each from the first alias that the table has."""
    out = []
    for name, others in aliases.items():
        found = next((c for c in [name, *others] if c in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name}")
        out.append(F.col(found).alias(name))
    return df.select(*out)


def write_long(df: DataFrame, path: str, keys: list[str], kind: str = "parquet", partition: list[str] | None = None) -> None:
    """A table in the order of its keys: ranges of keys a file, sorted within."""
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition) if partition else writer).save(path)


CACHE_KEY = ["model_alias", "task"]


def cache_meta(reps: DataFrame, settings: str = "") -> DataFrame:
    """One row a model and task of vectors: ``num_layers, n_items``, the hash of the sampled items (and sides),
    that of the vectors, and the fingerprint of ``settings`` under which they were made."""
    side = F.col("side") if "side" in reps.columns else F.lit("")
    items = reps.select(*CACHE_KEY, side.alias("side"), "item_id").distinct().groupBy(*CACHE_KEY).agg(F.count("*").alias("n_items"), content_hash(F.col("side"), F.col("item_id")).alias("sample_hash"))
    numbers = F.concat_ws(",", F.transform("vec", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")))
    vectors = reps.groupBy(*CACHE_KEY).agg(F.count_distinct("layer").alias("num_layers"))
    hashed = reps.withColumn("side", side).groupBy(*CACHE_KEY).agg(content_hash(F.col("layer"), F.col("side"), F.col("item_id"), numbers).alias("embedding_hash"))
    return vectors.join(items, CACHE_KEY).join(hashed, CACHE_KEY).withColumn("fingerprint", F.md5(F.lit(settings)))


def write_cache(reps: DataFrame, path: str, settings: str = "") -> None:
    """Vectors by model and task in ``vectors``, and their ``cache_meta`` in ``meta``."""
    reps.repartition(*CACHE_KEY, "layer").write.mode("overwrite").partitionBy(*CACHE_KEY).parquet(f"{path}/vectors")
    cache_meta(reps, settings).write.mode("overwrite").parquet(f"{path}/meta")


def read_cache(spark: SparkSession, path: str, settings: str = "", expected: DataFrame | None = None) -> DataFrame:
    """Cached vectors; pairs come back with all of side a ahead of side b as ``side``.

    Layers, items and vectors must match what was written, and the fingerprint that of ``settings``;
    ``expected(model_alias, task, sample_hash)`` must be found with the same samples. Else an error is raised.
    """
    reps, meta = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/meta")
    now = cache_meta(reps, settings)
    differ = meta.exceptAll(now.select(meta.columns)).unionByName(now.select(meta.columns).exceptAll(meta))
    if not differ.isEmpty():
        raise ValueError("cached vectors, layers or settings do not match")
    if expected is not None and not expected.join(meta, [*CACHE_KEY, "sample_hash"], "left_anti").isEmpty():
        raise ValueError("cached samples do not match")
    return reps


def both_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of pairs as nodes: all of side a, then all of side b; ``node`` numbers them in that order."""
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


def remaining_work(inventory: DataFrame, done: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Inventory rows without a result; a result of another fingerprint raises an error."""
    other = inventory.alias("i").join(done.alias("d"), keys).where(F.col(f"i.{fingerprint}") != F.col(f"d.{fingerprint}"))
    if not other.isEmpty():
        raise ValueError("results of other settings exist")
    return inventory.join(done, keys, "left_anti")


def flatten_metrics(results: DataFrame, keys: list[str]) -> DataFrame:
    """``layer, feature, value`` from arrays by layer; repeated or unordered layers raise an error."""
    ordered = F.when(F.col("layer_indices") == F.array_sort(F.array_distinct("layer_indices")), F.col("layer_indices")).otherwise(F.raise_error(F.lit("layers repeat or are not in order")))
    return results.select(*keys, "feature", F.inline(F.arrays_zip(ordered.alias("layer"), F.col("values").alias("value"))).alias("layer", "value"))


def export_targets(profiles: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """One nested row a case: arrays over layers and a map of each seed's scores."""
    means = profiles.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("layer", "score_mean", "score_variance"))).alias("s"))
    seeds = scores.groupBy(*keys, "seed").agg(F.sort_array(F.collect_list(F.struct("layer", "primary_score"))).alias("t")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("seed").cast("string"), F.col("t.primary_score"))))).alias("by_seed"))
    return means.select(*keys, F.col("s.layer").alias("layers"), F.col("s.score_mean").alias("mean"), F.col("s.score_variance").alias("variance")).join(seeds, keys)
