"""Samples, splits, views and pooling, all decided by hashes of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from repselect.functions.scalars import content_hash, uniform


BLANKS = " \t\n\x0b\f\r"
#: Fixed order in which splits and subsets of a dataset are taken.
SPLIT_ORDER = ["test", "validation", "dev", "train"]
SUBSET_ORDER = ["default", "en", "eng", "en-en"]


#: Buckets of the hash order; a task sorts one bucket of one key.
BUCKETS = 1 << 16


def _place(keys: list[str], seed: int, item: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(uniform(F.lit(seed), F.col(item)), item))


def placed(items: DataFrame, keys: list[str], u: Column, item: str, place: str = "_p", size: str = "_n") -> DataFrame:
    """``items`` with each row's ``place`` (from 1) within its key in the order of the hash ``u`` (below 1) and ``item``,
    and the key's ``size``.

    Rows are sorted bucket by bucket of the hash; the counts of a key's buckets tell how many stand before. So no task
    holds a key's rows, however many it has.
    """
    rows = items.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * BUCKETS).cast("int"))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)  # at most BUCKETS rows
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_b").alias("_kb"), before.alias("_ahead"), F.sum("_c").over(w).alias(size))
    same = [F.equal_null(F.col(k), F.col(f"_k{n}")) for n, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_u", item))
    return rows.join(ahead, same).withColumn(place, F.col("_ahead") + own).select(*items.columns, place, size)


def uniform_cap(items: DataFrame, keys: list[str], cap: int, seed: int, item: str = "item_id") -> DataFrame:
    """At most ``cap`` rows of each key without replacement; all rows of smaller ones.

    Spark's limit on a window's rank keeps only ``cap`` rows a task before the shuffle.
    """
    return items.withColumn("_p", _place(keys, seed, item)).where(F.col("_p") <= cap).drop("_p")


def allocation(items: DataFrame, keys: list[str], label: str, size: Column) -> DataFrame:
    """``n_class, take``: ``size`` rows shared over classes in proportion, by largest remainder (ties to the
    first class), never more than a class has."""
    counts = items.groupBy(*keys, label).agg(F.count("*").alias("n_class"))
    w = Window.partitionBy(*keys)
    share = F.col("n_class") * F.least(size, F.col("_n")) / F.col("_n")
    out = counts.withColumn("_n", F.sum("n_class").over(w)).withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    left = F.least(size, F.col("_n")) - F.sum("_floor").over(w)
    place = F.row_number().over(w.orderBy((F.round(F.col("_floor") - F.col("_share"), 9)), label))
    out = out.withColumn("_left", left).withColumn("_rn", place)
    return out.select(*keys, label, "n_class", (F.col("_floor") + (F.col("_rn") <= F.col("_left")).cast("long")).cast("long").alias("take"))


def stratified_subsample(items: DataFrame, keys: list[str], label: str, size: int, seed: int, item: str = "item_id") -> DataFrame:
    """A sample of ``size`` rows of each key whose classes keep their shares."""
    takes = allocation(items, keys, label, F.lit(size))
    return placed(items, [*keys, label], uniform(F.lit(seed), F.col(item)), item).join(takes, [*keys, label]).where(F.col("_p") <= F.col("take")).drop("_p", "_n", "take", "n_class")


def stratified_cap(items: DataFrame, keys: list[str], label: str, cap: int, seed: int, item: str = "item_id") -> DataFrame:
    """Stratified sample with its ``strategy``: ``all`` below the cap; ``uniform`` where strata are not
    feasible (a class of one row, or fewer drawn or left rows than classes); else ``stratified``."""
    counts = items.groupBy(*keys, label).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.sum("c").alias("n"), F.min("c").alias("least"), F.count("*").alias("classes"))
    infeasible = (F.col("least") < 2) | (F.lit(cap) < F.col("classes")) | (F.col("n") - cap < F.col("classes"))
    plan = counts.select(*keys, F.when(F.col("n") <= cap, "all").when(infeasible, "uniform").otherwise("stratified").alias("strategy"))
    takes = allocation(items, keys, label, F.lit(cap))
    u = uniform(F.lit(seed), F.col(item))
    marked = placed(placed(items, keys, u, item, "_any", "_n1"), [*keys, label], u, item, "_s", "_n2").join(plan, keys).join(takes, [*keys, label])
    keep = F.when(F.col("strategy") == "stratified", F.col("_s") <= F.col("take")).otherwise(F.col("_any") <= cap)
    return marked.where(keep).drop("_any", "_n1", "_s", "_n2", "take", "n_class")


def stratified_split(items: DataFrame, keys: list[str], label: str, test_size: float, seed: int, item: str = "item_id") -> DataFrame:
    """``part``: of each class ``max(1, min(n - 1, round(n * test_size)))`` rows test; single rows train."""
    n = F.col("_n")
    n_test = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * test_size, 0).cast("long")))
    own = placed(items, [*keys, label], uniform(F.lit(seed), F.col(item)), item)
    return own.withColumn("part", F.when((n > 1) & (F.col("_p") <= n_test), "test").otherwise("train")).drop("_n", "_p")


def split_metadata(split: DataFrame, keys: list[str], label: str, item: str = "item_id") -> DataFrame:
    """Counts, test share and content hash of each split; no list of items is gathered."""
    test = (F.col("part") == "test").cast("long")
    own = split.groupBy(*keys).agg(F.sum(1 - test).alias("n_train"), F.sum(test).alias("n_test"), F.avg(test.cast("double")).alias("test_share"), content_hash(F.col("part"), F.col(item)).alias("split_hash"))
    return own.join(split.groupBy(*keys).agg(F.count_distinct(label).alias("n_classes")), keys).select(*keys, "n_train", "n_test", "test_share", "n_classes", "split_hash")


def view_indices(items: DataFrame, keys: list[str], roles: list[str], views: int, fraction: float, least: int, seed: int, item: str = "item_id") -> DataFrame:
    """Independent subsamples: ``role, view_id`` and the rows each draws; all rows at fraction 1."""
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(v).alias("view_id")) for r in roles for v in range(views)]))
    dealt = items.select("*", grid.alias("_g")).select(*items.columns, "_g.role", "_g.view_id")
    group = [*keys, "role", "view_id"]
    own = placed(dealt, group, uniform(F.lit(seed), F.col("role"), F.col("view_id"), F.col(item)), item)
    return own.where(F.col("_p") <= F.least(F.col("_n"), F.greatest(F.lit(least), F.bround(F.col("_n") * fraction, 0)))).drop("_n", "_p")


def text_views(docs: DataFrame, views: int, p: float, seed: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``view_id, view_text``: view 0 as it is; others drop each word with probability ``p``. Texts of three
    words or fewer stay, and one that would lose all words keeps one of them, drawn at random.

    One MD5 decides on four words, eight hex digits on each, compared as text with the digits of ``p``.
    """
    words = F.split(F.btrim(F.col(text), F.lit(BLANKS)), "[ \\t\\n\\x0B\\f\\r]+")
    own = [F.lit(seed), F.col(doc), F.col("view_id")]
    digest = lambda *more: F.md5(F.concat_ws("|", *[c.cast("string") for c in (*own, *more)]))
    one = docs.select(doc, text, words.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view_id"))
    drawn = (F.col("view_id") > 0) & (F.size("_w") > 3)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / 4).cast("int")), lambda b: digest(b))
    least = f"{round(p * (1 << 32)):08x}"
    # bound in a lambda, so that the digests are made once a text and not once a word
    held = F.transform(F.array(F.struct(F.col("_w").alias("w"), blocks.alias("h"))), lambda s: F.filter(
        s["w"], lambda w, i: F.substring(F.get(s["h"], F.floor(i / 4).cast("int")), i % 4 * 8 + 1, F.lit(8)) > least))
    three = one.withColumn("_k", F.when(drawn, F.get(held, F.lit(0))))
    any_word = F.get("_w", F.floor(uniform(*own, F.lit("one")) * F.size("_w")).cast("int"))
    thinned = F.when(F.size("_k") > 0, F.array_join("_k", " ")).otherwise(any_word)
    return three.select(doc, "view_id", F.when(drawn, thinned).otherwise(F.col(text)).alias("view_text"))


def pool_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Masked mean (by at least 1e-6), first and last token vectors from ``pos, mask, vec``."""
    flat = tokens.select(*keys, "mask", F.posexplode("vec").alias("dim", "x"))
    means = flat.groupBy(*keys, "dim").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-6))).alias("m")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean_vec"))
    ends = tokens.groupBy(*keys).agg(F.min_by("vec", "pos").alias("cls_vec"), F.coalesce(F.max_by("vec", F.when(F.col("mask") > 0, F.col("pos"))), F.min_by("vec", "pos")).alias("last_vec"))
    return means.join(ends, keys)


def resolve_split(catalog: DataFrame) -> DataFrame:
    """First available split of each dataset: subsets ``default, en, eng, en-en``, then by name; splits
    ``test, validation, dev, train``, then by name."""
    at = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(99))
    order = Window.partitionBy("dataset").orderBy(at(SPLIT_ORDER, "split"), at(SUBSET_ORDER, "subset"), "subset", "split")
    return catalog.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
