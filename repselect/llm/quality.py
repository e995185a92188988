"""Quality rules with adaptive thresholds, with DataFrame functions only.

Each measure of a text is kept by language and source in a mergeable quantile sketch: counts of buckets
whose bounds grow by a fixed factor, so that a quantile is right to that factor and sketches merge by
adding counts. Texts that fail the base rules are left out of the sketches. A group's fence follows from its
own median and upper quartile alone: it lies where an exponential tail through these two leaves the share
``TAIL`` of texts beyond. No measure has a cutoff of its own.

A few texts tell little of their group, so its fence is the mean of its own, weighted by its texts, and of
its language's, weighted by ``PRIOR`` texts; a language leans on all texts likewise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from repselect.llm.rows import whole_row
from repselect.session import settled

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Growth of the buckets, the least value told from zero, the share of texts beyond a fence, and the texts
#: that a group's language (and all texts, for a language) counts for in its fence.
GROWTH, LEAST, TAIL, PRIOR = 1.02, 1e-4, 1e-4, 200
#: Spreads between median and upper quartile from that quartile to the fence.
REACH = math.log(0.25 / TAIL) / math.log(2)
#: Measures that every text shows, and those that most texts don't; the latter's sketches hold only the texts
#: that show them.
COMMON = ["symbols", "capitals", "word_length"]
RARE = ["dup_lines", "repeats", "marks"]
MEASURES = [*COMMON, *RARE]


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def _without(text: Column, letters: str) -> Column:
    return F.char_length(F.translate(text, letters, ""))


def base_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, then ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``
    and one double for each of ``MEASURES``, over whole texts.

    A null text counts as empty: zeros, and ``base_failed``. Columns in ``keep`` must not bear these names.
    """
    text = F.coalesce("text", F.lit(""))
    one = docs.select(*keep, text.alias("_t"), words_of(F.col("text")).alias("_w"))
    w = F.col("_w")
    windows = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    two = one.select(
        *keep, F.size(w).cast("long").alias("n_words"), windows.alias("_h"), lines.alias("_l"),
        _without(F.col("_t"), BLANKS).cast("long").alias("word_chars"),
        (F.char_length("_t") - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length("_t") - _without(F.col("_t"), CAPITALS)).alias("_capitals"),
        (F.char_length("_t") - _without(F.col("_t"), "!?")).alias("_marks"))
    # most texts repeat no window; only the others are sorted
    h = F.col("_h")
    three = two.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    s = F.col("_s")
    four = three.withColumn("_p", F.sort_array(F.transform(
        F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"])))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])
    five = four.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("_l").alias("_lines"), "_capitals", "_marks")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(0.0)
    return five.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"), share("_capitals", "word_chars").alias("capitals"), share("n_dup_lines", "_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"), share("word_chars", "n_words").alias("word_length"), share("_marks", "word_chars").alias("marks"))


def sketch(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: the quantile sketches, one row a filled bucket. They merge by
    adding ``n``; a sketch holds a few hundred buckets however many texts it tells of."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in COMMON],
                    *[F.struct(F.lit(m).alias("measure"), F.when(F.col(m) >= LEAST, F.col(m)).alias("x")) for m in RARE])
    # outer, so that no filter on the array moves down and measures the text again
    rows = measured.select("lang", "source", F.explode_outer(F.when(~F.col("base_failed"), pairs)).alias("p")).select("lang", "source", "p.measure", "p.x").where("x is not null")
    bucket = F.when(F.col("x") < LEAST, 0).otherwise(F.floor(F.ln(F.col("x") / LEAST) / F.ln(F.lit(GROWTH))) + 1).cast("int")
    return rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, and for each measure ``texts_<measure>`` and ``fence_<measure>`` of each group of merged
    sketches. Where median and upper quartile are equal, a bucket's width stands for their spread."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("texts", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("texts") * q), F.col("bucket")))
    value = lambda b: F.when(b == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GROWTH), b - 0.5))
    cut = ranked.groupBy(*keys, "measure", "texts").agg(at(0.5).alias("mid"), at(0.75).alias("high"))
    cut = cut.withColumn("mid", value(F.col("mid"))).withColumn("high", value(F.col("high")))
    wide = cut.withColumn("fence", F.col("high") + REACH * F.greatest(F.col("high") - F.col("mid"), F.col("mid") * (GROWTH - 1), F.lit(LEAST)))
    own = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
    return wide.groupBy(*keys).agg(*[own(m, c) for m in MEASURES for c in ("texts", "fence")])


def thresholds(measured: DataFrame) -> DataFrame:
    """``_fl, _fs`` (language and source) and the fences that hold there: the group's own and its language's,
    itself mixed with that of all texts, in one mean. Null languages and sources are groups of their own."""
    sketches = settled(sketch(measured))
    renamed = lambda df, mark: df.select(*[F.col(c).alias(f"{mark}{c}") for c in df.columns])
    own = fences(sketches, ["lang", "source"])
    lang = renamed(fences(sketches, ["lang"]), "_l_")
    every = renamed(fences(sketches.withColumn("all", F.lit(1)), ["all"]), "_a_")  # one row
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_l_lang"))).join(F.broadcast(every))
    mixed = lambda n, own, other: (n * own + PRIOR * other) / (n + PRIOR)
    fence = lambda m: mixed(F.col(f"texts_{m}"), F.col(f"fence_{m}"), mixed(F.col(f"_l_texts_{m}"), F.col(f"_l_fence_{m}"), F.col(f"_a_fence_{m}")))
    return joined.select(F.col("lang").alias("_fl"), F.col("source").alias("_fs"), *[fence(m).alias(f"fence_{m}") for m in MEASURES])


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: not ``base_failed``, and no measure beyond its group's fence. A measure that
    no text of the group shows has no fence."""
    here = measured.join(limits, F.col("lang").eqNullSafe(F.col("_fl")) & F.col("source").eqNullSafe(F.col("_fs")), "left")
    # one array rather than conjuncts: a conjunct would move below the join and measure the text again
    holds = F.array(~F.col("base_failed"), *[F.coalesce(F.col(m) <= F.col(f"fence_{m}"), F.lit(True)) for m in MEASURES])
    return here.withColumn("kept", F.forall(holds, lambda x: x)).drop(*limits.columns)


def quality_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept``, one row for each row of ``docs``.

    Null ids, languages and sources keep their rows; null and empty texts fail. Other columns are ignored.
    """
    measured = settled(base_measures(docs, ["doc_id", "lang", "source"]))
    out = judged(measured, thresholds(measured))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are.

    Texts are measured twice instead of being shuffled: once for the sketches, once behind their verdict.
    """
    limits = settled(thresholds(base_measures(docs, ["lang", "source"])))
    whole = docs.select(whole_row(docs).alias("_row"), "text", "lang", "source")
    out = judged(base_measures(whole, ["_row", "lang", "source"]), limits)
    return out.where("kept").select("_row.*")
