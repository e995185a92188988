"""A bounded draw of texts to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def drawn_texts(rows: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, text``: of each ``by`` at most ``n`` distinct texts, those of the smallest hash; nulls are left out.

    Hashes are made distinct and ranked, so no text meets in one task; the texts are then read behind a join
    with one limit a group. However often a text is repeated, it is drawn once.
    """
    hashed = F.xxhash64("text")
    known = rows.where(F.col("text").isNotNull()).select(*by, "text")
    hashes = known.select(*by, hashed.alias("_h")).distinct()
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
        cuts = hashes.withColumn("_p", place).where(F.col("_p") <= n).groupBy(*by).agg(F.max("_h").alias("_cut"))
    else:
        cuts = hashes.orderBy("_h").limit(n).agg(F.max("_h").alias("_cut"))  # one row
    near = known.join(cuts, list(by)) if by else known.join(F.broadcast(cuts))
    return near.where(hashed <= F.col("_cut")).groupBy(*by, hashed.alias("_h")).agg(F.first("text").alias("text")).drop("_h")
