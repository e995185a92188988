"""Running sums in a global order, without a window over one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from repselect.session import settled


def sorted_parts(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` settled in range partitions, sorted by ``keys`` and ``order``, with the partition's number ``_part``."""
    columns = [*keys, *order]
    placed = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return settled(placed.sortWithinPartitions(*columns).withColumn("_part", F.spark_partition_id()))


def running(placed: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``ahead_<c>`` for each ``c`` of ``sums``: its sum over the rows of the same keys that stand before.

    ``placed`` comes from ``sorted_parts``. A group that spans several partitions is carried from one to the next: a
    partition has one such group at most, its first, so the driver handles no more numbers than partitions.
    """
    totals = placed.groupBy("_part", *keys).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = totals.select("_part", *[F.sum(c).over(before).alias(c) for c in sums], F.row_number().over(Window.partitionBy(*keys).orderBy("_part")).alias("_nth")).where("_nth > 1")
    carry = {r["_part"]: np.array([r[c] for c in sums], float) for r in carried.collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.zeros(len(sums))
        for pdf in batches:
            if not len(pdf):
                continue
            values = pdf[sums].to_numpy(float)
            own = pdf[keys].astype(object).where(pdf[keys].notna(), None)  # null keys are equal
            fresh = np.zeros(len(pdf), bool)
            for c in keys:
                column = own[c].to_numpy()
                fresh[1:] |= column[1:] != column[:-1]
            first = tuple(own.iloc[0])
            if last is None:
                held = carry.get(pdf["_part"].iloc[0], np.zeros(len(sums)))
            elif first != last:
                held = np.zeros(len(sums))
            fresh[0] = True
            starts = np.flatnonzero(fresh)
            sizes = np.diff(np.append(starts, len(pdf)))
            ahead = np.cumsum(values, axis=0) - values
            base = ahead[starts].copy()
            base[0] -= held
            ahead -= np.repeat(base, sizes, axis=0)
            last, held = tuple(own.iloc[-1]), ahead[-1] + values[-1]
            yield pdf.assign(**{f"ahead_{c}": ahead[:, k] for k, c in enumerate(sums)})

    schema = StructType([*placed.schema.fields, *[StructField(f"ahead_{c}", DoubleType()) for c in sums]])
    return placed.mapInPandas(run, schema)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, n``, and of the rows with smaller values their number ``ahead_n`` and sum ``ahead_s``.

    Equal values are one row, so a value that fills a group costs no more than another.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("s", F.col("n") * F.col(value))
    return running(sorted_parts(counts, keys, [value]), keys, ["n", "s"]).drop("_part", "s")
