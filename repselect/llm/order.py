"""Global order, ranks and prefix sums without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from repselect.session import settled


def with_prefix(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``before`` (sum of ``size`` ahead) in the order of ``order``.

    Rows are range-partitioned and sorted, each partition is summed, and the running sum of the few
    partition totals shifts the sums within each. Rows equal in ``order`` are told apart by their place in
    the input, so that even one value held by a third of all rows is dealt to many partitions.
    """
    keys = [*order, "_tie"]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    placed = settled(placed.withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_sum"), F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rank"))
    own = Window.partitionBy("_part").orderBy(*keys)
    running = placed.withColumn("_own", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)).withColumn("_at", F.row_number().over(own) - 1)
    return running.join(totals, "_part").select(
        *rows.columns, (F.col("_rank") + F.col("_at")).alias("rank"), (F.col("_before") + F.col("_own")).alias("before"))
