"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from repselect.session import released, settled


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links ``left[k] - right[k]``."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def _each(rows: DataFrame, *links: tuple[Column, Column]) -> DataFrame:
    """``node, root`` of several links a row, in one pass over ``rows``."""
    return rows.select(F.inline(F.array(*[F.struct(a.alias("node"), b.alias("root")) for a, b in links])))


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node has one link only and no root has a link of its own."""
    ends = _each(pairs, (F.col("node"), F.lit(True)), (F.col("root"), F.lit(False)))
    return ends.groupBy("node").agg(F.count_if("root").alias("own"), F.count("*").alias("all")).where("own > 0 and all > 1").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)`` with the smallest node of each component, for every node
    that is not its own root. Settled.

    Null ends, self links and repeated links are ignored; an empty table gives an empty one. Each round
    only shuffles the links and keeps at most one link a node once the stars have formed, so rounds grow
    with the logarithm of a component; they end as soon as all are stars. Nothing gathers the links of a node in a
    row; the links of a star's centre meet its one smallest neighbour by a join on that node, whose larger side is
    split where adaptive execution finds it skewed. Every shuffle costs a task a partition however few links there
    are, so a round has five: no link is read twice to be turned round, repeated ones go at its end, and joins merge
    what has been shuffled instead of collecting it for a broadcast.
    """
    node, root = F.col("node"), F.col("root")
    pairs = settled(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .distinct()
    )
    while True:
        low = _each(pairs, (node, root), (root, node)).groupBy("node").agg(F.least(F.min("root"), node).alias("m"))
        larger = pairs.select(root.alias("node"), node.alias("other"))
        large = larger.join(low.hint("merge"), "node").select(F.col("other").alias("node"), F.col("m").alias("root"))
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = _each(large.join(low.hint("merge"), "node"), (node, F.col("m")), (root, F.col("m")))
        former, pairs = pairs, settled(small.where(node != root).distinct())
        released(former)
        if _are_stars(pairs):
            return pairs
