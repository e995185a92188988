"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are compared in tiles of bounded size. In the basis of principal components the leading dimensions
hold most of each product; the product of the suffix norms bounds the rest, so a pair is dropped as soon
as its bound falls below the threshold, and only the survivors are multiplied out in the given numbers.
Blocks are runs of vectors in a Z-order of the leading components. A block's box holds the ranges of several
components and of the suffix norm; two blocks form a tile only if their boxes are near enough, and only those
vectors go there that are near enough to the other block's box.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from repselect.llm.components import connected_components, local_roots
from repselect.llm.order import with_prefix
from repselect.llm.rows import quoted
from repselect.session import settled

#: Numbers in the vectors of a block (2 to 16 MB), and rows of the inner comparison.
NUMBERS, INNER = 1 << 20, 1024
#: Components that a block's box tells of, components of the Z-order and bits of each.
BOX, ORDER, BITS = 8, 4, 8


def _usable(v):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _unit(flat: np.ndarray, d: int) -> np.ndarray:
    x = flat.reshape(-1, d).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _flat(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def principal_basis(vectors: DataFrame, d: int) -> np.ndarray:
    """Columns: principal directions of the unit vectors, the largest first. Each batch gives one d x d
    sum of squares; these are added by Spark, so the driver gets d x d numbers."""

    def sums(batches):
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_flat(batch.column("v")), d)
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d)), pa.array(np.tile(np.arange(d), d)), pa.array(total.ravel())], names=["i", "j", "x"])

    # sums of decimals don't hang on the order in which tasks end
    rows = vectors.select("v").mapInArrow(sums, "i long, j long, x double").groupBy("i", "j").agg(F.sum(F.col("x").cast("decimal(30,10)")).alias("x")).toPandas()
    gram = np.zeros((d, d))
    gram[rows.i, rows.j] = rows.x.astype(float)
    values, basis = np.linalg.eigh((gram + gram.T) / 2)
    return basis[:, ::-1]


def _near(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float, lead: int, same: bool):
    """Index pairs of rows of ``x`` and ``y`` whose cosine reaches the threshold; ``p*``: in the PCA basis."""
    tail = lambda p, k: np.sqrt(np.maximum(np.einsum("ij,ij->i", p[:, k:], p[:, k:]), 0))[:, None]
    bound = np.hstack((px[:, :lead], tail(px, lead))) @ np.hstack((py[:, :lead], tail(py, lead))).T
    i, j = np.divmod(np.flatnonzero(bound.ravel() >= threshold - 1e-9), len(y))
    if same:
        i, j = i[i < j], j[i < j]
    d, at = px.shape[1], lead
    part = np.einsum("ij,ij->i", px[i, :at], py[j, :at])
    while len(i) and at < d:
        to = min(d, at + max(lead, (d - at) // 2))
        part += np.einsum("ij,ij->i", px[i, at:to], py[j, at:to])
        rest = tail(px, to)[i, 0] * tail(py, to)[j, 0] if to < d else 0
        on = part + rest >= threshold - 1e-9
        i, j, part, at = i[on], j[on], part[on], to
    exact = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[exact], j[exact]


def _basis(basis: np.ndarray, d: int) -> np.ndarray:
    """Vectors of another length than the principal basis keep their own dimensions."""
    return basis if len(basis) == d else np.eye(d)


def _placed(basis: np.ndarray):
    """Adds the place in the Z-order ``z`` and the coordinates ``p`` of the box to each vector."""
    def run(batches):
        for batch in batches:
            z, p = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                unit = _unit(_flat(batch.column("v").take(pa.array(at))), int(d))
                turned = unit @ _basis(basis, int(d))[:, :BOX]
                rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", turned, turned), 0))
                grid = np.clip((turned[:, :ORDER] + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)
                for bit in range(BITS):
                    for k in range(grid.shape[1]):
                        z[at] |= (grid[:, k] >> bit & 1) << bit * ORDER + k
                for k, row in zip(at, np.column_stack((turned, rest))):
                    p[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z), pa.array(p, pa.list_(pa.float64()))], [*batch.schema.names, "z", "p"])

    return run


def _tile(threshold: float, basis: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        ids, side, copies = (table.column(c).to_numpy() for c in ("vec_id", "side", "copies"))
        d = len(table.column("v")[0])
        unit = _unit(_flat(table.column("v")), d)
        order = np.argsort(ids, kind="stable")
        ids, side, copies, unit = ids[order], side[order], copies[order], unit[order]
        turned, lead = unit @ _basis(basis, d), max(1, d // 4)
        left = np.flatnonzero(side != 1)
        right = np.flatnonzero(side != 0) if (side == 1).any() else left
        diagonal = (side == 2).any()
        n_links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a in range(0, len(left), INNER):
            rows = left[a:a + INNER]
            for b in range(a if diagonal else 0, len(right), INNER):
                cols = right[b:b + INNER]
                i, j = _near(unit[rows], unit[cols], turned[rows], turned[cols], threshold, lead, diagonal and a == b)
                if len(i):
                    i, j = rows[i], cols[j]
                    n_links += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
                    n_links += np.bincount(j, weights=copies[i], minlength=len(ids)).astype(np.int64)
                    grown = local_roots(len(ids), np.concatenate((i, np.arange(len(ids)))), np.concatenate((j, root)))
                    root = grown
        on = np.flatnonzero(n_links)
        return pa.table({"vec_id": ids[on], "n": n_links[on], "root": ids[root[on]]})

    return run


def _linked(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(vec_id, n, root)`` in any number of rows a vector, for the distinct usable vectors ``(vec_id, v,
    copies)``. Vectors of all lengths go through together; the commonest length has the principal basis."""
    sized = vectors.withColumn("d", F.size("v"))
    common = sized.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return None
    basis = principal_basis(sized.where(F.col("d") == common.d), common.d)
    schema = StructType([*sized.schema.fields, StructField("z", LongType()), StructField("p", ArrayType(DoubleType()))])
    placed = with_prefix(sized.mapInArrow(_placed(basis), schema), ["d", "z", "vec_id"], "copies")
    first = placed.groupBy("d").agg(F.min("rank").alias("first"))  # a row a length
    placed = settled(placed.join(first, "d").select("vec_id", "v", "copies", "d", "p", F.expr(f"(rank - first) div greatest(1, {NUMBERS} div d)").alias("block")))
    corners = placed.select("d", "block", F.posexplode("p").alias("k", "x")).groupBy("d", "block", "k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    boxes = settled(corners.groupBy("d", "block").agg(F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("box")))  # one row a block
    ends = boxes.groupBy("d").agg(F.max("block").alias("end"))
    # unit vectors of that cosine are at most this far apart, and so are their coordinates
    reach = max(0.0, 2 - 2 * threshold) + 1e-9
    square = lambda x: F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0))
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    apart = total(F.zip_with("bx", "by", lambda x, y: square(F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"]))))
    ahead = boxes.join(ends, "d").select("d", F.col("block").alias("x"), F.col("box").alias("bx"), F.explode(F.sequence("block", "end")).alias("block"))
    tiles = ahead.join(boxes, ["d", "block"]).select("d", "x", F.col("block").alias("y"), "bx", F.col("box").alias("by")).where(apart <= reach)
    side = lambda block, other, k: F.struct(F.col(block).alias("block"), F.col(other).alias("other"), F.lit(k).alias("side"))
    sides = tiles.select("d", F.concat_ws("-", "d", "x", "y").alias("tile"), F.explode(
        F.when(F.col("x") == F.col("y"), F.array(side("x", "by", 2))).otherwise(F.array(side("x", "by", 0), side("y", "bx", 1)))).alias("s")).select("d", "tile", "s.*")
    far = total(F.zip_with("p", "other", lambda x, y: square(F.greatest(x - y["hi"], y["lo"] - x))))
    dealt = placed.join(sides, ["d", "block"]).where(far <= reach).select("tile", "vec_id", "side", "copies", "v")
    return dealt.groupBy("tile").applyInArrow(_tile(threshold, basis), "vec_id long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``vectors``.

    Pairs of cosine ``threshold`` or more are linked, labels and other columns aside. Equal vectors are
    compared once and counted as often as they stand. Vectors that are null, empty, zero, or hold null or
    non-finite numbers link with nothing, and so do vectors of unlike lengths. Rows that repeat an id count
    as vectors of their own; a row without an id is kept with null ``component_id`` unless it is linked.
    """
    rows = vectors.select(F.col(quoted(vec_id)).alias("vec_id"), F.col(quoted(embedding)).alias("v"))
    usable = rows.where(_usable(F.col("v")))
    distinct = settled(usable.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    # vectors are named by a dense number of their own: ids may be null or repeated
    named = settled(distinct.withColumn("node", F.monotonically_increasing_id()))
    found = _linked(named.select(F.col("node").alias("vec_id"), "v", "copies"), threshold)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = settled(found)
    roots = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "node")
    joined = settled(
        named.join(counts, "node", "left").join(roots, "node", "left")
        .select("v", F.col("vec_id").alias("least"), F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("v", "n_links", "component_id")
    linked = usable.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(_usable(F.col("v")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
