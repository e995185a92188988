"""Exact k-means rounds with lower bounds loosened by geometry.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of that to every other.
When centroids move, the usual lower bound falls by the farthest move of any other centroid. Here a cluster is known
to lie in a sphere around its former centroid, so the fall is what a point of that sphere can lose: a centroid that
moves from p to q comes nearer to x by |x - p| - |x - q|, which is |q - p| at most times the cosine of the angle at
the midpoint of p and q between the move and x (the level sets are hyperbolas, and that cosine belongs to their
asymptotes). In the plane of the sphere's centre and the move, the sphere subtends an arc, and the arc's nearest angle
gives the bound; a sphere that holds the midpoint has the full drift. Vectors whose bounds cross are scanned exactly,
in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from repselect.session import released, settled

#: Integer steps of a component's unit, and the largest integer; components beyond it count as it, so that squared
#: distances of 64 components fit a long.
STEPS, LARGEST = 256, 1 << 27
#: Up to here all products and sums of a scan are exact in double precision.
EXACT = 1 << 21
#: Bounds are widened by this share for the rounding of square roots and products, angles by so many radians.
SLACK, TURN = 1e-9, 1e-7


def usable(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """Rows with exactly ``dims`` components, none null or non-finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & (F.size(v) == dims)).where(finite)


def whole_numbers(vectors: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, v`` of usable rows: ``v`` holds floor(256 x) of each component as 32-bit integers."""
    rows = usable(vectors, dims, vector).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):  # a finite component may leave the range here; it is clipped
                whole = np.clip(np.floor(STEPS * x), -LARGEST, LARGEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(whole.reshape(batch.num_rows, dims))], ["key", "v"])

    return rows.mapInArrow(run, StructType([rows.schema["key"], StructField("v", BinaryType())]))


def _binary(numbers: np.ndarray) -> pa.Array:
    n, width = numbers.shape[0], numbers.shape[1] * 4
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all ``v`` to all ``centroids``."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def loosening(former: np.ndarray, moved: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much its vectors' lower bounds fall when the centroids move: the most that any
    other centroid can come nearer to a point within ``radius`` of the cluster's former centroid."""
    p, q = former.astype(np.float64), moved.astype(np.float64)
    drift = np.sqrt(((q - p) ** 2).sum(axis=1))
    out = np.zeros(len(p))
    for i, r in enumerate(radius):
        most = -np.inf
        for j in range(len(p)):
            if j == i or not drift[j]:
                most = most if j == i else max(most, 0.0)
                continue
            away = p[i] - (p[j] + q[j]) / 2
            far = np.sqrt(away @ away)
            if far <= r:
                most = max(most, drift[j])
                continue
            angle = np.arccos(np.clip(away @ (q[j] - p[j]) / (far * drift[j]), -1, 1)) - np.arcsin(r / far) - TURN
            most = max(most, drift[j] * np.cos(max(angle, 0.0)) if angle < np.pi / 2 else 0.0)
        out[i] = max(most, 0.0)
    return out


def scan(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids and new bounds; a vector whose bounds don't decide is measured against its own centroid,
    then against all of them. Also returns how many were measured against all."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    c = centroids.astype(np.float64)
    between = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1) / 2 * (1 - SLACK)  # nearer than half-way to the next centroid: no other is nearer
    doubt = np.flatnonzero(upper >= np.maximum(lower, half[own]))
    d = np.sqrt(((v[doubt] - centroids[own[doubt]]) ** 2).sum(axis=1).astype(np.float64))
    upper[doubt] = d * (1 + SLACK)
    doubt = doubt[upper[doubt] >= np.maximum(lower[doubt], half[own[doubt]])]
    if len(doubt):
        d2 = squared(v[doubt], centroids)
        own[doubt] = d2.argmin(axis=1)  # the first of equal ones
        upper[doubt] = np.sqrt(d2.min(axis=1).astype(np.float64)) * (1 + SLACK)
        d2[np.arange(len(doubt)), own[doubt]] = np.iinfo(np.int64).max
        lower[doubt] = np.sqrt(d2.min(axis=1).astype(np.float64)) * (1 - SLACK) if d2.shape[1] > 1 else np.inf
    return own, upper, lower, len(doubt)


def _assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, fall: np.ndarray | None) -> DataFrame:
    """The state after one assignment: ``key, v, cluster, upper, lower, scanned``. Without ``drift`` all are scanned."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _numbers(batch.column("v"), dims)
            if drift is None:
                own, upper, lower = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros(len(v))
            else:
                own, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                upper, lower = (upper + drift[own]) * (1 + SLACK), (lower - fall[own]) * (1 - SLACK) - SLACK
            own, upper, lower, scanned = scan(v, own, upper, lower, centroids)
            marks = np.zeros(len(v), np.int32)
            marks[:1] = scanned
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(marks)],
                ["key", "v", "cluster", "upper", "lower", "scanned"])

    schema = StructType([
        state.schema["key"], state.schema["v"], StructField("cluster", IntegerType()), StructField("upper", DoubleType()), StructField("lower", DoubleType()),
        StructField("scanned", IntegerType())])
    return state.mapInArrow(run, schema)


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centroids (exact floor of the means; empty clusters stay) and the radius of each cluster around its
    former one. Each batch gives one sum a cluster, Spark adds them, and the driver gets k times d numbers."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, radius = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            v, own, upper = _numbers(batch.column("v"), dims), batch.column("cluster").to_numpy(), batch.column("upper").to_numpy()
            for c in np.unique(own).tolist():
                mine = own == c
                sums[c] += v[mine].sum(axis=0)
                count[c] += mine.sum()
                radius[c] = max(radius[c], upper[mine].max())
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dims)), pa.array(np.tile(np.arange(dims), len(held))), pa.array(sums[held].ravel()), pa.array(np.repeat(count[held], dims)), pa.array(np.repeat(radius[held], dims))],
            ["cluster", "at", "total", "n", "radius"])

    parts = state.select("v", "cluster", "upper").mapInArrow(run, "cluster long, at long, total long, n long, radius double")
    added = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("radius").alias("radius"))
    moved, radius = centroids.copy(), np.zeros(k)
    for r in added.collect():  # k times d rows, whatever the data
        moved[r.cluster, r["at"]] = int(r.total) // r.n
        radius[r.cluster] = r.radius
    return moved, radius


def first_centroids(numbers: DataFrame, k: int, dims: int, salt: str) -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 of ``salt`` and key, in that order; equal hashes by their bytes. A
    null key never starts a cluster."""
    hashed = numbers.where(F.col("key").isNotNull()).select(F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256).alias("h"), "v")
    return np.array([np.frombuffer(r.v, "<i4") for r in hashed.orderBy("h", "v").limit(k).collect()], np.int64).reshape(-1, dims)


def k_means(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:", key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """``(key, cluster, distance)`` of each usable vector after ``rounds`` rounds and a last assignment, the final
    centroids, and how many vectors each assignment measured against all centroids.

    Vectors of other lengths or with null or non-finite components are left out. With fewer than ``k`` of them there are
    as many centroids; without any (or none with a key) the table is empty. Ties go to the smaller number. Repeated
    rows count each. Components beyond ``LARGEST`` steps count as that. Other columns are ignored. The state of a
    round is settled and the former one removed, so a lost executor repeats one round at most.
    """
    state = settled(whole_numbers(vectors, dims, key, vector))
    centroids = first_centroids(state, k, dims, salt)
    plain = StructType([StructField(key, state.schema["key"].dataType), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if not len(centroids):
        return state.sparkSession.createDataFrame([], plain), centroids, []
    drift = fall = None
    scanned = []
    for turn in range(rounds + 1):
        former, state = state, settled(_assigned(state, centroids, drift, fall))
        released(former)
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if turn == rounds:
            break
        moved, radius = _moved(state, centroids)
        drift, fall = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1)), loosening(centroids, moved, radius)
        centroids = moved

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cluster")
            d = ((_numbers(batch.column("v"), dims) - centroids[own.to_numpy()]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), own, pa.array(d)], [key, "cluster", "distance"])

    return state.select("key", "v", "cluster").mapInArrow(measured, plain), centroids, scanned


def report(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``k_means``.

    Inertias are sums of squared distances over the cluster and over all; one that no long can hold is null.
    """
    found, centroids, _ = k_means(vectors, k, rounds, dims, salt)
    found = settled(found)
    per = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    fits = lambda x: x if x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = found.sparkSession.createDataFrame(
        [(c, fits(d), fits(sum(per.values())), digests[c]) for c, d in sorted(per.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
