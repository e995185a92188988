"""All pairs of a candidate's items, tile by tile.

Items are dealt to blocks of about ``ROWS``, kept once in the checkpoint folder. A nested-loop join without a shuffle
lets every partition of blocks meet every other one; a task streams the pairs of its own blocks with all others through
a matrix kernel and folds them into what it returns: counts by bucket, sums, or each item's few nearest. So the work
grows with the square of the items, but disk with their number alone, and a worker holds two blocks, a tile and its folds.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from repselect.session import CLEANUP, settled

CANDIDATE = ["model_alias", "task", "layer"]
#: Items of a block, on average.
ROWS = 1024
#: Bytes of vectors in a partition of blocks, about, if that makes more partitions than the session shuffles to.
PARTITION = 4 << 20
#: An Arrow batch ends when it holds so many bytes (Spark counts rows, and these are large).
BATCH = "8m"
#: Rows of a tile that are worked out together, so that they stay in a core's cache.
STRIP = 256
#: Folds that a task holds before it hands them out.
HELD = 256
#: Distances that are listed one by one instead of counted by bucket.
FEW = 1 << 18
EPS = 1e-12


def item_blocks(reps: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """``block, n_blocks, d, items, flat`` of each candidate, settled: a block's item ids and its vectors as they come, in
    floats or doubles. All partitions hold about as many blocks.

    ``item_id`` (a number) names an item of a candidate once; vectors of a candidate have one length. The driver keeps
    two numbers a candidate.
    """
    spark = reps.sparkSession
    number, width = ("float", 4) if dict(reps.dtypes)["vec"] == "array<float>" else ("double", 8)
    sizes = reps.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.size("vec")).alias("numbers"))
    rows = [(*(r[k] for k in keys), -(-r.n // ROWS), r.numbers * width) for r in sizes.collect()]
    counts = spark.createDataFrame([r[:-1] for r in rows], sizes.select(*keys).withColumn("n_blocks", F.lit(0)).schema)
    parts = max(1, min(sum(r[-2] for r in rows), max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(r[-1] for r in rows) // PARTITION)))
    dealt = reps.join(F.broadcast(counts), keys).select(*keys, "n_blocks", F.pmod(F.xxhash64("item_id"), F.col("n_blocks")).cast("int").alias("block"), F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast(f"array<{number}>").alias("vec"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in reps.select(*keys).dtypes)

    def gather(key, rows):
        ids = rows.column("item_id").to_numpy()
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("vec").chunks]).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return pa.table({
            **{k: pa.array([v.as_py()], v.type) for k, v in zip([*keys, "n_blocks", "block"], key)}, "d": pa.array([flat.shape[1]], pa.int32()),
            "items": pa.array([ids[order]], pa.list_(pa.int64())), "flat": pa.array([np.ascontiguousarray(flat[order], f"f{width}").tobytes()], pa.binary())})

    return settled(dealt.groupBy(*keys, "n_blocks", "block").applyInArrow(gather, f"{kinds}, n_blocks int, block int, d int, items array<long>, flat binary").repartition(parts))


def _vectors(n: int, d: int, flat: bytes) -> np.ndarray:
    """The ``n`` vectors of a block as doubles."""
    return np.frombuffer(flat, f"f{len(flat) // (n * d)}" if n * d else "f8").reshape(n, d).astype(np.float64)


class Fold:
    """What a task gathers from the pairs of blocks it meets; what several tasks return of one thing must add up."""

    def __init__(self, key: tuple, ids: np.ndarray):
        """``ids``: of the own block."""

    def meet(self, ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Takes ids and vectors of the own block and another one; ``same`` if they are one."""
        raise NotImplementedError

    def columns(self) -> dict[str, list | np.ndarray]:
        """The rows to return."""
        raise NotImplementedError


def over_pairs(blocks: DataFrame, keys: list[str], fold: Callable[[tuple, np.ndarray], Fold], schema: str, each: bool) -> DataFrame:
    """The rows of ``schema`` that folds return; to be run within ``bounded``.

    With ``each``, a fold belongs to a block, which meets all blocks of its candidate, itself included, and rows get
    its number as ``block``; it comes in one part if Spark leaves the pairs in their order, else in several. Without,
    folds belong to a candidate and each two of its blocks meet once.
    """
    kinds = ", ".join(f"`{k}` {t}" for k, t in blocks.select(*keys).dtypes) + ", block int" * each
    columns = [*keys, "block", "d", "items", "flat"]
    one, other = (blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
    meets = reduce(lambda x, y: x & y, [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys])
    if not each:  # of two blocks, one takes the other: the lower if the sum of their numbers is even, so that all have as much to do
        i, j = F.col("block_a"), F.col("block_b")
        meets = meets & ((i == j) | ((i < j) == ((i + j) % 2 == 0)))
    met = one.join(other.drop("d_b").hint("shuffle_replicate_nl"), meets).drop(*[f"{k}_b" for k in keys])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(f"{kinds}, {schema}"))

    def run(batches):
        folds: dict[tuple, Fold] = {}

        def handed_out():
            for name, held in folds.items():
                found = held.columns()
                if n := len(next(iter(found.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array([name[k]] * n if k < len(name) else found[f.name], f.type) for k, f in enumerate(arrow)], schema=arrow)
            folds.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                key, i, j, d = tuple(r[f"{c}_a"].as_py() for c in keys), r["block_a"].as_py(), r["block_b"].as_py(), r["d_a"].as_py()
                (ids_a, a), (ids_b, b) = ((ids := r[f"items_{side}"].values.to_numpy(), _vectors(len(ids), d, r[f"flat_{side}"].as_buffer())) for side in "ab")
                name = (*key, i) if each else key
                if name not in folds:
                    if len(folds) >= HELD:
                        yield from handed_out()
                    folds[name] = fold(key, ids_a)
                folds[name].meet(ids_a, a, ids_b, b, i == j)
        yield from handed_out()

    return met.coalesce(blocks.rdd.getNumPartitions()).mapInArrow(run, f"{kinds}, {schema}")


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, Arrow batches hold ``BATCH`` bytes at most, and a job's shuffle files go when it ends."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, CLEANUP: "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; those lost to cancellation are taken from the differences."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    d2 = np.add.outer(aa, bb)
    d2 -= 2 * a @ b.T
    if d2.size and not d2.min() > 1e-9 * (aa.max() + bb.max()):
        near = d2 <= 1e-9 * (aa[:, None] + bb)
        for k in np.flatnonzero(near.any(axis=1)):
            d2[k, near[k]] = ((b[near[k]] - a[k]) ** 2).sum(1)
    return d2


#: The bits of the double beyond all finite ones.
INFINITE = 0x7FF << 52


class _Counts(Fold):
    """Counts of positive distances by the next bits of their doubles: those whose bits above ``high`` are ``prefix``,
    by the bits above ``low``. Up to 16 bits are counted in a table, more are listed."""

    def __init__(self, prefix: int, high: int, low: int):
        self.prefix, self.high, self.low = prefix, high, low
        self.table = np.zeros(1 << high - low if high - low <= 16 else 0, np.int64)
        self.listed: list[np.ndarray] = []

    def meet(self, ids_a, a, ids_b, b, same):
        for s in range(0, len(a), STRIP):
            own = a[s:s + STRIP]
            d2 = squared_distances(own, b[s:] if same else b)
            bits = (d2[np.triu_indices(len(own), 1, d2.shape[1])] if same else d2.ravel()).view(np.int64)
            if self.high < 63:
                bits = bits[bits >> self.high == self.prefix]
            if bits.size and (bits.min() <= 0 or bits.max() > INFINITE):  # neither zeros, with either sign, nor what is not a number
                bits = bits[(bits > 0) & (bits <= INFINITE)]
            if not bits.size:
                continue
            if self.table.size:
                self.table += np.bincount(bits >> self.low & len(self.table) - 1, minlength=len(self.table))
            else:
                self.listed.append(bits & (1 << self.high) - 1)

    def columns(self):
        if self.table.size:
            bucket = np.flatnonzero(self.table)
            return {"bucket": bucket, "n": self.table[bucket]}
        bucket, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.listed]), return_counts=True)
        return {"bucket": bucket, "n": n}


class _Nothing(Fold):
    def meet(self, *_):
        pass

    def columns(self):
        return {"bucket": [], "n": []}


def bandwidth(blocks: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """``tau2``: half the lower median of the positive squared distances over all pairs of a candidate's items; 1
    without any.

    The median is selected exactly, up to 16 bits of its double at a time: tasks count their distances by bucket, Spark
    adds the counts, and the next round counts within the bucket that holds the median. Once that holds no more than
    ``FEW`` distances, all of their bits are taken at once. The driver keeps four numbers a candidate.
    """
    spark = blocks.sparkSession
    every = [tuple(r) for r in blocks.select(*keys).distinct().collect()]
    state = {k: (0, 63, 47, None) for k in every}  # the median's upper bits, where they end, where the next end, its place among those that share them
    w = Window.partitionBy(*keys)  # at most 65,536 buckets, or FEW
    while any(high for _, high, _, _ in state.values()):
        def fold(key, ids, state=state):
            prefix, high, low, _ = state.get(key, (0, 0, 0, 0))
            return _Counts(prefix, high, low) if high else _Nothing(key, ids)

        counts = over_pairs(blocks, keys, fold, "bucket long, n long", each=False).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
        placed = counts.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        ranks = spark.createDataFrame([(*k, s[3]) for k, s in state.items()], counts.select(*keys).withColumn("rank", F.lit(None).cast("long")).schema)
        placed = placed.join(F.broadcast(ranks), keys).withColumn("rank", F.coalesce("rank", F.floor((F.col("total") - 1) / 2)))
        with bounded(spark):
            found = placed.where("upto > rank").groupBy(*keys).agg(F.min("bucket").alias("bucket"), F.min_by(F.col("rank") - F.col("upto") + F.col("n"), "bucket").alias("left"), F.min_by("n", "bucket").alias("n")).collect()
        after = {k: s for k, s in state.items() if not s[1]}  # those without a positive distance are in no bucket
        for r in found:
            key = tuple(r[k] for k in keys)
            prefix, high, low, _ = state[key]
            bits = low if r.n <= FEW else min(low, 16, (r.n // FEW).bit_length() + 2)  # enough to leave few
            after[key] = (prefix << high - low | r.bucket, low, low - bits, r.left)
        state = after
    tau = [(*k, max(0.5 * struct.unpack("d", struct.pack("q", state[k][0]))[0], EPS) if k in state else 1.0) for k in every]
    return spark.createDataFrame(tau, blocks.select(*keys).withColumn("tau2", F.lit(0.0)).schema)


def _whole(found: DataFrame, keys: list[str], joined: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """The rows of ``schema`` that ``joined`` makes of a block's parts, which it gets as lists of arrays, settled."""
    spark, columns = found.sparkSession, [c for c in found.columns if c not in (*keys, "block")]
    kinds, names = ", ".join(f"`{k}` {t}" for k, t in found.select(*keys).dtypes), [f.split()[0] for f in schema.split(", ")]
    arrays = ", ".join("{} array<{}>".format(*f.split()) for f in schema.split(", "))

    def join(key, rows):
        whole = joined(*([x.values.to_numpy() for x in rows.column(c)] for c in columns))
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)}, **{c: pa.array([whole[c]]) for c in names}})

    with bounded(spark):
        rows = settled(found.groupBy(*keys, "block").applyInArrow(join, f"{kinds}, {arrays}"))
    return rows.select(*keys, F.inline(F.arrays_zip(*names)))


def _tau_of(tau: DataFrame, keys: list[str]) -> dict[tuple, float]:
    return {tuple(r[k] for k in keys): r.tau2 for r in tau.collect()}  # one row a candidate


class _Degrees(Fold):
    def __init__(self, ids: np.ndarray, tau2: float):
        self.ids, self.width, self.sums = ids, 2 * tau2 + EPS, np.zeros(len(ids))

    def meet(self, ids_a, a, ids_b, b, same):
        for s in range(0, len(a), STRIP):
            w = squared_distances(a[s:s + STRIP], b)
            w /= -self.width
            np.exp(w, out=w)
            if same:
                w[np.arange(len(w)), s + np.arange(len(w))] = 0
            self.sums[s:s + STRIP] += w.sum(1)

    def columns(self):
        return {"item_id": [self.ids], "part": [self.sums]}


def degrees(blocks: DataFrame, tau: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """``item_id, degree``: each item's sum of Gaussian affinities exp(-d2 / (2 tau2 + eps)) to all others."""
    width = _tau_of(tau, keys)

    def added(items, parts):
        return {"item_id": items[0], "degree": np.sum(parts, axis=0)}

    found = over_pairs(blocks, keys, lambda key, ids: _Degrees(ids, width[key]), "item_id array<long>, part array<double>", each=True)
    return _whole(found, keys, added, "item_id long, degree double")


class _Nearest(Fold):
    """The ``k`` nearest of each item of a block so far, by distance and id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.d2, self.other = ids, np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)

    def meet(self, ids_a, a, ids_b, b, same):
        bb = (b * b).sum(1)
        for s in range(0, len(a), STRIP):
            self._strip(slice(s, s + STRIP), a[s:s + STRIP], ids_b, b, bb, same)

    def _strip(self, rows, a, ids_b, b, bb, same):
        k, held, others = self.d2.shape[1], self.d2[rows], self.other[rows]
        aa = (a * a).sum(1)
        d2 = np.add.outer(aa, bb)
        d2 -= 2 * a @ b.T
        if same:
            d2[np.arange(len(a)), rows.start + np.arange(len(a))] = np.nan
        # the product's error is less than that; what may be among the nearest is worked out again from the differences
        slack = 8 * a.shape[1] * np.finfo(float).eps * (aa + bb.max(initial=0))
        limit = held[:, -1] + slack
        if d2.shape[1] > k and np.isinf(limit).any():
            limit = np.fmin(limit, np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * slack)
        row, column = np.nonzero(d2 <= limit[:, None])
        near = np.concatenate([np.zeros(0), *(_apart(a[row[p:p + CHUNK]], b[column[p:p + CHUNK]]) for p in range(0, len(row), CHUNK))])
        fits = (near <= held[row, -1]) & np.isfinite(near)
        row, column, near = row[fits], column[fits], near[fits]
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, k), row])
        near = np.concatenate([held[touched].ravel(), near])
        other = np.concatenate([others[touched].ravel(), ids_b[column]])
        place, order = _places(row, near, other)
        keep = order[place < k]
        held[row[keep], place[place < k]], others[row[keep], place[place < k]] = near[keep], other[keep]

    def columns(self):
        row, place = np.nonzero(np.isfinite(self.d2))
        return {"item": [self.ids[row]], "near": [self.other[row, place]], "at": [self.d2[row, place]]}


#: Pairs whose differences are formed at once.
CHUNK = 1 << 14


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b``, added up in order, so that equal vectors are equally far from
    any other and ties are those of SQL."""
    return np.add.accumulate((a - b) ** 2, axis=1)[:, -1]


def _places(item: np.ndarray, near: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from 0 within each item by distance and id, and the order that they belong to."""
    order = np.lexsort((other, near, item))
    ranked = item[order]
    return np.arange(len(ranked)) - np.searchsorted(ranked, ranked), order


def nearest(blocks: DataFrame, k: int, keys: list[str] = CANDIDATE) -> DataFrame:
    """``item_id, place, other, d2``: the ``k`` nearest other items of each item, the smaller id first among equals."""
    def merged(items, others, near):
        item, other, d2 = map(np.concatenate, (items, others, near))
        place, order = _places(item, d2, other)
        keep = order[place < k]
        return {"item_id": item[keep], "place": (place[place < k] + 1).astype(np.int32), "other": other[keep], "d2": d2[keep]}

    found = over_pairs(blocks, keys, lambda key, ids: _Nearest(ids, k), "item array<long>, near array<long>, at array<double>", each=True)
    return _whole(found, keys, merged, "item_id long, place int, other long, d2 double")


def knn_graph(near: DataFrame, tau: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """``item_id, other, weight``: the affinity of each item to its nearest ones, halved and added both ways, as the
    symmetric graph has it (``item_id`` below ``other``)."""
    half = near.join(F.broadcast(tau), keys).select(*keys, F.least("item_id", "other").alias("item_id"), F.greatest("item_id", "other").alias("other"), (F.exp(-F.col("d2") / (2 * F.col("tau2") + EPS)) / 2).alias("half"))
    return half.groupBy(*keys, "item_id", "other").agg(F.sum("half").alias("weight"))


def two_nn(near: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """TwoNN intrinsic dimension from each item's two nearest; items with a copy are left out, fewer than three give
    null."""
    r = near.groupBy(*keys, "item_id").agg(F.sqrt(F.max(F.when(F.col("place") == 1, F.col("d2")))).alias("r1"), F.sqrt(F.max(F.when(F.col("place") == 2, F.col("d2")))).alias("r2"))
    log = F.when(F.col("r1") > EPS, F.ln(F.col("r2") / F.col("r1") + EPS))
    return r.groupBy(*keys).agg(F.when(F.count(log) >= 3, 1 / (F.avg(log) + EPS)).alias("dimension"))


class _Cosines(Fold):
    def __init__(self):
        self.part, self.pairs = 0.0, 0

    def meet(self, ids_a, a, ids_b, b, same):
        u, v = (x / (np.sqrt((x * x).sum(1, keepdims=True)) + EPS) for x in (a, b))
        for s in range(0, len(u), STRIP):
            c = u[s:s + STRIP] @ v.T
            np.abs(c, out=c)
            if same:
                c[np.arange(len(c)), s + np.arange(len(c))] = 0
            self.part += float(c.sum()) * (1 if same else 2)
        self.pairs += len(a) * (len(a) - 1) if same else 2 * len(a) * len(b)

    def columns(self):
        return {"part": [self.part], "pairs": [self.pairs]}


def mean_abs_cosine(blocks: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """Mean absolute cosine over all pairs of different items; null below two."""
    found = over_pairs(blocks, keys, lambda *_: _Cosines(), "part double, pairs long", each=False)
    with bounded(blocks.sparkSession):
        sums = settled(found.groupBy(*keys).agg(F.sum("part").alias("part"), F.sum("pairs").alias("pairs")))
    return sums.select(*keys, F.when(F.col("pairs") > 0, F.col("part") / F.col("pairs")).alias("mean_abs_cosine"))
