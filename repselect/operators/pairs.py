"""Sums over all pairs of a group's rows, by sorting instead of a join of pairs.

A sum over the pairs (p, q) with p below q in both of two values is found by merging: rows stand in the order of one
value, and at each level of a binary cut of that order the left half's running sums in the order of the other value
give what each row of the right half dominates. Groups of up to ``SMALL`` rows are one call of this kernel. Larger ones
are cut into ranges of either value: pairs in the same range of the first, pairs in the same range of the second only,
and pairs that differ in both, of which only the sums of each cell are needed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repselect.operators.order import running, sorted_parts
from repselect.session import released, settled

#: Distinct rows of a group up to which one task handles it, rows of a range, and most ranges of either value.
SMALL, RANGE, RANGES = 1 << 14, 1 << 16, 1 << 11
#: Rows of both sides up to which all pairs are laid out at once.
FEW = 96


def dominated(x: np.ndarray, y: np.ndarray, gives: np.ndarray, qx: np.ndarray, qy: np.ndarray, takes: np.ndarray):
    """Sum of ``gives[p] . takes[q]`` over all points p and queries q with ``x[p] < qx[q]`` and ``y[p] < qy[q]``."""
    if len(x) <= FEW and len(qx) <= FEW:
        below = (x[:, None] < qx) & (y[:, None] < qy)
        return sum((gives[:, k] @ below @ takes[:, k] for k in range(gives.shape[1])), gives.dtype.type(0))
    n, m = len(x), len(x) + len(qx)
    point = np.repeat([1, 0], [n, m - n])  # among equals the query stands first: no point equal to it is below
    none = np.zeros((m - n, gives.shape[1]), gives.dtype)
    give, take = np.concatenate([gives, none]), np.concatenate([np.zeros((n, takes.shape[1]), takes.dtype), takes])
    place = np.empty(m, np.int64)
    place[np.lexsort((point, np.concatenate([y, qy])))] = np.arange(m)
    order = np.lexsort((point, np.concatenate([x, qx])))
    by_y = np.argsort(place[order])  # positions in the order of x, listed in the order of y
    give, take = give[order], take[order]
    total = gives.dtype.type(0)
    for level in range((m - 1).bit_length()):
        block = by_y >> (level + 1)
        rows = by_y[np.argsort(block, kind="stable")]  # blocks one after the other, each in the order of y
        right = (rows >> level & 1).astype(bool)
        sums = np.cumsum(np.where(right[:, None], gives.dtype.type(0), give[rows]), axis=0)
        starts = (rows >> (level + 1)) << (level + 1)  # a block begins where its first position lies
        before = np.where((starts > 0)[:, None], sums[starts - 1], gives.dtype.type(0))
        total = total + ((sums - before)[right] * take[rows[right]]).sum()
    return total


def pair_sums(points: DataFrame, keys: list[str], x: str, y: str, gives: list[str], queries: DataFrame, takes: list[str], kind: str = "double") -> DataFrame:
    """``keys, total``: ``dominated`` of each group of any size. ``points`` hold ``x, y`` and ``gives``, ``queries``
    ``x, y`` and ``takes`` (as many), as numbers of ``kind`` (``long`` for exact counts). Groups without points or
    queries may lack a row.

    Each range of rows is a task; cells of two ranges are summed before they meet, at most ``RANGES`` squared a group.
    """
    k = range(len(gives))
    zero = F.lit(0).cast(kind)
    events = points.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.lit(1).alias("point"), *[F.col(gives[i]).cast(kind).alias(f"g{i}") for i in k], *[zero.alias(f"t{i}") for i in k]).unionByName(
        queries.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0).alias("point"), *[zero.alias(f"g{i}") for i in k], *[F.col(takes[i]).cast(kind).alias(f"t{i}") for i in k]))
    parts = max(1, min(RANGES, -(-events.count() // RANGE)))
    by_x = sorted_parts(events, keys, ["x", "point", "y"], parts)
    both = sorted_parts(by_x.withColumnRenamed("_part", "bx"), keys, ["y", "point", "x"], parts).withColumnRenamed("_part", "by")
    released(by_x)
    numbers = [f"{s}{i}" for s in "gt" for i in k]
    schema = ", ".join(f"{c} {t}" for c, t in points.select(*keys).dtypes) + f", total {kind}"
    whole = np.int64 if kind == "long" else np.float64

    def kernel(first: str, second: str):
        def run(key, pdf):
            own = lambda side, p: pdf.loc[pdf.point == p, [f"{side}{i}" for i in k]].to_numpy(whole)
            at = lambda c, p: pdf.loc[pdf.point == p, c].to_numpy()
            total = dominated(at(first, 1), at(second, 1), own("g", 1), at(first, 0), at(second, 0), own("t", 0))
            return pd.DataFrame([(*key[:len(keys)], total)], columns=[*keys, "total"])
        return run

    same_x = both.groupBy(*keys, "bx").applyInPandas(kernel("x", "y"), schema)
    same_y = both.groupBy(*keys, "by").applyInPandas(kernel("bx", "y"), schema)
    cells = both.groupBy(*keys, "bx", "by", "point").agg(*[F.sum(c).alias(c) for c in numbers])
    apart = cells.groupBy(*keys).applyInPandas(kernel("bx", "by"), schema)
    return same_x.unionByName(same_y).unionByName(apart).groupBy(*keys).agg(F.sum("total").alias("total"))


def split_by_size(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of groups of up to ``SMALL`` rows, and the others' (None if there are none); settles them."""
    rows = settled(rows)
    large = rows.groupBy(*keys).count().where(F.col("count") > SMALL).drop("count")
    if large.isEmpty():
        return rows, None
    return rows.join(large, keys, "left_anti"), rows.join(large, keys, "left_semi")


def spread(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Average rank of each row among rows of weights ``w``, its sum of distances to all of them, and the sum of
    squared counts of equal values."""
    values, at = np.unique(x, return_inverse=True)
    n = np.bincount(at, w)
    s = n * values
    ahead_n, ahead_s = np.cumsum(n) - n, np.cumsum(s) - s
    rank = ahead_n + (n + 1) / 2
    far = values * (2 * ahead_n + n - n.sum()) + s.sum() - 2 * ahead_s - s
    return rank[at], far[at], float(n @ n)


def correlate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, ...]:
    """``n, sx, sy, pearson, spearman, tau_b, cxx, cyy, cxy`` of distinct rows with integer weights; the last three are
    the squared distance variances and covariance."""
    n = w.sum()
    x, y = x - (w @ x) / n, y - (w @ y) / n
    sx, sy = math.sqrt(max(w @ (x * x) / n, 0)), math.sqrt(max(w @ (y * y) / n, 0))
    (rx, ax, tx), (ry, ay, ty) = spread(x, w), spread(y, w)

    def pearson(a, b):
        a, b = a - (w @ a) / n, b - (w @ b) / n
        size = math.sqrt((w @ (a * a)) * (w @ (b * b)))
        return (w @ (a * b)) / size if size > 0 else math.nan

    whole = w.astype(np.int64)
    up = int(dominated(x, y, whole[:, None], x, y, whole[:, None]))
    return (n, sx, sy, pearson(x, y), pearson(rx, ry), tau_b(n, up, tx, ty, float(w @ w)), *distances(
        n, w @ (x * x), w @ (y * y), w @ (x * y), w @ ax, w @ ay, w @ (ax * ax), w @ (ay * ay), w @ (ax * ay),
        float(dominated(x, y, np.stack([w, w * x, w * y, w * x * y], 1), x, y, np.stack([w * x * y, -w * y, -w * x, w], 1)))))


def tau_b(n: float, up: float, tx: float, ty: float, txy: float) -> float:
    """From rising pairs and the sums of squared counts of equal x, equal y and equal pairs."""
    told = n * n - tx - ty + txy  # ordered pairs that differ in both
    size = math.sqrt((n * n - tx) * (n * n - ty))
    return (4 * up - told) / size if size > 0 else math.nan


def distances(n: float, xx: float, yy: float, xy: float, ax: float, ay: float, axx: float, ayy: float, axy: float, rising: float) -> tuple[float, float, float]:
    """Squared distance variances and covariance (V-statistics) of centred values: ``xx, yy, xy`` sum their products,
    ``a*`` the rows' sums of distances, ``rising`` the products of differences over rising pairs."""
    square = lambda s, a, b, ab: s / n ** 2 - 2 * ab / n ** 3 + a * b / n ** 4
    # products of absolute differences: those of rising pairs count plus, those of falling ones minus
    return square(2 * n * xx, ax, ax, axx), square(2 * n * yy, ay, ay, ayy), square(2 * (2 * rising - n * xy), ax, ay, axy)


#: Columns that ``correlation_parts`` gives.
PARTS = ["n", "sx", "sy", "pearson", "spearman", "tau", "cxx", "cyy", "cxy"]


def correlation_parts(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys`` and ``PARTS`` of each group of any size; ``x`` and ``y`` must be finite doubles.

    Equal pairs are counted first and travel as one row. Sums over pairs are worked out in the group's task up to
    ``SMALL`` distinct rows, beyond it by ``pair_sums`` and running sums over ranges.
    """
    counted = rows.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("w"))
    small, large = split_by_size(counted, keys)
    schema = ", ".join(f"`{c}` {t}" for c, t in counted.select(*keys).dtypes) + ", " + ", ".join(f"{c} double" for c in PARTS)

    def run(key, rows):
        found = correlate(*(rows.column(c).to_numpy().astype(float) for c in ("x", "y", "w")))
        return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip(keys, key)}, **{c: [float(v)] for c, v in zip(PARTS, found)}})

    found = small.groupBy(*keys).applyInArrow(run, schema)
    return found if large is None else found.unionByName(_large_parts(large, keys, schema))


def _large_parts(counted: DataFrame, keys: list[str], schema: str) -> DataFrame:
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    means = counted.groupBy(*keys).agg(mean("x").alias("mx"), mean("y").alias("my"), F.sum("w").alias("n"))
    rows = counted.join(means, keys).select(*keys, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "w", "n")
    marked = rows
    for c in "xy":
        counts = rows.groupBy(*keys, c).agg(F.sum("w").alias("v")).withColumn("s", F.col("v") * F.col(c))
        ends = running(sorted_parts(counts, keys, [c]), keys, ["v", "s"]).drop("_part")
        total = counts.groupBy(*keys).agg(F.sum("s").alias("all_s"))
        marked = marked.join(ends, [*keys, c]).join(total, keys).withColumn(f"r{c}", F.col("ahead_v") + (F.col("v") + 1) / 2).withColumn(
            f"a{c}", F.col(c) * (2 * F.col("ahead_v") + F.col("v") - F.col("n")) + F.col("all_s") - 2 * F.col("ahead_s") - F.col("s")).withColumn(
            f"e{c}", F.col("v").cast("double")).drop("v", "s", "ahead_v", "ahead_s", "all_s")
    w = F.col("w")
    total = lambda a, b: F.sum(w * F.col(a) * F.col(b))
    sums = marked.groupBy(*keys).agg(
        F.sum(w).cast("double").alias("n"), total("x", "x").alias("xx"), total("y", "y").alias("yy"), total("x", "y").alias("xy"), F.sum(w * F.col("ax")).alias("ax"), F.sum(w * F.col("ay")).alias("ay"),
        total("ax", "ax").alias("axx"), total("ay", "ay").alias("ayy"), total("ax", "ay").alias("axy"), F.sum(w * F.col("ex")).alias("tx"), F.sum(w * F.col("ey")).alias("ty"), F.sum(w * w).cast("double").alias("txy"),
        F.sum(w * F.col("rx")).alias("r"), total("rx", "rx").alias("rxx"), total("ry", "ry").alias("ryy"), total("rx", "ry").alias("rxy"))
    products = rows.select(*keys, "x", "y", "w", *[(w * F.col(c)).alias(f"w{c}") for c in "xy"], (w * F.col("x") * F.col("y")).alias("wxy"), *[(-w * F.col(c)).alias(f"m{c}") for c in "xy"])
    up = pair_sums(rows, keys, "x", "y", ["w"], rows, ["w"], "long").withColumnRenamed("total", "up")
    rising = pair_sums(products, keys, "x", "y", ["w", "wx", "wy", "wxy"], products, ["wxy", "my", "mx", "w"]).withColumnRenamed("total", "rising")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                flat = r.rxx * r.n - r.r * r.r, r.ryy * r.n - r.r * r.r
                size, ranks = math.sqrt(max(r.xx * r.yy, 0)), math.sqrt(max(flat[0] * flat[1], 0))
                out.append((*(getattr(r, c) for c in keys), r.n, math.sqrt(r.xx / r.n), math.sqrt(r.yy / r.n), r.xy / size if size > 0 else math.nan, (r.rxy * r.n - r.r * r.r) / ranks if ranks > 0 else math.nan,
                            tau_b(r.n, r.up, r.tx, r.ty, r.txy), *distances(r.n, r.xx, r.yy, r.xy, r.ax, r.ay, r.axx, r.ayy, r.axy, r.rising)))
            yield pd.DataFrame(out, columns=[*keys, *PARTS])

    return sums.join(up, keys, "left").join(rising, keys, "left").fillna(0, ["up", "rising"]).mapInPandas(run, schema)


#: Columns that ``preference_parts`` gives: pairs told apart by both values, of them rightly ordered, both also
#: within a model, and pairs told apart by utility.
PREFERENCE = ["told", "right", "told_within", "right_within", "useful"]


def preference_parts(rows: DataFrame, keys: list[str], s: str, u: str, m: str, eps: float) -> DataFrame:
    """``keys`` and ``PREFERENCE`` as counts, of each group of any size; values must be finite doubles.

    Values differ if they are more than ``eps`` apart, as double precision tells: p is below q in a value if it
    is less than q's value minus ``eps``.
    """
    counted = rows.groupBy(*keys, F.col(m).alias("m"), F.col(s).alias("s"), F.col(u).alias("u")).agg(F.count("*").alias("w"))
    small, large = split_by_size(counted, keys)
    schema = ", ".join(f"`{c}` {t}" for c, t in counted.select(*keys).dtypes) + ", " + ", ".join(f"{c} long" for c in PREFERENCE)

    def run(key, rows):
        a, b, w = (rows.column(c).to_numpy() for c in ("s", "u", "w"))
        model = rows.column("m").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

        def ordered(own):
            x, y, n = a[own], b[own], w[own][:, None]
            up, down = dominated(x, y, n, x - eps, y - eps, n), dominated(x, -y, n, x - eps, -y - eps, n)
            return int(up + down), int(up)

        within = np.sum([ordered(model == m) for m in np.unique(model)], axis=0)
        useful = dominated(b, b, w[:, None], b - eps, b - eps, w[:, None])
        found = *ordered(slice(None)), *map(int, within), int(useful)
        return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip(keys, key)}, **{c: [v] for c, v in zip(PREFERENCE, found)}})

    found = small.groupBy(*keys).applyInArrow(run, schema)
    if large is None:
        return found
    whole = large.withColumn("_n", -F.col("u"))
    lowered = whole.select(*keys, "m", *[(F.col(c) - eps).alias(c) for c in ("s", "u", "_n")], "w")
    named = lambda on, a, b, name: pair_sums(whole, on, a, b, ["w"], lowered, ["w"], "long").groupBy(*keys).agg(F.sum("total").alias(name))
    out = named(keys, "u", "u", "useful")
    for on, end in ((keys, ""), ([*keys, "m"], "_within")):
        out = out.join(named(on, "s", "u", f"up{end}"), keys, "left").join(named(on, "s", "_n", f"down{end}"), keys, "left")
    out = out.fillna(0)
    return found.unionByName(out.select(
        *keys, (F.col("up") + F.col("down")).alias("told"), F.col("up").alias("right"), (F.col("up_within") + F.col("down_within")).alias("told_within"), F.col("up_within").alias("right_within"), "useful"))
