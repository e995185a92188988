"""Column helpers: missing values, ranks, hashes, names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-12


def finite(c: str | Column) -> Column:
    """True where a number is neither null, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def number(c: str | Column) -> Column:
    """The number, or null where it is missing or not finite."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(finite(c), c)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, NaN as null and no negative zero, as results are compared."""
    return df.select(*[(F.round(F.when(~F.isnan(c), F.col(c)), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def average_rank(keys: list[str], by: str, descending: bool = False) -> Column:
    """Rank within ``keys``; equal values share the mean of their places."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, by)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson of a group; null where either side is flat."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))


def is_close(x: Column, y: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(x - y) <= atol + rtol * F.abs(y)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the joined parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def stable_hash(*names: str, length: int = 20) -> Column:
    """SHA-256 of the canonical JSON (keys sorted) of the columns, cut to ``length`` hex digits."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(names))), 256), 1, length)


def stable_seed(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by ``||``, modulo 2^31 - 1."""
    h = F.sha2(F.concat_ws("||", *[p.cast("string") for p in parts]), 256)
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("decimal(20,0)")
    return ((half(1) * F.lit(4294967296).cast("decimal(20,0)") + half(9)) % F.lit(2147483647).cast("decimal(20,0)")).cast("long")


def text_from_row(preferred: str, others: list[str]) -> Column:
    """The preferred column trimmed, or the first four non-blank others joined by a blank."""
    trimmed = F.array(*[F.trim(F.col(c)) for c in others])
    return F.coalesce(F.when(F.trim(preferred) != "", F.trim(preferred)), F.array_join(F.slice(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")), 1, 4), " "))


#: Fixed aliases of task families; the longest alias inside a name decides.
FAMILY_ALIASES = {
    "pairclassification": "PairClassification", "pair": "PairClassification", "classification": "Classification", "clustering": "Clustering", "cluster": "Clustering", "sts": "STS", "similarity": "STS"}


def family_of(name: Column) -> Column:
    """Family by the longest alias in the name, punctuation and case aside; null without one."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    found = F.lit(None).cast("string")
    for alias, family in sorted(FAMILY_ALIASES.items(), key=lambda kv: (len(kv[0]), kv[0])):
        found = F.when(F.contains(plain, F.lit(alias)), family).otherwise(found)
    return found


def display_name(feature: Column) -> Column:
    """A metric's name for print: known ones as listed, others with initial capitals."""
    known = {"harmonic": "Harmonic score", "spectral_gap": "Spectral gap", "infonce": "InfoNCE", "lidar": "LiDAR", "dime": "DiME"}
    out = F.initcap(F.regexp_replace(feature, "[_-]+", " "))
    for token, name in known.items():
        out = F.when(F.lower(feature) == token, name).otherwise(out)
    return out


def keep_if_any(df: DataFrame, match: Column) -> DataFrame:
    """The rows that match, or all rows if none does."""
    marked = df.withColumn("_m", F.coalesce(match, F.lit(False)))
    some = marked.agg(F.max("_m").alias("_some"))  # one row
    return marked.join(F.broadcast(some)).where(F.col("_m") | ~F.col("_some")).drop("_m", "_some")


def t_quantile(p: float, df: int) -> float:
    """Student-t quantile, by bisection of the distribution function in closed form (whole ``df``)."""
    def cdf(t: float) -> float:
        a = math.atan2(t, math.sqrt(df))
        c, s = math.cos(a), math.sin(a)
        if df % 2:
            total, term = 0.0, c
            for k in range(1, (df - 1) // 2 + 1):
                total += term
                term *= 2 * k / (2 * k + 1) * c * c
            return 0.5 + (a + s * total) / math.pi
        total, term = 0.0, 1.0
        for k in range(1, df // 2 + 1):
            total += term
            term *= (2 * k - 1) / (2 * k) * c * c
        return 0.5 + s * total / 2
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


T_TABLE = {k: round(t_quantile(0.975, k), 10) for k in range(1, 121)}


#: Normal quantile and the coefficients of its expansion in inverse degrees of freedom.
Z_975 = 1.959963984540054
T_SERIES = [
    (Z_975 ** 3 + Z_975) / 4, (5 * Z_975 ** 5 + 16 * Z_975 ** 3 + 3 * Z_975) / 96, (3 * Z_975 ** 7 + 19 * Z_975 ** 5 + 17 * Z_975 ** 3 - 15 * Z_975) / 384,
    (79 * Z_975 ** 9 + 776 * Z_975 ** 7 + 1482 * Z_975 ** 5 - 1920 * Z_975 ** 3 - 945 * Z_975) / 92160]


def t_975(n: Column) -> Column:
    """97.5 % quantile for ``n - 1`` degrees of freedom: tabled up to 120, by series (to ten digits) beyond."""
    table = F.array(*[F.lit(T_TABLE[k]) for k in sorted(T_TABLE)])
    inverse = 1.0 / (n - 1)
    far = F.lit(Z_975)
    for power, c in enumerate(T_SERIES, 1):
        far = far + c * F.pow(inverse, F.lit(power))
    return F.when(n > 1, F.coalesce(F.get(table, (n - 2).cast("int")), far))


def content_hash(*parts: Column) -> Column:
    """Aggregate: a hash of all rows of a group, whatever their order; a position among ``parts`` makes it one of
    an ordered array. The rows' MD5 digits are added up in two halves, so nothing is collected."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    half = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.md5(F.concat_ws(":", F.count("*").cast("string"), half(1), half(13)))
