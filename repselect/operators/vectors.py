"""Label-free metrics of candidate representations.

A candidate is one (model, task, layer). Metrics that need only sums over items are taken from one pass of
partial Gram sums. Metrics over pairs of items or graph spectra work on a bounded sample, as the sampling
operators draw it: a candidate of more than ``N_EXACT`` items is refused, never cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from repselect.operators.order import running, sorted_parts
from repselect.operators.tiles import CANDIDATE, EPS, squared_distances

N_EXACT = 4096


# rows


def row_norm(v):
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize_rows(reps: DataFrame, eps: float = EPS) -> DataFrame:
    norm = row_norm(F.col("vec")) + eps
    return reps.withColumn("_n", norm).withColumn("vec", F.transform("vec", lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def standardize(reps: DataFrame, keys: list[str] = CANDIDATE, eps: float = 1e-6, scale: bool = True) -> DataFrame:
    """Centred features, over their sample deviation plus ``eps`` if ``scale``."""
    stats = reps.select(*keys, F.posexplode("vec").alias("d", "x")).groupBy(*keys, "d").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    arrays = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("d", "m", "s"))).alias("_st"))
    width = (lambda s: s["s"] + eps) if scale else (lambda s: F.lit(1.0))
    return reps.join(arrays, keys).withColumn("vec", F.zip_with("vec", "_st", lambda x, s: (x.cast("double") - s["m"]) / width(s))).drop("_st")


def cosine_pairs(pairs: DataFrame, a: str = "vec_a", b: str = "vec_b") -> DataFrame:
    """``cosine`` of row-aligned pairs, norms at least 1e-12."""
    return pairs.withColumn("cosine", dot(F.col(a), F.col(b)) / (F.greatest(row_norm(F.col(a)), F.lit(EPS)) * F.greatest(row_norm(F.col(b)), F.lit(EPS))))


# one pass


def gram_sums(reps: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """``n, d, s, g``: count, dimension, sum vector and uncentred Gram matrix of each candidate. Every batch
    is summed where it is read; only d x d partial sums are shuffled."""

    def partial(batches):
        for pdf in batches:
            rows = []
            for key, own in pdf.groupby(keys, sort=False):
                x = np.stack(own.vec.to_numpy()).astype(float)
                u = x / (np.sqrt((x * x).sum(1, keepdims=True)) + EPS)
                rows.append((*key, len(x), x.shape[1], x.sum(0), (x.T @ x).ravel(), u.sum(0), float((u * u).sum())))
            yield pd.DataFrame(rows, columns=[*keys, "n", "d", "s", "g", "us", "uu"])

    schema = ", ".join(f"{k} {t}" for k, t in reps.select(*keys).dtypes) + ", n long, d int, s array<double>, g array<double>, us array<double>, uu double"
    parts = reps.select(*keys, "vec").mapInPandas(partial, schema)

    def merge(key, pdf):
        add = lambda c: np.sum(np.stack(pdf[c].to_numpy()), axis=0)
        return pd.DataFrame([(*key, int(pdf.n.sum()), int(pdf.d.iloc[0]), add("s"), add("g"), add("us"), float(pdf.uu.sum()))], columns=[*keys, "n", "d", "s", "g", "us", "uu"])

    # two levels, so that a candidate of many batches is not merged by one task alone
    salted = parts.withColumn("_salt", F.spark_partition_id() % 16)
    first = salted.groupBy(*keys, "_salt").applyInPandas(lambda key, pdf: merge(key[:-1], pdf), schema)
    return first.groupBy(*keys).applyInPandas(merge, schema)


def gram_metrics(reps: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """Participation ratio (raw, normalised, inverse), anisotropy and covariance concentration."""

    def measure(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n, d, s = r.n, r.d, np.asarray(r.s)
                g = np.asarray(r.g).reshape(d, d) - np.outer(s, s) / n
                c = g / max(n - 1, 1)
                trace, square = np.trace(c), (c * c).sum()
                pr = trace * trace / square if square > EPS else np.nan
                us = np.asarray(r.us)
                top = np.linalg.eigvalsh(c)[-1]
                rows.append((*(getattr(r, k) for k in keys), pr, pr / max(1, min(n - 1, d)), 1 / pr if pr else np.nan,
                             (us @ us - r.uu) / (n * (n - 1)) if n > 1 else np.nan, top / trace if trace > EPS else np.nan))
            yield pd.DataFrame(rows, columns=[*keys, "participation_ratio", "participation_norm", "participation_inverse", "anisotropy", "concentration"])

    kinds = ", ".join(f"{k} {t}" for k, t in reps.select(*keys).dtypes)
    return gram_sums(reps, keys).mapInPandas(measure, f"{kinds}, participation_ratio double, participation_norm double, participation_inverse double, anisotropy double, concentration double")


def _by_sums(wide: DataFrame, keys: list[str], measure: Callable) -> DataFrame:
    """``metric, field, value, error`` of ``measure(row)``, which names the metric and its numbers, for each row."""
    schema = _schema(wide, keys)

    def run(batches):
        for pdf in batches:
            rows = [(*(getattr(r, k) for k in keys), name, field, float(v), None) for r in pdf.itertuples(index=False) for name, found in [measure(r)] for field, v in found.items()]
            yield pd.DataFrame(rows, columns=[*keys, "metric", "field", "value", "error"])

    return wide.mapInPandas(run, schema)


def entropy_metrics(reps: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """``matrix_entropy`` of candidates with any number of items. Where a candidate has more items than dimensions,
    its Gram matrix is that of the features, which is summed in one pass; others have at most ``d`` items, and the
    kernel gets them."""
    sums = gram_sums(reps, keys)
    wide = _by_sums(sums.where("n > d").select(*keys, "n", "d", "g"), keys, lambda r: ("matrix_entropy", entropy_of(renyi(np.reshape(r.g, (r.d, r.d))), r.n, r.d)))
    narrow = reps.join(sums.where("n <= d").select(*keys), keys, "left_semi")
    return wide.unionByName(score_candidates(narrow, ["matrix_entropy"], keys))


def dime_metrics(views: DataFrame, keys: list[str] = CANDIDATE, rounds: int = 10, seed: int = 0) -> DataFrame:
    """``dime`` of two views (``view_id`` 0 and 1) of any number of items, from the sums of both Gram matrices."""
    a, b = (gram_sums(views.where(F.col("view_id") == k), keys).select(*keys, "n", "d", F.col("g").alias(f"g{k}")) for k in (0, 1))
    sums = a.join(b.drop("n", "d"), keys)
    wide = _by_sums(sums.where("n > d"), keys, lambda r: ("dime", dime_of(np.reshape(r.g0, (r.d, r.d)), np.reshape(r.g1, (r.d, r.d)), rounds, seed)))
    narrow = views.join(sums.where("n <= d").select(*keys), keys, "left_semi")
    return wide.unionByName(score_view_pairs(narrow, ["dime"], keys))


def lidar_metrics(views: DataFrame, keys: list[str] = CANDIDATE, delta: float = 1e-4) -> DataFrame:
    """``lidar`` of any number of items with as many views each: an item's few views are averaged, and the scatter
    within and between items follows from the Gram sums of all views and of the means."""
    total = lambda v: F.aggregate(F.slice(v, 2, F.size(v) - 1), F.transform(v[0], lambda x: x.cast("double")), lambda a, x: F.zip_with(a, x, lambda p, q: p + q.cast("double")))
    lists = views.groupBy(*keys, "item_id").agg(F.collect_list("vec").alias("_v")).withColumn("_n", F.size("_v"))
    means = lists.withColumn("_s", total(F.col("_v"))).select(*keys, F.transform("_s", lambda x: x / F.col("_n")).alias("vec"))
    each = gram_sums(views, keys).select(*keys, "d", F.col("n").alias("rows"), F.col("g").alias("all"))
    both = each.join(gram_sums(means, keys).select(*keys, "n", "s", "g"), keys)

    def measure(r):
        own, d = np.reshape(r.g, (r.d, r.d)), r.d
        a = r.rows / r.n
        between = (own - np.outer(r.s, r.s) / r.n) / max(r.n - 1, 1)
        within = (np.reshape(r.all, (d, d)) - a * own) / max(r.n * (a - 1), 1)
        return "lidar", lidar_of(between, within, delta)

    return _by_sums(both, keys, measure)


# kernels of one candidate: matrix (n x d, float64) -> numbers


def affinity(z: np.ndarray, k_nn: int = 0) -> np.ndarray:
    """Gaussian weights at the median bandwidth, zero diagonal, symmetric."""
    d2 = np.maximum(squared_distances(z, z), 0)
    upper = d2[np.triu_indices(len(z), 1)]
    upper = np.sort(upper[upper > 0])
    tau2 = max(0.5 * upper[(len(upper) - 1) // 2], EPS) if len(upper) else 1.0
    w = np.exp(-d2 / (2 * tau2 + EPS))
    np.fill_diagonal(w, 0)
    if 0 < k_nn < len(z) - 1:
        far = np.argsort(-w, axis=1, kind="stable")[:, k_nn:]
        np.put_along_axis(w, far, 0.0, axis=1)
    return (w + w.T) / 2


def laplacian(w: np.ndarray) -> np.ndarray:
    s = 1 / np.sqrt(np.maximum(w.sum(1), EPS))
    return np.eye(len(w)) - s[:, None] * w * s[None, :]


#: The last candidate's items, Laplacian (None without a graph) and spectra, so that several metrics share them.
_LAST: dict = {"x": None}


def graph(x: np.ndarray) -> np.ndarray | None:
    """Laplacian of the centred items; None if there is no graph."""
    if _LAST["x"] is not x:
        w = affinity(x - x.mean(0)) if len(x) > 1 else np.zeros((len(x), len(x)))
        _LAST.clear()
        _LAST.update(x=x, lap=laplacian(w) if w.sum() > EPS else None)
    return _LAST["lap"]


def spectrum(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """All eigenvalues and modes of the Laplacian; None if there is no graph."""
    lap = graph(x)
    if lap is not None and "full" not in _LAST:
        _LAST["full"] = np.linalg.eigh(lap)
    return _LAST.get("full")


def lanczos(matrix: np.ndarray, m: int, tol: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` smallest eigenvalues and their vectors of a symmetric matrix, by block Lanczos.

    Blocks are ``m`` wide, so that an eigenvalue wanted is found as often as it occurs. Each block is orthogonalised
    against the whole basis, twice; directions that a block lacks are drawn anew. It ends when the residuals of all
    wanted vectors are below ``tol``, at the latest when the basis is complete and the result that of a full solver.
    """
    n = len(matrix)
    m = min(m, n)
    rng = np.random.default_rng(seed)
    basis = np.zeros((n, 0))
    image = np.zeros((n, 0))
    block = rng.normal(size=(n, m))
    while True:
        block = block[:, :n - basis.shape[1]]
        for _ in range(2):
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
            weak = np.linalg.norm(basis.T @ block, axis=0) > 1e-8  # what was left of it was rounding
            if weak.any():
                block[:, weak] = rng.normal(size=(n, weak.sum()))
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        basis, image = np.hstack([basis, block]), np.hstack([image, matrix @ block])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[:m], turn[:, :m]
        if basis.shape[1] >= 3 * m or basis.shape[1] == n:
            rest = image @ turn - (basis @ turn) * values
            if basis.shape[1] == n or np.linalg.norm(rest, axis=0).max() <= tol:
                return values, basis @ turn
        block = image[:, -block.shape[1]:]


def modes(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The ``m`` smallest eigenvalues and modes of the Laplacian, all of them if they are more than an eighth."""
    lap = graph(x)
    if lap is None:
        return None
    if 8 * m > len(lap) or "full" in _LAST:
        values, vectors = spectrum(x)
        return values[:m], vectors[:, :m]
    if _LAST.get("part", (np.zeros(0),))[0].size < m:
        _LAST["part"] = lanczos(lap, m)
    values, vectors = _LAST["part"]
    return values[:m], vectors[:, :m]


def harmonic_modes(x: np.ndarray, k: int, scale: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, energies) of the ``k`` first non-constant modes; empty if there is no graph."""
    if len(x) < 3:
        return np.zeros(0), np.zeros(0)
    z = x - x.mean(0)
    if scale:
        z = z / (z.std(0, ddof=1) + EPS)
    found = modes(z if scale else x, min(k + 2, len(x)))
    if found is None:
        return np.zeros(0), np.zeros(0)
    values, vectors = found[0][1:k + 1], found[1][:, 1:k + 1]
    return np.maximum(values, 0), ((z.T @ vectors) ** 2).sum(0) / z.shape[1]


def harmonic_score(x: np.ndarray, k: int = 10, sigma2: float = 1.0) -> dict[str, float]:
    lam, energy = harmonic_modes(x, max(k, 9))
    if not len(lam):
        return {"score": np.nan}
    top = slice(0, min(k, len(lam)))
    rho = 1 / max(sigma2, EPS) + lam[top]
    return {"score": float(np.log1p((rho * energy[top]).sum())), "lambda2": float(lam[0]), "lambda10": float(lam[8]) if len(lam) > 8 else np.nan,
            "energy_sum": float(energy[top].sum()), "precision_mean": float(rho.mean()), "selected_k": float(len(rho)), "n_modes_available": float(len(x) - 1)}


def spectral_gap(x: np.ndarray) -> dict[str, float]:
    lap = graph(x)
    if lap is None:
        return {"lambda2": np.nan, "lambda3": np.nan, "n_components": float(len(x)), "spectral_entropy": np.nan}
    values = np.maximum(_LAST["full"][0] if "full" in _LAST else np.linalg.eigvalsh(lap), 0)
    rest = values[1:] / max(values[1:].sum(), EPS)
    return {"lambda2": float(values[1]) if len(values) > 1 else np.nan, "lambda3": float(values[2]) if len(values) > 2 else np.nan, "n_components": float((values <= 1e-6).sum()),
            "spectral_entropy": float(-(rest[rest > EPS] * np.log(rest[rest > EPS])).sum())}


def renyi(gram: np.ndarray, alpha: float = 1.0) -> float:
    """Entropy of the trace-normalised Gram matrix, negative entries set to zero."""
    k = np.maximum(gram, 0)
    k = k / max(np.trace(k), EPS)
    p = np.linalg.eigvalsh(k)
    p = p[p > EPS]
    return float(-(p * np.log(p)).sum()) if alpha == 1 else float(np.log((p ** alpha).sum()) / (1 - alpha))


def matrix_entropy(x: np.ndarray) -> dict[str, float]:
    n, d = x.shape
    return entropy_of(renyi(x.T @ x if n > d else x @ x.T), n, d)


def entropy_of(e: float, n: int, d: int) -> dict[str, float]:
    """The normalisations of an entropy."""
    return {"raw": e, "max_entropy": e / np.log(max(min(n, d), 2)), "log_n": e / np.log(max(n, 2)), "log_d": e / np.log(max(d, 2)), "log_nd": e / (np.log(max(n, 2)) * np.log(max(d, 2))), "length": e / n}


def two_nn(x: np.ndarray) -> dict[str, float]:
    if len(x) < 3:
        return {"dimension": np.nan}
    d2 = np.maximum(squared_distances(x, x), 0)
    np.fill_diagonal(d2, np.inf)
    r = np.sqrt(np.sort(d2, axis=1)[:, :2])
    r = r[r[:, 0] > EPS]
    return {"dimension": float(1 / (np.log(r[:, 1] / r[:, 0] + EPS).mean() + EPS)) if len(r) >= 3 else np.nan}


def abs_cosine(x: np.ndarray) -> dict[str, float]:
    u = x / (np.sqrt((x * x).sum(1, keepdims=True)) + EPS)
    c = np.abs(u @ u.T)
    n = len(x)
    return {"mean_abs_cosine": float((c.sum() - np.trace(c)) / (n * (n - 1))) if n > 1 else np.nan}


def info_nce(a: np.ndarray, b: np.ndarray, temperature: float = 0.1) -> dict[str, float]:
    u, v = (x / (np.sqrt((x * x).sum(1, keepdims=True)) + EPS) for x in (a, b))
    logits = u @ v.T / temperature
    top = logits.max(1, keepdims=True)
    loss = float((np.log(np.exp(logits - top).sum(1)) + top[:, 0] - np.diag(logits)).mean())
    return {"loss": loss, "bound": 1 - loss / np.log(max(len(a), 2))}


def dime(a: np.ndarray, b: np.ndarray, rounds: int = 10, seed: int = 0) -> dict[str, float]:
    """Mean entropy of the product of Gram matrices over random pairings less that of the true pairing."""
    return dime_of(*((a @ a.T, b @ b.T) if len(a) <= a.shape[1] else (a.T @ a, b.T @ b)), rounds, seed)


def dime_of(ga: np.ndarray, gb: np.ndarray, rounds: int = 10, seed: int = 0) -> dict[str, float]:
    rng = np.random.default_rng(seed)
    other = []
    for _ in range(rounds):
        p = rng.permutation(len(gb))
        other.append(renyi(ga * gb[np.ix_(p, p)]))
    return {"doe": float(np.mean(other) - renyi(ga * gb))}


def lidar(views: np.ndarray, delta: float = 1e-4) -> dict[str, float]:
    """Entropy of the whitened between-item scatter of ``views`` (items x views x d)."""
    n, a, d = views.shape
    mean = views.mean(1)
    centred = mean - mean.mean(0)
    between = centred.T @ centred / max(n - 1, 1)
    rest = (views - mean[:, None]).reshape(-1, d)
    return lidar_of(between, rest.T @ rest / max(n * (a - 1), 1), delta)


def lidar_of(between: np.ndarray, within: np.ndarray, delta: float = 1e-4) -> dict[str, float]:
    values, basis = np.linalg.eigh(within + delta * np.eye(len(within)))
    white = basis @ np.diag(1 / np.sqrt(np.maximum(values, delta))) @ basis.T
    p = np.maximum(np.linalg.eigvalsh(white @ between @ white), 0)
    p = p / max(p.sum(), EPS)
    p = p[p > EPS]
    return {"score": float(np.exp(-(p * np.log(p)).sum()))}


def partial_validation(reps: DataFrame, k: int = 10, sigma2: float = 1.0, keys: list[str] = CANDIDATE) -> DataFrame:
    """The partial solver (``k + 2`` modes) against the full one: relative error of the score, the largest error of an
    eigenvalue, the error of the projector on the ``k`` modes (Frobenius, over the square root of 2k), the gap
    behind the last of them, and whether score and projector are within 1e-6 and 1e-5. Nulls below ``k + 3`` items."""
    fields = ["score_error", "eigenvalue_error", "projector_error", "boundary_gap"]

    def run(key, pdf):
        x = _matrix(pdf)
        lap = graph(x)
        if lap is None or len(x) < k + 3:
            return pd.DataFrame([(*key, *[np.nan] * 4, None)], columns=[*keys, *fields, "passed"])
        z = x - x.mean(0)
        part, full = lanczos(lap, k + 2), np.linalg.eigh(lap)
        score = lambda v, q: np.log1p(((1 / sigma2 + np.maximum(v[1:k + 1], 0)) * ((z.T @ q[:, 1:k + 1]) ** 2).sum(0) / z.shape[1]).sum())
        own, true = score(*part), score(*full)
        p, q = part[1][:, 1:k + 1], full[1][:, 1:k + 1]
        error, turned = abs(own - true) / max(abs(true), 1e-15), np.linalg.norm(p @ p.T - q @ q.T) / np.sqrt(2 * k)
        found = error, np.abs(part[0] - full[0][:k + 2]).max(), turned, full[0][k + 1] - full[0][k]
        return pd.DataFrame([(*key, *found, bool(error <= 1e-6 and turned <= 1e-5))], columns=[*keys, *fields, "passed"])

    kinds = ", ".join(f"{c} {t}" for c, t in reps.select(*keys).dtypes)
    return reps.select(*keys, "item_id", "vec").groupBy(*keys).applyInPandas(run, f"{kinds}, {', '.join(f'{c} double' for c in fields)}, passed boolean")


#: Metrics of a single view by name; ``register`` adds others.
REGISTRY: dict[str, Callable[[np.ndarray], dict[str, float]]] = {
    "harmonic": harmonic_score, "spectral_gap": spectral_gap, "matrix_entropy": matrix_entropy, "two_nn": two_nn, "abs_cosine": abs_cosine}
PAIR_REGISTRY: dict[str, Callable[[np.ndarray, np.ndarray], dict[str, float]]] = {"infonce": info_nce, "dime": dime}


def register(name: str, kernel: Callable[[np.ndarray], dict[str, float]]) -> None:
    """A metric of one's own: a function of the candidate's matrix to named numbers."""
    REGISTRY[name] = kernel


def _run(names, registry, arrays, key, keys, strict):
    rows = []
    for name in names:
        try:
            rows += [(*key, name, field, float(v), None) for field, v in registry[name](*arrays).items()]
        except Exception as error:
            if strict:
                raise
            rows.append((*key, name, None, None, str(error)))
    return pd.DataFrame(rows, columns=[*keys, "metric", "field", "value", "error"])


def _schema(reps, keys):
    return ", ".join(f"{k} {t}" for k, t in reps.select(*keys).dtypes) + ", metric string, field string, value double, error string"


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    if len(pdf) > N_EXACT:
        raise ValueError(f"a candidate has {len(pdf)} items; draw at most {N_EXACT} first")
    return np.stack(pdf.sort_values("item_id", kind="stable").vec.to_numpy()).astype(float)


def score_candidates(reps: DataFrame, metrics: list[str] | None = None, keys: list[str] = CANDIDATE, strict: bool = False) -> DataFrame:
    """``metric, field, value, error`` of each candidate; a metric that fails gives a row with its error
    (or raises, if ``strict``). Items stand in the order of ``item_id``."""
    names, registry = metrics or list(REGISTRY), dict(REGISTRY)
    return reps.select(*keys, "item_id", "vec").groupBy(*keys).applyInPandas(lambda key, pdf: _run(names, registry, (_matrix(pdf),), key, keys, strict), _schema(reps, keys))


def score_view_pairs(views: DataFrame, metrics: list[str] | None = None, keys: list[str] = CANDIDATE, strict: bool = False) -> DataFrame:
    """Metrics of two views (``view_id`` 0 and 1) of the same items."""
    names, registry = metrics or list(PAIR_REGISTRY), dict(PAIR_REGISTRY)

    def run(key, pdf):
        both = [_matrix(pdf[pdf.view_id == k]) for k in (0, 1)]
        return _run(names, registry, both, key, keys, strict)

    return views.select(*keys, "item_id", "view_id", "vec").groupBy(*keys).applyInPandas(run, _schema(views, keys))


def score_lidar(views: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    def run(key, pdf):
        wide = pdf.sort_values(["item_id", "view_id"], kind="stable")
        n = wide.item_id.nunique()
        if n > N_EXACT:
            raise ValueError(f"a candidate has {n} items; draw at most {N_EXACT} first")
        x = np.stack(wide.vec.to_numpy()).astype(float)
        return _run(["lidar"], {"lidar": lambda v: lidar(v)}, (x.reshape(n, -1, x.shape[1]),), key, keys, False)

    return views.select(*keys, "item_id", "view_id", "vec").groupBy(*keys).applyInPandas(run, _schema(views, keys))


def harmonic_curves(reps: DataFrame, k_max: int = 80, sigma2: float = 1.0, keys: list[str] = CANDIDATE) -> DataFrame:
    """``k, lambda, energy, rho, mass, h_k``: the score for every number of modes up to ``k_max``."""

    def curve(key, pdf):
        lam, energy = harmonic_modes(_matrix(pdf), k_max)
        return pd.DataFrame({**{k: [v] * len(lam) for k, v in zip(keys, key)}, "k": np.arange(1, len(lam) + 1), "lambda": lam, "energy": energy})

    kinds = ", ".join(f"{k} {t}" for k, t in reps.select(*keys).dtypes)
    found = reps.select(*keys, "item_id", "vec").groupBy(*keys).applyInPandas(curve, f"{kinds}, k int, lambda double, energy double")
    return curve_of_modes(found, keys, sigma2)


def curve_of_modes(modes: DataFrame, keys: list[str] = CANDIDATE, sigma2: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*keys)
    up = w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return modes.withColumn("rho", 1.0 / sigma2 + F.col("lambda")).withColumn("mass", F.sum(F.col("rho") * F.col("energy")).over(up) / F.sum(F.col("rho") * F.col("energy")).over(w)).withColumn("h_k", F.log1p(F.sum(F.col("rho") * F.col("energy")).over(up)))


def components(reps: DataFrame, k: int = 10, keys: list[str] = CANDIDATE) -> DataFrame:
    """``a, c``: retained energy and Laplacian energy of the first ``k`` modes, with range of eigenvalues."""
    curve = harmonic_curves(reps, k, 1.0, keys)
    return curve.groupBy(*keys).agg(F.sum("energy").alias("a"), F.sum(F.col("lambda") * F.col("energy")).alias("c"), F.avg("lambda").alias("mean_lambda"), F.min("lambda").alias("lambda_min"), F.max("lambda").alias("lambda_max"))


#: Consecutive items that one task measures.
RUN = 4096


def curvature(reps: DataFrame, k: int = 1, keys: list[str] = CANDIDATE) -> DataFrame:
    """Mean angle between steps of ``k`` items in item order; null below ``2k + 1`` items.

    Items get their position by running counts over range partitions; runs of ``RUN`` items are measured by themselves,
    each with the ``k`` items on either side of it.
    """
    rows = reps.select(*keys, "item_id", F.col("vec").cast("array<double>").alias("vec"), F.lit(1).alias("one"))
    at = F.col("ahead_one").cast("long")
    spread = running(sorted_parts(rows, keys, ["item_id"]), keys, ["one"]).select(*keys, at.alias("at"), "vec")
    home = F.expr(f"at div {RUN}")
    blocks = F.array_distinct(F.array(home, F.expr(f"(at + {k}) div {RUN}"), F.greatest(F.expr(f"(at - {k}) div {RUN}"), F.lit(0))))
    sent = spread.select(*keys, "at", "vec", F.explode(blocks).alias("block"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in reps.select(*keys).dtypes)

    def run(key, table):
        at = table.column("at").to_numpy()
        order = np.argsort(at)
        at = at[order]
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vec").chunks]).reshape(len(at), -1)[order]
        i = np.flatnonzero((at // RUN == key[-1].as_py()) & np.isin(at - k, at) & np.isin(at + k, at))
        a, b = x[i] - x[np.searchsorted(at, at[i] - k)], x[np.searchsorted(at, at[i] + k)] - x[i]
        norm = np.maximum(np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)), EPS)
        angle = np.arccos(np.clip((a * b).sum(1) / norm, -1, 1))
        return pa.table({**{c: pa.array([v.as_py()], v.type) for c, v in zip(keys, key)}, "total": [float(angle.sum())], "n": [len(i)], "d": pa.array([x.shape[1]], pa.int32())})

    parts = sent.groupBy(*keys, "block").applyInArrow(run, f"{kinds}, total double, n long, d int")
    sums = parts.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("d").alias("d"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return sums.select(*keys, mean.alias("curvature"), (mean / F.ln(F.greatest("d", F.lit(2)))).alias("curvature_norm"))
