"""Entropies from sums and sign flips by halves, against whole matrices and all sign vectors."""

import itertools

import numpy as np
import pytest

from repselect.operators import statistics, vectors


@pytest.fixture(scope="module")
def views(spark):
    rng = np.random.default_rng(3)
    found = {"many": rng.normal(size=(90, 2, 6)) + rng.normal(size=(90, 1, 6)), "few": rng.normal(size=(5, 2, 9)), "same": np.ones((40, 2, 3)), "one": rng.normal(size=(1, 2, 2))}
    rows = [(m, "t", 1, k, v, x[k, v].tolist()) for m, x in found.items() for k in range(len(x)) for v in range(2)]
    return found, spark.createDataFrame(rows, "model_alias string, task string, layer int, item_id long, view_id int, vec array<double>").repartition(5)


def told(df):
    return {(r.model_alias, r.field): r.value for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), equal_nan=True, rtol=1e-9, atol=1e-9)


def test_entropies_from_gram_sums(views):
    found, df = views
    same(told(vectors.entropy_metrics(df.where("view_id = 0"))), {(m, f): v for m, x in found.items() for f, v in vectors.matrix_entropy(x[:, 0]).items()})
    same(told(vectors.dime_metrics(df)), {(m, f): v for m, x in found.items() for f, v in vectors.dime(x[:, 0], x[:, 1]).items()})
    same(told(vectors.lidar_metrics(df)), {(m, f): v for m, x in found.items() for f, v in vectors.lidar(x).items()})


def plain_count(d, tol=1e-12):
    far = abs(sum(d) / len(d)) - tol
    return sum(abs(sum(s * x for s, x in zip(signs, d)) / len(d)) >= far for signs in itertools.product((1, -1), repeat=len(d)))


def test_sign_flips_by_halves():
    rng = np.random.default_rng(5)
    for d in (rng.normal(0.3, 1, 16), rng.integers(-2, 4, 16) / 4, rng.normal(size=1), np.zeros(5), np.full(13, 0.1), rng.normal(size=7)):
        assert statistics.sign_flip_count(d) == plain_count(d)


def test_sign_flip_of_forty_values(spark):
    rng = np.random.default_rng(6)
    d = rng.integers(-3, 6, 40).astype(float)  # counts by dynamic programming over sums
    sums = {0: 1}
    for x in d.astype(int):
        after = {}
        for s, n in sums.items():
            for y in (s + x, s - x):
                after[y] = after.get(y, 0) + n
        sums = after
    want = sum(n for s, n in sums.items() if abs(s) >= abs(d.sum())) / 2 ** 40
    rows = [("a", float(x)) for x in d] + [("b", 1.0), ("b", 2.0)]
    got = {r.k: r.p for r in statistics.sign_flip(spark.createDataFrame(rows, "k string, d double"), ["k"], "d", draws=None).collect()}
    assert np.isclose(got["a"], want, rtol=1e-12) and got["b"] == 0.5
    with pytest.raises(Exception, match="too many values"):
        statistics.sign_flip(spark.createDataFrame([("a", float(x)) for x in range(50)], "k string, d double"), ["k"], "d", draws=None).collect()
