"""Sums over pairs by sorting against all pairs laid out."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from repselect.operators import order, pairs, ranking, statistics

EPS = 1e-12


def plain_correlations(rows):
    x, y = (np.array(v, float) for v in zip(*rows))
    n = len(x)
    dx, dy = x[:, None] - x, y[:, None] - y
    rank = lambda v: (v[:, None] > v).sum(1) + ((v[:, None] == v).sum(1) + 1) / 2
    varied = n >= 3 and x.std() > EPS and y.std() > EPS
    centred = lambda d: (a := np.abs(d)) - a.mean(0) - a.mean(1)[:, None] + a.mean()
    a, b = centred(dx), centred(dy)
    told = n >= 3 and (a * a).mean() > EPS and (b * b).mean() > EPS
    sign = np.sign(dx) * np.sign(dy)
    return (
        np.corrcoef(x, y)[0, 1] if varied else None, np.corrcoef(rank(x), rank(y))[0, 1] if varied else None,
        sign.sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum()) if varied else None,
        math.sqrt(max((a * b).mean(), 0)) / math.sqrt(math.sqrt((a * a).mean() * (b * b).mean())) if told else None, n)


def close(got, want, tol=1e-9):
    return all((a is None) == (b is None) and (a is None or abs(a - b) < tol) for a, b in zip(got, want))


@pytest.fixture(params=["a task a group", "ranges"])
def way(request, monkeypatch):
    if request.param == "ranges":
        monkeypatch.setattr(pairs, "SMALL", 2)
        monkeypatch.setattr(pairs, "RANGE", 60)
    return request.param


def groups():
    rng = random.Random(1)
    out = {"a": [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(150)], "b": [(rng.randrange(6), rng.randrange(4)) for _ in range(200)]}
    out["c"] = [(x, 1e6 + x * 3 + rng.random()) for x in range(90)]
    out |= {"flat": [(1.0, k) for k in range(9)], "two": [(1, 2), (3, 4)], "same": [(2.0, 2.0)] * 40, "three": [(0, 1), (1, 1), (2, 0)]}
    return out


def test_correlations(spark, way):
    rows = [(k, float(x), float(y)) for k, v in groups().items() for x, y in v] + [("a", None, 1.0), ("a", math.nan, 1.0), ("a", 1.0, math.inf), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").withColumn("w", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = {r.k: r for r in statistics.correlations(df, ["k"], "x", "y").collect()}
    assert got.keys() == groups().keys()
    for k, v in groups().items():
        r = got[k]
        assert close((r.pearson, r.spearman, r.kendall, r.distance, r.n_layers), plain_correlations(v)), (k, r, plain_correlations(v))
    assert statistics.correlations(df.where("k = 'none'"), ["k"], "x", "y").count() == 0


def test_preferences(spark, way):
    rng = random.Random(2)
    rows = [(k, float(x), float(y), rng.choice(["p", "q", None])) for k, v in groups().items() for x, y in v] + [("a", None, 1.0, "p"), ("d", 1.0, 1.0, "p"), ("d", 1.0 + 1e-13, 3.0, "q"), ("d", 2.0, 2.0, "q")]
    df = spark.createDataFrame(rows, "k string, x double, y double, m string").withColumn("u", F.lit("clash"))
    got = {r.k: r for r in ranking.preference_accuracy(df, ["k"], "x", "y", "m").collect()}
    for k in got:
        told = [(a[1] - b[1], a[2] - b[2], a[3] == b[3]) for a, b in itertools.combinations([r for r in rows if r[0] == k and r[1] is not None], 2)]
        both = [(s > 0) == (u > 0) for s, u, _ in told if abs(s) > EPS and abs(u) > EPS]
        mine = [(s > 0) == (u > 0) for s, u, m in told if m and abs(s) > EPS and abs(u) > EPS]
        half = [0.5 if abs(s) <= EPS else float((s > 0) == (u > 0)) for s, u, _ in told if abs(u) > EPS]
        mean = lambda v: sum(v) / len(v) if v else None
        cross = (sum(both) - sum(mine)) / (len(both) - len(mine)) if len(both) > len(mine) else None
        r = got[k]
        assert close((r.accuracy_all, r.accuracy_within, r.accuracy_cross, r.n_pairs, r.half_accuracy), (mean(both), mean(mine), cross, len(both), mean(half))), (k, r)


def test_large_group_ends(spark):
    n = 50_000
    df = spark.range(n).selectExpr("1 AS k", "'m' AS m", "cast(hash(id) % 40000 AS double) AS x", "cast(hash(id, 7) % 1000 + hash(id) % 40000 AS double) AS y")
    began = time.time()
    r = statistics.correlations(df, ["k"], "x", "y").first()
    p = ranking.preference_accuracy(df, ["k"], "x", "y", "m").first()
    assert time.time() - began < 120
    x, y = (np.array(v) for v in zip(*[(r.x, r.y) for r in df.select("x", "y").collect()]))
    each, w = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    whole = pairs.correlate(*each, w.astype(float))  # the kernel of one task
    assert r.n_layers == n and close((r.pearson, r.spearman, r.kendall), whole[3:6]) and abs(r.distance - math.sqrt(whole[8]) / math.sqrt(math.sqrt(whole[6] * whole[7]))) < 1e-9
    up, told = p.accuracy_all * p.n_pairs, p.n_pairs
    sample = slice(0, 3000)
    s = np.sign(x[sample, None] - x) * np.sign(y[sample, None] - y)
    assert abs((2 * up - told) / told - s.sum() / (s != 0).sum()) < 0.02


def test_running_sums_go_on_behind_a_border(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaab"), rng.randrange(500)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int")
    for r in order.value_counts(df, ["k"], "v").collect():
        own = [v for k, v in rows if k == r.k]
        assert (r.n, r.ahead_n, r.ahead_s) == (own.count(r.v), sum(v < r.v for v in own), sum(v for v in own if v < r.v))
