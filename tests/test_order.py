"""Places, ranks and neighbours without a window over one key."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from repselect.operators import evaluators, order, sampling, vectors


def test_places_follow_the_hash(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.random()) for k in range(900)] + [("c", 5000, 0.5), ("c", 5001, 0.5)]
    df = spark.createDataFrame(rows, "g string, item_id long, h double")
    for buckets in (1, 7, 1 << 16):
        monkeypatch.setattr(sampling, "BUCKETS", buckets)
        got = {r.item_id: (r["_p"], r["_n"]) for r in sampling.placed(df, ["g"], F.col("h"), "item_id").collect()}
        for g in ("a", "b", "c", None):
            own = sorted((h, k) for x, k, h in rows if x == g)
            assert [got[k] for _, k in own] == [(n + 1, len(own)) for n in range(len(own))]


def test_running_sums_take_null_keys_for_one(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (2, 5), (2, 4), (None, 2)], "k int, v int")
    got = {(r.k, r.v): r.ahead_v for r in order.running(order.sorted_parts(df, ["k"], ["v"], 3), ["k"], ["v"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, (None, 3): 3, (2, 4): 0, (2, 5): 4}


def test_pair_measures(spark):
    rng = random.Random(2)
    rows = [("a", rng.randrange(4), round(rng.gauss(0, 1), 1), rng.random() < 0.3) for _ in range(500)] + [("flat", 1, 0.5, False), ("flat", 1, 0.7, False), ("a", None, 1.0, True), ("a", 1, math.nan, True)]
    df = spark.createDataFrame(rows, "g string, gold int, score double, hit boolean").repartition(6)
    told = [r for r in rows if r[0] == "a" and r[1] is not None and r[2] == r[2]]
    rank = lambda v: np.array([sum(x < y for x in v) + (v.count(y) + 1) / 2 for y in v])
    got = {r.g: r for r in evaluators.spearman_similarity(df, ["g"], "gold", "score").collect()}
    assert got["flat"].spearman is None and got["a"].n == 500
    assert np.isclose(got["a"].spearman, np.corrcoef(rank([r[1] for r in told]), rank([r[2] for r in told]))[0, 1])
    clean = df.where("gold is not null and not isnan(score)")
    ap = {r.g: r.average_precision for r in evaluators.average_precision(clean, ["g"], "score", "hit").collect()}
    hits, seen, total = 0, 0, 0.0
    for s in sorted({r[2] for r in told}, reverse=True):
        tie = [r[3] for r in told if r[2] == s]
        hits, seen = hits + sum(tie), seen + len(tie)
        total += sum(tie) * hits / seen
    assert ap["flat"] is None and np.isclose(ap["a"], total / hits)


def test_curvature_across_runs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    found = {"a": rng.normal(size=(50, 4)), "b": np.arange(12.0).reshape(6, 2), "two": rng.normal(size=(2, 3))}
    rows = [(m, "t", 1, 5 * k, v.tolist()) for m, x in found.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "model_alias string, task string, layer int, item_id long, vec array<double>").repartition(4)
    for run, k in ((4096, 1), (7, 1), (7, 3)):
        monkeypatch.setattr(vectors, "RUN", run)
        got = {r.model_alias: r.curvature for r in vectors.curvature(df, k).collect()}
        for m, x in found.items():
            a, b = x[k:-k] - x[:-2 * k], x[2 * k:] - x[k:-k]
            if len(x) > 2 * k:
                cos = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                assert np.isclose(got[m], np.arccos(np.clip(cos, -1, 1)).mean(), atol=1e-7)
            else:
                assert got[m] is None
