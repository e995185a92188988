"""Contraction span and calibrated alignment on small data."""

import math

import numpy as np

from repselect.operators import alignment, ranking


def test_joint_span(spark):
    centres = [(k + 0.5) / 11 for k in range(11)]
    falls = {"long": [1, 1, -1, -1, -1, -1, -1, 1, -1, 1, 1], "short": [1, -1, 1, 1, -1, -1, 1, 1, 1, 1, 1], "none": [1] * 11, "last": [1] * 10 + [-1]}
    rows = [(m, t, c, float(v) * (2 if t == "b" else 1) if t != "odd" else 5.0) for m, f in falls.items() for t in ("a", "b", "odd") for c, v in zip(centres, f)]
    means = spark.createDataFrame(rows, "m string, task string, c double, v double")
    spreads = spark.createDataFrame([(m, t, c, -1.0) for m, t, c, _ in rows], means.schema)
    got = {r.m: (r.left, r.right) for r in ranking.joint_span(means, spreads, ["m"], "c", "v").collect()}
    half = 0.5 / 11
    want = {"long": (centres[3] - half, centres[5] + half), "short": (centres[4] - half, centres[5] + half), "last": (centres[10] - half, 1.0)}
    assert got.keys() == want.keys() and all(np.allclose(got[m], want[m]) for m in want)
    assert ranking.joint_span(means, spreads.where("c < 0"), ["m"], "c", "v").count() == 0


def test_calibration_shifts_what_is_not_positive(spark):
    rows = [("t", "a", k, v) for k, v in enumerate([1.0, 2.0, 4.0])] + [("t", "b", k, v) for k, v in enumerate([-3.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "task string, model string, layer int, x double")
    got = {(r.model, r.layer, r.calibration): r.score for r in alignment.calibrated(df, ["task"], "model", "x").collect()}
    assert [got["a", k, "raw"] for k in range(3)] == [1, 2, 4] and np.allclose([got["a", k, "model_logratio"] for k in range(3)], np.log([0.5, 1, 2]))
    eps = 8e-12
    assert np.allclose([got["b", k, "model_logratio"] for k in range(3)], [math.log(eps / (3 + eps)), 0, math.log((8 + eps) / (3 + eps))], atol=1e-3)
