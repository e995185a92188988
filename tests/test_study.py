"""Study operators on small inputs: errors, missing rows, empty tables."""

import pytest
from pyspark.sql import functions as F

from repselect.operators import study as K

TARGET = "k long, target_source string, target_name string, gap_regime string, target_value double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_unique_targets(spark):
    data = [(1, "s", "n", "all", 2.0), (1, "s", "n", "near", 5.0), (1, "s", "n", "all", 2.0), (2, "s", "n", None, 1.0), (3, "s", "other", "all", 9.0)]
    df = spark.createDataFrame(data, TARGET)
    assert rows(K.unique_targets(df, ["k"], "s", "n")) == [(1, 2.0)]
    assert rows(K.unique_targets(df.where("gap_regime is null"), ["k"], "s", "n")) == [(2, 1.0)]
    assert K.unique_targets(df.where("false"), ["k"], "s", "n").count() == 0
    with pytest.raises(Exception, match="targets of one key differ"):
        K.unique_targets(df.withColumn("gap_regime", F.lit("x")), ["k"], "s", "n").collect()


def test_collapse_and_joins(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (1, 4.0, 1), (None, 1.0, 0)], "k long, energy double, chosen long")
    assert rows(K.collapse(df, ["k"], ["energy"], ["chosen"], "energy")) == [(1, 3.0, 3), (None, 1.0, 0)]
    with pytest.raises(Exception, match="negative energy"):
        K.collapse(df.withColumn("energy", -F.col("energy")), ["k"], ["energy"], energy="energy").collect()
    left = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, None, 12)], "k long, sample_hash string, x long")
    right = spark.createDataFrame([(1, "a", 5), (1, "b", 6)], "k long, sample_hash string, y long")
    assert rows(K.matched_join(left, right, ["k"]).select("x", "y")) == [(10, 5), (11, 6)]
    with pytest.raises(ValueError):
        K.matched_join(left.drop("sample_hash"), right, ["k"])
    assert rows(K.share_of_total(left, ["k"], "x").select("x", F.round("share", 3))) == [(10, 0.476), (11, 0.524), (12, 1.0)]


def test_task_cache(spark):
    data = [("t", f"text{i}", i % 2) for i in range(12)] + [("u", None, 1), ("u", "x", None), ("v", "x", 1)]
    df = spark.createDataFrame(data, "task string, text string, label int")
    assert rows(K.task_cache(df, ["task"], "text", "label")) == [("t", 12, 2, "ok"), ("u", 0, 0, "warning"), ("v", 1, 1, "warning")]
    assert rows(K.task_cache(df, ["task"], "text", None).select("task", "status")) == [("t", "ok"), ("u", "warning"), ("v", "warning")]


def test_leave_one_task_out(spark):
    data = [("a", 0.0, 1.0), ("a", 1.0, 0.0), ("b", 0.0, 0.2), ("b", 1.0, 0.8), ("c", 0.0, 0.5), ("c", 1.0, 0.5)]
    df = spark.createDataFrame(data, "task string, alpha double, selection_objective double")
    got = {r.task: (r.selected_alpha, round(r.training_objective, 9), r.n_training_tasks) for r in K.leave_one_task_out(df).collect()}
    assert got == {"a": (1.0, 0.65, 2), "b": (0.0, 0.75, 2), "c": (0.0, 0.6, 2)}
    assert K.leave_one_task_out(df.where("task = 'a'")).count() == 0


def test_verdict(spark):
    tests = [(f, o, b, 0.1, 0.05, 0.01) for f in (0.25, 0.5, 1.0) for o in ("utility_spearman", "ndcg_at_k") for b in ("fixed_precision", "shuffled_precision", "no_precision")]
    schema = "fraction double, outcome string, baseline string, mean_advantage double, ci_low double, p_holm double"
    valid = spark.createDataFrame([(0.25, 0.3, 0.1), (0.5, 0.4, 0.1)], "fraction double, mean_correlation double, ci_low double")
    control = spark.createDataFrame([("x", True)], "outcome string, passed boolean")
    judge = lambda t, v=valid, c=control: K.verdict(spark.createDataFrame(t, schema), v, c).first()
    assert all(judge(tests))
    lacking = judge([t for t in tests if t[:3] != (0.25, "utility_spearman", "fixed_precision")])
    assert not lacking.low_sample_utility and not lacking.supported and lacking.ndcg_gain
    worse = judge([(*t[:3], -0.1, -0.5, 0.9) if t[:2] == (0.5, "ndcg_at_k") else t for t in tests])
    assert worse.ndcg_gain and not worse.not_inferior
    assert not judge(tests, valid.where("fraction > 0.3")).uncertainty_validated
    assert not any(judge([], valid, control.where("false")))


def test_controls_and_checks(spark):
    trials = spark.createDataFrame([("a", "t", "m", 1.0), ("a", "t", "m", 3.0), ("a", "u", "m", 4.0), ("b", "t", "m", 3.0), ("b", "u", "m", None)], "method string, task string, model_alias string, gain double")
    macro = K.macro_summary(trials, "method", ["gain"])
    assert rows(macro.select("method", "n_tasks", "mean_gain", "median_gain")) == [("a", 2, 3.0, 3.0), ("b", 2, 3.0, 3.0)]
    assert rows(K.negative_control(macro, "method", "a", "b", ["gain"])) == [("gain", 3.0, 3.0, 0.0, True)]
    assert K.negative_control(macro, "method", "a", "missing", ["gain"]).count() == 0
    scores = spark.createDataFrame(
        [("m", "t", "Classification", 1, "h", True), ("n", "t", "Classification", 1, "x", None), ("m", "s", "STS", 1, None, False)],
        "model_alias string, task string, task_type string, seed int, split_hash string, seed_affects boolean")
    manifest = spark.createDataFrame([("t", 1, "h")], "task string, seed int, expected_hash string")
    assert rows(K.split_alignment(scores, manifest).select("model_alias", "task", "ok")) == [("m", "s", True), ("m", "t", True), ("n", "t", False)]
    assert rows(K.split_identity(scores)) == [("t", 1, False)]
    assert rows(K.seed_effect(scores)) == [("m", "s", True), ("m", "t", True), ("n", "t", False)]
    errors = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert rows(K.reconstruction(errors, [], "a", "b")) == [(2, 1.0, 0.5, 0.5)]
