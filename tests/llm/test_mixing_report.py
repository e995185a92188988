import logging

from repselect.llm import mixing


def test_scarce_domain_scales_the_whole_down(spark, caplog):
    """Domain b has 100 tokens: 200 are wanted and reached; of weights that want 10000, all are scaled down."""
    members = spark.createDataFrame([(100, [1.0, 0.0])] * 10 + [(10, [0.0, 1.0])] * 10, "tokens long, p array<double>")
    with caplog.at_level(logging.INFO, logger=mixing.LOG.name):
        _, targets, totals = mixing.fit_rates(members, ["a", "b"], {"a": 5.0, "b": 1.0}, "a")
        assert [round(x) for x in targets] == [round(x) for x in totals] == [1000, 200]
        assert "domain b: 100 tokens there, 200 wanted, 200 reached" in caplog.text
        assert not [r for r in caplog.records if r.levelno >= logging.WARNING]
        caplog.clear()
        _, targets, totals = mixing.fit_rates(members, ["a", "b"], {"a": 1.0, "b": 10.0}, "a")
        assert [round(x) for x in targets] == [round(x) for x in totals] == [40, 400]
        assert "scaled down to 0.04" in [r.getMessage() for r in caplog.records if r.levelno >= logging.WARNING][0]
        caplog.clear()
        mixing.fit_rates(members, ["a", "b"], {"a": 5.0, "b": 1.0, "c": 1.0}, "a", steps=0)
        assert "after 0 steps" in caplog.text and "no tokens of the weighted domains c" in caplog.text
