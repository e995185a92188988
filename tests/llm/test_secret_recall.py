import random

import pytest
from pyspark.sql import functions as F

from repselect.llm import secrets

UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {"upper hex": DIGITS + "ABCDEF", "base 32": UPPER + "234567", "upper": UPPER + DIGITS, "lower": UPPER.lower() + DIGITS, "mixed": UPPER + UPPER.lower() + DIGITS}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_recall_of_each_alphabet(spark, sf):
    model = secrets.train(secrets.samples(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")))
    rng = random.Random(6)
    rows = [(k, "".join(rng.choices(a, k=n))) for k, a in ALPHABETS.items() for n in (20, 32, 64) for _ in range(100)]
    rows += [("words", t) for t in ("international-conference-2", "release-candidate-of-march-7", "configuration_settings_v2", "understanding-documentation1")]
    df = spark.createDataFrame(rows, "kind string, token string")
    share = {r.kind: r.x for r in df.groupBy("kind").agg(F.avg((secrets.ratio(F.col("token"), model) >= secrets.MARGIN).cast("int")).alias("x")).collect()}
    assert share.pop("words") == 0
    assert min(share.values()) >= 0.98, share
