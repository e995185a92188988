import random

import pytest

ODD_TEXTS = [
    None, "", " \t\n", "one", "two words", "a b c", "A B C", "password = hunter2abc and AKIA" + "Q" * 16, "token: ab token=" + "f" * 30,
    "secret: token : abcdefgh", "x" * 200 + " \x1c\x85\xa0 　 don't we'll <|endoftext|> 12345 éè\U0001f600", "line\nline\n\nline\n \nother line",
    "the cat sat the cat sat the cat sat", "All rights reserved. CC BY 4.0, CC-BY-NC; GNU General Public License cc by cc by",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nend", "SPDX-License-Identifier: AND MIT",
    "中文 абв", "1234 !!", "a" * 5000 + " " + "ab " * 4000, "key Zk3v9QxT7LmP2wRb8NcY5HdJ1sGfA4uE end",
]


def odd_rows():
    """Nulls in every column, ties and repeated rows, very long texts, near copies."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "der", "les", "les", "of", "in", "Es"]
    rows = [(k, t, ["en", None, "fr"][k % 3], ["s", None][k % 2], 1) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "a b c", None, None, None), (None, None, None, None, None)]
    base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(300)]
    for k in range(60):
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(300)] = "changed" + str(rng.randrange(9))
        rows.append((100 + k, " ".join(own), "en", "s", 0))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd rows with extra columns that bear names the operators use."""
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *[F.lit("x").alias(c) for c in ("fp", "spans", "kept", "rank", "shard", "_t", "ids", "score", "lang_pred", "node", "tokens", "key", "p")])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0).where("doc_id < 0")


def sorted_rows(df, cols=None):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)
