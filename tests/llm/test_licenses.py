import random

import pytest

from repselect.llm import licenses

TAG = "SPDX-License-Identifier: "


def found(text):
    return dict(zip(licenses.COLUMNS, licenses.scan(text, licenses._automaton())))


def test_every_tag_of_a_line():
    got = found(f"{TAG}MIT foo {TAG}GPL-3.0-only and {TAG}Apache-2.0 AND {TAG}(ISC")
    assert got["expressions"] == ["mit", "gpl-3.0-only", "apache-2.0"]
    assert got["labels"] == "apache-2.0,gpl-3.0-only,mit" and got["permitted"] is False
    assert found(f"{TAG}{TAG}MIT\n{TAG}\n{TAG}ISC.")["expressions"] == ["mit", "isc"]


@pytest.mark.parametrize("n", [150, 5000])
def test_long_expressions(n):
    got = found(TAG + " AND ".join(["MIT"] * n + ["GPL-3.0-only"]))
    assert got["labels"] == "gpl-3.0-only,mit" and got["permitted"] is False
    got = found(TAG + "(" * n + "MIT" + " OR ISC)" * n + " and so on")
    assert got["labels"] == "isc,mit" and got["permitted"] is True
    assert found(TAG + "(" * n + "MIT" + ")" * (n - 1))["expressions"] == []


def test_longest_prefix_against_trying_all():
    rng = random.Random(4)
    for _ in range(4000):
        parts = [rng.choice(["(", ")", "MIT", "isc.", "and", "OR", "with", "and.", "x", "Font-exception-2.0"]) for _ in range(rng.randrange(12))]
        tail = " ".join(parts)
        own = licenses.PART.findall(tail)
        fine = lambda ps: all(
            x.lower() in (*licenses.RANK, "(", ")") or (x.lower().rstrip(".") == "font-exception-2.0" if k and ps[k - 1].lower() == "with" else x.lower().rstrip(".") in ("mit", "isc")) for k, x in enumerate(ps))
        want = next((p for n in range(len(own), 0, -1) if fine(own[:n]) and (p := licenses.parse(" ".join(own[:n]).rstrip(".")))), None)
        assert licenses.expression_of(tail) == want, tail


@pytest.mark.parametrize("text, labels, score, permitted", [
    (TAG + "MIT and see the file COPYING", "mit", 1, True), (TAG + "banana", "", 0, None), (TAG + "see LICENSE", "", 0, None), (TAG + "LicenseRef-Ours", "licenseref-ours", 1, False),
    (TAG + "GPL-2.0-or-later WITH Bison-exception-2.2", "gpl-2.0-or-later", 1, True), (TAG + "CC-BY-NC-4.0", "cc-by,cc-by-nc,cc-by-nc-4.0", 1, False), (TAG + "CC-BY-4.0 OR mitre", "cc-by,cc-by-4.0", 1, True),
    ("the Apache License and the BSD License", "apache,bsd", 0.75, None), ("no licence at all", "", 0, None), (None, "", 0, None)])
def test_own_labels(text, labels, score, permitted):
    got = found(text)
    assert (got["labels"], got["score"], got["permitted"]) == (labels, score, permitted)


def test_labels_against_plain_search():
    """All phrases by splitting words, and tags by one regular expression, on random texts."""
    rng = random.Random(8)
    phrases = {**licenses.NOTICES, **licenses.BASE}
    ids = ["MIT", "Apache-2.0", "GPL-3.0-only", "banana"]
    for _ in range(300):
        parts = [rng.choice([*phrases, "filler words", "license", "public", "cc", "by"]) for _ in range(rng.randrange(12))]
        tags = [f"\n{TAG}{rng.choice(ids)}\n" for _ in range(rng.randrange(3))]
        text = " , ".join(parts) + "".join(tags)
        words = " ".join(licenses.re.findall("[a-z0-9]+", text.lower()))
        want = {label for phrase, label in phrases.items() if f" {phrase} " in f" {words} "} | {t.split()[-1].lower() for t in tags} - {"banana"}
        assert found(text)["labels"] == ",".join(sorted(want - {""})), text
