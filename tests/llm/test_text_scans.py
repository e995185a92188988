"""Quality rules, license scans, secret scans and language ID against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from repselect.llm import langid, licenses, quality, secrets
from repselect.llm.queries import OP3_SQL
from .conftest import odd_rows, sorted_rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


# quality


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


@pytest.mark.parametrize("kind", ["odd", "given"])
def test_quality_base(odd_docs, documents, kind):
    docs = odd_docs if kind == "odd" else documents
    want = sorted([(i, *brute_quality(t)) for i, t in texts_of(docs)], key=repr)
    got = quality.quality_report(docs)
    assert sorted_rows(got, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]) == want
    assert not got.where("kept and base_failed").count()


def test_quality_verdicts_match_sql(documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted_rows(quality.quality_report(documents)) == sorted(con.execute(OP3_SQL).fetchall(), key=repr)


def test_quality_keeps_rows_and_columns(odd_docs, no_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    want = Counter(r.doc_id for r in quality.quality_report(odd_docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want and want
    assert quality.keep_good(no_docs).count() == quality.quality_report(no_docs).count() == 0


def test_quality_leaves_good_documents(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    both = quality.quality_report(documents).join(labels, "doc_id").where("not base_failed")
    share = {r.quality: r.k / r.n for r in both.groupBy("quality").agg({"kept": "count"}).join(both.where("kept").groupBy("quality").count(), "quality").selectExpr("quality", "`count(kept)` n", "count k").collect()}
    assert share[1] > 0.98 and share.get(0, 0) < 0.5


def test_quality_fences_follow_their_group(spark):
    """Two sources of unlike spread get unlike fences; a text is judged by its own source's."""
    rows = []
    for k in range(600):
        for source, wide in (("even", 0), ("mixed", 4)):
            words = ["x" * (4 + (k * 7 + j) % (1 + wide) + (k % 5) * wide // 4) for j in range(60)]
            rows.append((len(rows), " ".join(f"{w}{j}" for j, w in enumerate(words)), "en", source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fence = {r["_fs"]: r.fence_word_length for r in quality.thresholds(quality.base_measures(docs, ["lang", "source"])).collect()}
    assert fence["mixed"] > 1.5 * fence["even"]
    long = " ".join("y" * int((fence["mixed"] + fence["even"]) / 2 - 2) + str(j) for j in range(10, 70))
    docs = docs.unionByName(spark.createDataFrame([(-1, long, "en", "even"), (-2, long, "en", "mixed")], docs.schema))
    kept = {r.doc_id: r.kept for r in quality.quality_report(docs).collect()}
    assert not kept[-1] and kept[-2] and sum(kept.values()) >= 1200


# licenses


def brute_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


@pytest.mark.parametrize("kind", ["odd", "given"])
def test_license_base(odd_docs, documents, kind):
    docs = odd_docs if kind == "odd" else documents
    got = licenses.scan_licenses(docs)
    assert sorted_rows(got, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]) == sorted([(i, *brute_base(t)) for i, t in texts_of(docs)], key=repr)
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_expressions(odd_docs, no_docs):
    found = {r.doc_id: r for r in licenses.scan_licenses(odd_docs).where("doc_id in (14, 15)").collect()}
    assert found[14].labels == "apache-2.0,gpl-2.0-only,mit" and found[14].permitted is True and found[14].score == 1
    assert found[15].permitted is None and not found[15].expressions
    assert licenses.scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize("text, polish, free", [
    ("MIT", ["mit"], True), ("GPL-3.0-only OR MIT AND Apache-2.0", ["gpl-3.0-only", "mit", "apache-2.0", "and", "or"], True),
    ("(GPL-3.0-only OR MIT) AND LGPL-2.1", ["gpl-3.0-only", "mit", "or", "lgpl-2.1", "and"], False),
    ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0", "classpath-exception-2.0", "with"], True), ("MIT OR", None, None), ("(MIT", None, None), ("MIT)", None, None),
    ("MIT MIT", None, None), ("", None, None)])
def test_parser(text, polish, free):
    assert licenses.parse(text) == polish
    if polish:
        assert licenses.evaluate(polish)[0] is free


# secrets


def brute_spans(text):
    text, out = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.mark.parametrize("kind", ["odd", "given"])
def test_secret_base(odd_docs, documents, kind):
    docs = odd_docs if kind == "odd" else documents
    want = []
    for i, t in texts_of(docs):
        spans = brute_spans(t)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        n = Counter(s[3] for s in spans)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(line.encode()).hexdigest()))
    got = secrets.scan_secrets(docs)
    assert sorted_rows(got, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]) == sorted(want, key=repr)


def test_markov_models(spark, documents):
    model = secrets.train(secrets.samples(documents))
    tokens = spark.createDataFrame([(hashlib.sha256(bytes([k])).hexdigest()[:32], 1) for k in range(50)] + [
        (w, 0) for r in documents.limit(60).collect() for w in re.findall("[A-Za-z]{8,}", r.text)[:20]], "token string, y int")
    rows = tokens.select("y", secrets.ratio(tokens.token, model).alias("x")).collect()
    assert all(r.x > secrets.MARGIN for r in rows if r.y) and sum(r.x > 0 for r in rows if not r.y) < 0.02 * len(rows)


def test_markov_adds_and_redacts(spark, documents, odd_docs, no_docs):
    key = "Zk3v9QxT7LmP2wRb8NcY5HdJ1sGfA4uE"
    docs = documents.unionByName(odd_docs.select(documents.columns).where("doc_id = 19").selectExpr("doc_id - 1000 doc_id", "text", "lang", "source", "n_chars"))
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    assert spans[-981] == "markov:4:36"
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[-981].text == "key <secret> end" and clean[-981].n_chars == 16
    before = dict(texts_of(docs))
    for i, r in clean.items():
        assert (r.text == before[i]) == (not spans[i])
        assert key not in r.text and not re.search("[0-9a-f]{24}", r.text)
    odd = secrets.redact(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count()
    assert secrets.redact(no_docs).count() == secrets.scan_secrets(no_docs).count() == 0


def test_markov_spans_against_plain_scoring(spark, documents, odd_docs):
    """All added spans, by the same ratios worked out character by character."""
    docs = documents.limit(60).select("doc_id", "text").unionByName(odd_docs.where("doc_id = 19").selectExpr("-doc_id doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(-5, "k: zq8Xv2Lm9TrB4wNc7YkH1d, word international-conference-2 and 0123456789abcdef0123456789ABCDEF x")], "doc_id long, text string"))
    model = secrets.train(secrets.samples(docs))
    place = {c: k + 1 for k, c in enumerate(secrets.ALPHABET)}

    def score(token):
        s = [0, *[place.get(c, 0) for c in token]]
        return sum(model[a * secrets.STATES + b] for a, b in zip(s, s[1:])) / len(token)

    for r in secrets.scan_secrets(docs).join(docs, "doc_id").collect():
        base = brute_spans(r.text)
        more = [(m.start(), 3, m.end(), "markov") for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", r.text)
                if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and score(m[0]) >= secrets.MARGIN and not any(a < m.end() and b > m.start() for a, _, b, _ in base)]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + more))


# language ID


def test_languages_against_exact_sets(spark, documents):
    """Bloom filters against the exact n-gram sets of the same training texts; 130 languages take three words."""
    train = documents.where(~langid.held_out())
    model = langid.train(train)
    sets = {}
    for lang in model.langs:
        n = Counter()
        for r in train.where(F.col("lang") == lang).select("text").distinct().collect():
            n.update(langid.grams(r.text).tolist())
        sets[lang] = {g for g, c in n.items() if c >= 2}
    same, rows = 0, documents.select("text").collect()
    for r in rows:
        found = langid.grams(r.text).tolist()
        share = {lang: sum(g in own for g in found) / max(len(found), 1) for lang, own in sets.items()}
        lang, score = model.predict(r.text)
        best = max(share.values(), default=0)
        same += share.get(lang) == best
        assert not found or abs(score - best) < 0.02
    assert same >= 0.99 * len(rows)
    many = spark.createDataFrame([(k, f"abcd{chr(0x3400 + k)}wxyz " * 3, f"l{k:03}") for k in range(130)], "doc_id long, text string, lang string")
    own = langid.train(many)
    assert own.masks.shape[0] == 3 and [r.lang_pred for r in langid.identify(many, own).orderBy("doc_id").collect()] == own.langs


def test_languages(documents, odd_docs, no_docs):
    model = langid.train(documents.where(~langid.held_out()))
    got = langid.identify(documents.withColumn("score", documents.doc_id), model).withColumn("held_out", langid.held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and any(c.isalpha() for c in r.text)]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[17].lang_pred == "und" and odd[17].score == 0
    assert odd[16].lang_pred in model.langs
    assert langid.identify(no_docs, model).count() == 0
    empty = langid.train(no_docs)
    assert {r.lang_pred for r in langid.identify(odd_docs, empty).collect()} == {"und"}


def test_text_with_very_many_secrets(spark):
    """Spans by log passes: thousands of matches of several kinds that touch and overlap, in one text."""
    import random
    import re

    from repselect.llm import secrets

    rng = random.Random(3)
    parts = []
    for k in range(3000):
        parts.append(rng.choice(["%024x" % rng.getrandbits(96), "token=" + "%x" % rng.getrandbits(40), "secret: %026x" % rng.getrandbits(104), "é", "AKIA" + "Q" * 17]))
    text = " ".join(parts)
    want = []
    for order, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        pattern = pattern.replace("(?i:password|passwd|secret|token|api_?key)", "(?:token|secret)")
        want += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secrets.with_spans(df, ["doc_id"], [0.0] * secrets.STATES ** 2).first()
    assert [tuple(s)[:4] for s in got.base_spans] == sorted(want) and got.spans == got.base_spans
    out, at = [], 0
    for start, _, stop, _ in sorted(want):
        if start >= at:
            out.append(text[at:start] + "<secret>")
            at = stop
        at = max(at, stop)
    assert secrets.redact(df).first().text == "".join(out) + text[at:]
