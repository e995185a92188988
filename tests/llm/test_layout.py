"""Embedding near-dedup, sharding, mixing, WARC audit and the pipeline against plain versions."""

import gzip
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repselect.llm import embedding_dedup, langid, mixing, quality, queries, secrets, sharding, similar, simhash, warc
from .conftest import odd_rows, sorted_rows

DATA = "/root/testdata/sf0.001"


def brute_links(rows, threshold=0.9):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, n[k], least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "NUMBERS", 96)
    monkeypatch.setattr(embedding_dedup, "INNER", 8)
    rng = random.Random(1)
    rows = []
    for k in range(120):
        v = [round(rng.gauss(0, 1), 3) for _ in range(6)] if k % 3 else [round(x + rng.gauss(0, 0.2), 3) for x in (1, 2, 3, 1, 0, 1)]
        rows.append((k + 3, [float(np.float32(x)) for x in v]))
    rows += [(0, None), (1, [0.0] * 6), (2, [math.nan] + [1.0] * 5), (500, [None] + [1.0] * 5), (501, [math.inf] * 6), (502, []), (503, [1.0, 2.0]), (504, [1.0, 2.1]), rows[0], (None, rows[1][1])]
    rows += [(600 + k, rows[0][1]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("node", F.lit("x"))
    got = embedding_dedup.near_duplicates(df)
    want = [(i, n, c, i is None or c is None or i == c) for i, n, c in brute_links(rows)]
    assert sorted_rows(got) == sorted(want, key=repr)
    assert embedding_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_embeddings_of_the_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = [(i, n, c, i == c) for i, n, c in brute_links([(r.vec_id, r.embedding) for r in df.collect()])]
    assert sorted_rows(embedding_dedup.near_duplicates(df)) == sorted(want, key=repr)


def test_shards(spark, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet"), odd_docs):
        rows = {}
        for r in sharding.assign_shards(docs).collect():
            rows.setdefault(r.shard, []).append(r)
        sizes = [(len((t or "").encode()) + 1) for _, t in docs.select("doc_id", "text").collect()]
        assert sorted(s.size for v in rows.values() for s in v) == sorted(sizes)
        total, at = sum(sizes), 0
        for shard in sorted(rows):
            own = sorted(rows[shard], key=lambda r: r.slot)
            assert [r.slot for r in own] == list(range(len(own))) and 0 <= shard < 16
            for r in own:  # the middle byte lies in the shard's part
                assert (2 * at + r.size) * 16 // (2 * total) == shard
                at += r.size
        ids = [r.doc_id for s in sorted(rows) for r in sorted(rows[s], key=lambda r: r.slot)]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        crc = {r.doc_id: r.text_crc32 for v in rows.values() for r in v if r.doc_id is not None}
        for i, t in docs.select("doc_id", "text").collect():
            if i is not None and i != 5:
                assert crc[i] == (None if t is None else zlib.crc32(t.encode()))
    assert sharding.assign_shards(no_docs).count() == 0


def plain_posteriors(docs, labels):
    """Gaussian naive Bayes over the features, on one machine."""
    told = mixing.learn(docs, labels)
    x = {r.doc_id: [r[f] for f in mixing.FEATURES] for r in mixing.features(docs, ["doc_id"], told).collect()}
    by = {}
    for r in labels.collect():
        if r.doc_id in x:
            by.setdefault(f"{r.quality},{r.toxic}", []).append(x[r.doc_id])
    names, n = sorted(by), sum(map(len, by.values()))
    score = {}
    for i, v in x.items():
        s = []
        for name in names:
            own = np.array(by[name])
            var = np.maximum(own.var(axis=0), mixing.SMALLEST_VARIANCE)
            s.append(math.log(len(own) / n) - 0.5 * (np.log(var) + (np.array(v) - own.mean(axis=0)) ** 2 / var).sum())
        raised = np.exp(np.array(s) - max(s))
        score[i] = raised / raised.sum()
    return names, score


def test_mixing_meets_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = mixing.mixing_rates(docs, labels).collect()
    assert len(rows) == docs.count()
    names, score = plain_posteriors(docs, labels)
    p, n, r = np.array([x.p for x in rows]), np.array([x.tokens for x in rows]), np.array([x.rate for x in rows])
    assert np.allclose(p, [score[x.doc_id] for x in rows], atol=1e-9)
    mass = n @ p
    weight = np.array([mixing.WEIGHTS[d] for d in names])
    scale = min(mass[names.index(mixing.ANCHOR)] / mixing.WEIGHTS[mixing.ANCHOR], (mixing.REPEATS * mass / weight).min())
    plain = np.ones(len(rows))  # the same descent on one machine
    for _ in range(mixing.STEPS):
        off = ((plain * n) @ p - weight * scale) / mass
        if abs(off).max() <= 1e-6:
            break
        plain = np.maximum(0, plain - p @ off)
    assert np.allclose(plain, r, atol=1e-9) and (r >= 0).all()
    reached = (r * n) @ p
    assert np.allclose(reached / reached.sum(), weight / weight.sum(), atol=1e-4)
    assert all(abs(x.reached - x.wanted) <= 1e-3 * x.wanted for x in rows)


def test_telling_words_and_held_out_labels(spark):
    """The classifier learns from three quarters of the labels and tells the toxic ones of the rest."""
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    told = mixing.learn(docs, labels.where(~held))
    assert len({"idiot", "moron", "stupid", "trash", "scum", "worthless", "clown"} & set(told["toxic"])) >= 2 and len(told["toxic"]) <= mixing.WORDS
    own = mixing.features(docs, ["doc_id"], told)
    model = mixing.fit_classifier(own.join(labels.where(~held), "doc_id"))
    toxic = [k for k, d in enumerate(model) if d["domain"].endswith("1")]
    rows = own.join(labels.where(held), "doc_id").select("toxic", mixing.posteriors(model).alias("p")).collect()
    right = [(sum(r.p[k] for k in toxic) > 0.5) == bool(r.toxic) for r in rows]
    assert sum(right) >= 0.93 * len(right)
    assert mixing.learn_words(docs.join(labels.where("toxic = 0"), "doc_id"), "toxic") == {}


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)] + [(100, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int").withColumn("tokens", F.lit(0))
    assert mixing.mixing_rates(odd_docs, labels).count() == odd_docs.count()
    mixed = mixing.mix(odd_docs, labels)
    assert mixed.columns == odd_docs.columns
    assert mixing.mix(odd_docs, labels.limit(0)).count() == odd_docs.count()
    rates = mixing.mixing_rates(odd_docs, labels)
    want, texts = Counter(), odd_docs.select("doc_id", "text").distinct()
    for r in rates.distinct().join(texts.groupBy("doc_id").count().where("count = 1"), "doc_id").join(texts, "doc_id").select("doc_id", mixing.copies(F.col("rate"), F.col("doc_id"), F.col("text")).alias("k")).collect():
        want[r.doc_id] += r.k * (3 if r.doc_id == 5 else 1)
    assert {i: n for i, n in Counter(r.doc_id for r in mixed.collect()).items() if i is not None} == +want
    assert mixing.mixing_rates(no_docs, labels).count() == mixing.mix(no_docs, labels).count() == 0


def test_warc_audit_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    got = warc.audit_drill(spark.read.parquet(f"{DATA}/pages.parquet"))
    assert sorted_rows(got, sorted(got.columns)) == sorted(
        map(tuple, con.execute(f"SELECT page_id, record_length, record_offset, record_sha256, status, warc_file FROM ({queries.OP10_SQL})").fetchall()), key=repr)
    assert {r.status for r in got.select("status").distinct().collect()} == {"ok", "corrupt", "missing", "added"}


def test_warc_trees(spark):
    leaf = lambda n, bad=(): spark.createDataFrame([(k, f"{'x' if k in bad else 'h'}{k}") for k in range(n)], "node long, hash string")
    found = lambda a, b: sorted(r.node for r in warc.audit(a, b).collect())
    assert found(leaf(700), leaf(700)) == []
    assert found(leaf(700), leaf(700, {0, 63, 64, 699})) == [0, 63, 64, 699]
    assert found(leaf(70), leaf(66)) == [66, 67, 68, 69]
    assert found(leaf(1), leaf(1, {0})) == [0] and found(leaf(0 + 1).limit(0), leaf(1)) == [0] and found(leaf(1).limit(0), leaf(1).limit(0)) == []


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>é\r\n\r\nx</p>"), (2, None, None), (None, "http://b", ""), (3, "http://c", "y" * 100000), (3, "http://c", "y" * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rank", F.lit(1))
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w") + "/*.txt").collect()
    assert sorted((r.url, bytes(r.content).decode()) for r in got) == sorted((u or "", h or "") for _, u, h in rows)
    assert all(r.intact for r in got)
    # equal replicas agree whatever the order of their rows
    tied = spark.createDataFrame([(7, "u", h) for h in "abcdef"], "page_id long, url string, html string")
    other = spark.createDataFrame([(7, "u", h) for h in "fedcba"], "page_id long, url string, html string")
    assert warc.fixity_report(warc.laid_out(tied), warc.laid_out(other)).where("status <> 'ok'").count() == 0
    laid = {(r.page_id, r.record_offset) for r in warc.laid_out(pages).collect()}
    assert len(laid) == 5
    assert warc.audit_drill(pages).where("status <> 'ok'").count() == 0 and warc.audit_drill(pages.limit(0)).count() == 0


def test_warc_faults_are_told_apart(spark):
    """A lost record is one row, and so is an added one; what only lies elsewhere is none."""
    pages = spark.range(1000).selectExpr("id AS page_id", "concat('u', id % 7) AS url", "repeat('x', cast(id % 50 AS int)) AS html")
    odd = spark.createDataFrame([(None, None, None), (None, None, None), (3, None, "a"), (3, None, "b")], "page_id long, url string, html string")
    pages = pages.unionByName(odd)
    laid = warc.laid_out(pages)
    tell = lambda replica: sorted((r.page_id if r.page_id is not None else -1, r.status) for r in warc.fixity_report(laid, replica).where("status <> 'ok'").collect())
    assert tell(warc.laid_out(pages)) == []
    assert tell(warc.laid_out(pages.where("page_id is null or page_id <> 500"))) == [(500, "missing")]
    added = spark.createDataFrame([(499, "new", "n"), (None, None, None)], pages.schema)
    assert tell(warc.laid_out(pages.unionByName(added))) == [(-1, "added"), (499, "added")]
    turned = pages.withColumn("html", F.when(F.col("page_id").isin(3, 700), "longer than before " * 9).otherwise(F.col("html")))
    assert tell(warc.laid_out(turned.where("page_id is null or page_id not in (10, 999)"))) == sorted([(10, "missing"), (999, "missing"), (700, "corrupt"), (3, "corrupt"), (3, "corrupt"), (3, "corrupt")])
    assert tell(warc.laid_out(pages.where("page_id < 600 and page_id <> 3"))) == sorted([(-1, "missing")] * 2 + [(3, "missing")] * 3 + [(k, "missing") for k in range(600, 1000)])
    assert tell(warc.laid_out(pages.limit(0))) == sorted((r.page_id if r.page_id is not None else -1, "missing") for r in pages.collect())


def test_warc_reader_survives(spark, tmp_path):
    """Heads without a usable length, a cut file and a compressed one."""
    one = b"WARC/1.1\r\nWARC-Target-URI: a\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n"
    odd = b"WARC/1.1\r\nWARC-Target-URI: b\r\nContent-Length: many\r\n\r\nxy\r\n\r\n"
    none = b"WARC/1.1\r\nWARC-Target-URI: c\r\n\r\nz\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + odd + none + one[:-6])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(odd))
    got = [(r.file.rsplit("/")[-1], r.url, bytes(r.content), r.intact) for r in warc.read_warc(spark, str(tmp_path)).orderBy("file", "record_offset").collect()]
    a, b = "a.warc", "b.warc.gz"
    assert got == [(a, "a", b"abc", True), (a, "b", b"xy", False), (a, "c", b"z", False), (a, "a", b"a", False), (b, "a", b"abc", True), (b, "b", b"xy\r\n\r\n", False)]


def test_columns_of_any_name(spark):
    """A dot, a backquote and names that the stages use do no harm."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit("x")).withColumn("_row", F.lit(2)).withColumn("_found", F.lit(2)).withColumn("fence_marks", F.lit(0))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for kept in (quality.keep_good(docs), secrets.redact(docs), simhash.keep_one(docs), similar.keep_one(docs), mixing.mix(docs, labels)):
        assert kept.columns == docs.columns
        assert {(r["a.b"], r["c`d"], r["_row"]) for r in kept.collect()} == {(1, "x", 2)}
    named = langid.identify(docs, langid.train(docs))
    assert named.count() == 40 and "a.b" in named.columns


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, DATA)
        assert step.columns == docs.columns, name
        step = spark.createDataFrame(step.toPandas(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, step, DATA)
    got = corpus_pipeline.run(spark, DATA)
    assert sorted_rows(got) == sorted_rows(last) and got.count() > 0
