"""Centroid clustering, cross-tokenizer alignment and packing against plain versions."""

import hashlib
import math
import random
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from repselect.llm import align, cluster, pack
from .conftest import sorted_rows

DATA = "/root/testdata/sf0.001"
BYTES, PIECES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


def plain_k_means(rows, k, rounds, dims, salt):
    kept = [(key, [max(-cluster.LARGEST, min(cluster.LARGEST, math.floor(256 * x))) for x in v]) for key, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{salt}{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(x) for x in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == n]) else c for n, c in enumerate(centroids)]
    found = [(key, *nearest(v)[::-1]) for key, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(key, c, d, inertia[c], sum(inertia.values()), digest[c]) for key, c, d in found]


def test_clusters(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(k, [x + rng.gauss(0, 0.1) for x in centres[k % 9]]) for k in range(700)]
    rows += [(700 + k, [round(rng.gauss(0, 1)) / 4 for _ in range(6)]) for k in range(100)]  # many ties
    rows += [(900 + k, rows[0][1]) for k in range(60)] + [rows[3], rows[3], (None, rows[4][1])]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 5), (1003, [1.0] * 7), (1004, [None] + [1.0] * 5), (1005, [math.nan] + [1.0] * 5), (1006, [math.inf] * 6), (1007, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("key", "v", "cluster", "upper", "inertia")})
    for k, rounds in ((40, 5), (3, 2), (5, 0)):
        assert sorted_rows(cluster.report(df, k, rounds, 6, "2:")) == sorted(plain_k_means(rows, k, rounds, 6, "2:"), key=repr)
    _, centroids, scanned = cluster.k_means(df, 40, 5, 6)
    assert len(centroids) == 40 and scanned[0] > 800 and scanned[-1] < 432  # bounds save most of the later scans
    few = df.where("vec_id < 3 or vec_id = 1003")
    assert sorted_rows(cluster.report(few, 40, 5, 6)) == sorted(plain_k_means([(r[0], r[1]) for r in few.select("vec_id", "embedding").collect()], 40, 5, 6, "2:"), key=repr)
    assert cluster.report(df.where("vec_id = 1000")).count() == cluster.report(df.where("vec_id < 0"), dims=6).count() == 0
    wide = [(k, [x * 10.0 ** rng.randrange(12) for x in v]) for k, v in rows[:80]] + [(99, [1e300] * 6), (98, [-1e300] * 6)]
    far = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    assert sorted_rows(cluster.report(far, 7, 3, 6, "2:")) == sorted(plain_k_means(wide, 7, 3, 6, "2:"), key=repr)


def test_loosening_bounds_what_any_point_can_lose():
    rng = np.random.default_rng(3)
    tighter = 0
    for dims in (2, 3, 8):
        for _ in range(40):
            former = rng.normal(0, 1, (4, dims)) * 8
            moved = former + rng.normal(0, 1, (4, dims)) * rng.choice([0, 0.1, 1, 5], (4, 1))
            radius = rng.uniform(0, 6, 4)
            fall = cluster.loosening(former, moved, radius)
            for i in range(4):
                ways = rng.normal(0, 1, (500, dims))
                x = former[i] + radius[i] * rng.uniform(0, 1, (500, 1)) ** 0.2 * ways / np.linalg.norm(ways, axis=1, keepdims=True)
                drift = [np.linalg.norm(moved[j] - former[j]) for j in range(4) if j != i]
                lost = [np.linalg.norm(x - former[j], axis=1) - np.linalg.norm(x - moved[j], axis=1) for j in range(4) if j != i]
                assert np.max(lost) <= fall[i] + 1e-9 and fall[i] <= max(drift) + 1e-9
                tighter += fall[i] < 0.9 * max(drift)
    assert tighter > 100


@pytest.fixture(scope="module")
def tools():
    own = tokenizers.Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=PIECES), align.aligner(BYTES, PIECES)


def plain_alignment(text, tools):
    """(ids of A, ids of B, links, groups) by comparing byte ranges."""
    byte, piece, names = tools
    if not text:
        return [], [], [], ""
    want = (" " + text).encode()
    a, b = byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
    raw_a, raw_b = [names.bytes_a[i] for i in a], [names.bytes_b[i] for i in b]
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return [], [], [], ""
    ends_a, ends_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
    links = []
    for i, end in enumerate(ends_a):
        j = bisect_right(ends_b, end - len(raw_a[i]))
        while j < len(b) and ends_b[j] - len(raw_b[j]) < end:
            links.append((i, j))
            j += 1
    groups, x, y = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = bisect_right(ends_a, cut), bisect_right(ends_b, cut)
        groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
        x, y = p, q
    return a, b, links, ";".join(groups)


def plain_counts(rows, tools):
    found = [(key, *plain_alignment(text, tools)) for key, text in rows]
    held = Counter(pair for _, a, b, links, _ in found for pair in {(a[i], b[j]) for i, j in links})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for key, a, b, links, groups in found:
        n = [(a[i], held[a[i], b[j]]) for i, j in links]
        out.append((key, len(a), len(b), groups.count("|"), len(links), sum(most[x] == c for x, c in n), sum(c for _, c in n), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return out


ODD = [
    "▁x", "a▁b", "<0x41> <s> </s> <unk> <|endoftext|>", "\x00a\x00", "é ﬁ Å", " lead", "  two  spaces ", "tab\tx\r\n\r\n", "\U0001f468‍\U0001f469" * 50,
    " nb em　", "﻿bom", "\n", "x" * 3000, " " * 3000 + "a"]


def test_alignment(spark, odd_docs, no_docs, tools, monkeypatch):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", *["kept", "node", "p"]).unionByName(more, allowMissingColumns=True).withColumns({c: F.lit("x") for c in ("pair", "chunk", "n", "best", "salt", "n_a")})
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(plain_counts(rows, tools), key=repr)
    assert sorted_rows(align.linked_counts(docs, BYTES, PIECES)) == want
    monkeypatch.setattr(align, "CHUNK", 3000)  # many chunks, batches and lanes
    monkeypatch.setattr(align, "AT_ONCE", 500)
    monkeypatch.setattr(align, "LANE", 7)
    assert sorted_rows(align.linked_counts(docs.repartition(3), BYTES, PIECES)) == want
    spans = sorted((r.doc_id is None, r.doc_id or 0, r.ids_a, r.ids_b, list(zip(r.link_a, r.link_b))) for r in align.alignments(docs, BYTES, PIECES).collect())
    assert spans == sorted((key is None, key or 0, *plain_alignment(text, tools)[:3]) for key, text in rows)
    assert align.linked_counts(no_docs, BYTES, PIECES).count() == align.alignments(no_docs, BYTES, PIECES).count() == 0


def test_alignment_of_the_table(spark, tools):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted_rows(align.linked_counts(docs, BYTES, PIECES)) == sorted(plain_counts([(r.doc_id, r.text) for r in docs.collect()], tools), key=repr)


def test_white_space_beyond_patterns(tools):
    own = tools[2]
    text = "a" + " " * 70_000 + "b"
    assert own.tokens(text)[0] == tools[0].encode(" " + text, add_special_tokens=False).ids == own.a.encode_ordinary(" " + text)


def check_packing(rows, docs, width):
    """All that a packing must be; returns the number of sequences."""
    own = tokenizers.Tokenizer.from_file(WORDS)
    want = Counter((key, tuple(own.encode(text or "", add_special_tokens=False).ids) + (1,)) for key, text in docs)
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())
        assert len(ids) == r.length > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    seen = Counter()
    for (key, n), parts in by_doc.items():
        left = sorted(parts)
        while left:  # rows of equal id and length: any part that goes on
            for cand, count in want.items():
                if cand[0] == key and len(cand[1]) == n and seen[cand] < count:
                    take, at = [], 0
                    while at < n:
                        step = next((p for p in left if p[0] == at and p not in take and cand[1][at:at + len(p[1])] == p[1]), None)
                        if step is None:
                            break
                        take.append(step)
                        at += len(step[1])
                    if at == n:
                        for p in take:
                            left.remove(p)
                        seen[cand] += 1
                        break
            else:
                raise AssertionError((key, n))
    assert seen == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == width or at & at - 1 == 0  # no padding
    return len(by_sequence)


def test_packing(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(pack, "OUT", 2000)
    for docs in (odd_docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        for width, limit in ((2048, 2048), (64, 3)):
            monkeypatch.setattr(pack, "OPEN", limit)
            monkeypatch.setattr(pack.Packer.__init__, "__defaults__", (limit,))
            check_packing(pack.pack(docs.repartition(2), WORDS, width).collect(), plain, width)
    row = pack.pieces(pack.pack(spark.createDataFrame([(7, "Hello world")], "doc_id long, text string"), WORDS)).collect()
    ids = [*tokenizers.Tokenizer.from_file(WORDS).encode("Hello world", add_special_tokens=False).ids, 1]
    assert [(r.doc_id, r.start, r.length, r.doc_tokens) for r in sorted(row, key=lambda r: r.start)] == [(7, 0, 2, 3), (7, 2, 1, 3)]
    assert sorted(r.ids_crc32 for r in row) == sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in (ids[:2], ids[2:]))
    assert pack.pieces(pack.pack(no_docs, WORDS)).count() == 0


def test_levels_follow_the_sum_of_squares():
    rng = random.Random(4)
    packer, open_windows = pack.Packer(20, 10_000), []
    for k in range(600):
        size = rng.choice([3, 7, 11, 13, 19])

        def squares(windows):
            return sum(n * n for level, n in Counter(windows).items() if level < 20)

        tried = []
        for level in {0, *open_windows}:
            if level + size <= 20:
                after = list(open_windows)
                if level:
                    after.remove(level)
                tried.append((squares([*after, level + size]), -level))
        level = -min(tried)[1]
        assert packer.level_for(size) == level
        packer.add(k, np.arange(size, dtype=np.uint32))
        if level:
            open_windows.remove(level)
        if level + size < 20:
            open_windows.append(level + size)
        assert Counter(open_windows) == Counter({n: c for n, c in enumerate(packer.levels.tolist()) if c}) and packer.held == len(open_windows)


def test_word_ids_equal_the_library(spark):
    own, texts = pack.word_tokenizer(WORDS), [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + ODD
    texts += ["a<|endoftext|>b <|startoftext|>", "İIΣ ΣAΣ", "it's 'S 12 34", "e ́x a b\u0085c\x1cd", "가 ᆨ"]
    whole = tokenizers.Tokenizer.from_file(WORDS)
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
