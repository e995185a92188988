import random
from collections import Counter

import numpy as np
import xxhash

from repselect.llm import simhash
from repselect.llm.components import connected_components
from .conftest import odd_rows, sorted_rows


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=2):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_brute_force(spark, odd_docs):
    rows = [(r[0], brute_fingerprint(r[1])) for r in odd_rows()]
    roots = components([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted([(i, f - (1 << 64) if f >> 63 else f, least.get(roots[f])) for i, f in rows], key=repr)
    assert sorted_rows(simhash.near_duplicates(odd_docs)) == want


def test_hot_buckets_are_split(spark, monkeypatch):
    """A ball of fingerprints around one: every bucket is hot, and no link is lost."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    centre = rng.getrandbits(64)
    for _ in range(300):
        f = centre
        for b in rng.sample(range(64), rng.randrange(9)):
            f ^= 1 << b
        fps.add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
    want = components(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    groups = lambda m: {frozenset(g) for g in _groups(m).values()}
    assert groups({signed(f): got.get(signed(f), signed(f)) for f in fps}) == groups({signed(f): r for f, r in want.items()})


def _groups(m):
    out = {}
    for k, v in m.items():
        out.setdefault(v, set()).add(k)
    return out


def test_chain_budgets():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, 2, replace=False):
            b ^= 1 << int(bit)
        assert any(all(((a ^ b) & m).bit_count() <= t for m, t in simhash.chains(s, 2)) for s in range(simhash.SEGMENTS))


def test_keep_one(spark, odd_docs, no_docs):
    groups = simhash.near_duplicates(odd_docs).where("doc_id is not null").collect()
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got.pop(None) == 2
    assert set(got) == {r.component_id for r in groups} and set(got.values()) == {1}
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_one(no_docs).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(7, 7), (None, 3), (5, 4), (1000, 900)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1000: 900}
    assert connected_components(links.where("a < 0")).count() == 0
