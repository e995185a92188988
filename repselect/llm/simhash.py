"""SimHash near-dedup with a pigeonring candidate filter.

A fingerprint of 64 bits is laid out as a ring of ``SEGMENTS`` segments. Two fingerprints that differ in
at most ``t`` bits have a start segment from which every chain of ``l`` consecutive segments differs in at
most ``floor(l * t / SEGMENTS)`` bits. The leading segments of such a chain have a budget of zero, so they
are an equi-join key; longer chains prune what shares the key, and the full Hamming distance decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from repselect.llm.components import connected_components, local_roots
from repselect.llm.rows import all_columns
from repselect.session import settled

SEGMENTS = 7
#: Most fingerprints that one bucket hands to the numpy comparison; larger buckets are split, not cut.
BUCKET = 512
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``, repeats included; zero without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:min(n, at + CHUNK)], stops[at:at + CHUNK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` with the signed fingerprint of each whole text in ``out`` (replaced if it exists)."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    return docs.withColumn(out, simhash(F.col(text)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring(segments: int = SEGMENTS) -> list[int]:
    """Bit masks of the segments in ring order, widths as equal as can be."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def chains(start: int, distance: int, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(mask of the chain, budget) from ``start`` for each length."""
    masks, mask, out = ring(segments), 0, []
    for length in range(1, segments + 1):
        mask |= masks[(start + length - 1) % segments]
        out.append((mask, length * distance // segments))
    return out


def split_mask(mask: int, distance: int) -> list[int]:
    """Masks that fix one of ``distance + 1`` parts of the free bits too: each pair within the distance
    that agrees on ``mask`` agrees on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = distance + 1
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def _links_of_bucket(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the near pairs of one bucket."""
    bits = fps.view(np.uint64)
    i, j = np.triu_indices(len(bits), 1)
    differ = bits[i] ^ bits[j]
    for mask, budget in chains(start, distance):  # the last chain is the whole ring: the full check
        near = np.bitwise_count(differ & np.uint64(mask)) <= budget
        i, j, differ = i[near], j[near], differ[near]
    root = local_roots(len(bits), i, j)
    member = np.flatnonzero(root != np.arange(len(bits)))
    return fps[member], fps[root[member]]


def _bucket_links(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b = [], []
            for start, fps in zip(batch.column("start").to_pylist(), batch.column("fps")):
                x, y = _links_of_bucket(np.sort(fps.values.to_numpy(zero_copy_only=False)), start, distance)
                a.append(x)
                b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

    return run


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``distance`` bits.

    Each bucket of a chain key gives a star for each of its groups, not all its pairs. A bucket of more
    than ``BUCKET`` fingerprints is dealt by finer keys (``split_mask``) until the free bits cannot hold
    more; no bucket is capped.
    """
    exact = max(length for length, (_, budget) in enumerate(chains(0, distance), 1) if not budget)
    level = {(start, chains(start, distance)[exact - 1][0]) for start in range(SEGMENTS)}
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("start"), F.lit(_signed(m)).alias("mask")) for s, m in sorted(level)])).alias("k")).select("fp", "k.*")
    found = None
    while True:
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        bounded = all(2 ** (64 - m.bit_count()) <= BUCKET for _, m in level)
        small, hot = keyed, None
        if not bounded:
            hot = settled(keyed.groupBy("start", "mask", "key").count().where(F.col("count") > BUCKET).drop("count"))
            hot = None if hot.isEmpty() else hot
        if hot is not None:
            small = keyed.join(hot, ["start", "mask", "key"], "left_anti")
        buckets = small.groupBy("start", "mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        part = buckets.select("start", "fps").mapInArrow(_bucket_links(distance), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if hot is None:
            return found
        children = {(s, m): split_mask(m, distance) for s, m in level}
        level = {(s, x) for (s, _), xs in children.items() for x in xs}
        finer = keyed.sparkSession.createDataFrame(  # a fixed table of masks, whatever the data
            [(s, _signed(m), _signed(x)) for (s, m), xs in children.items() for x in xs], "start int, mask long, finer long")
        keyed = settled(
            keyed.join(hot, ["start", "mask", "key"], "left_semi")
            .join(F.broadcast(finer), ["start", "mask"]).select("fp", "start", F.col("finer").alias("mask")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable by fingerprints that differ in at most
    ``distance`` bits. Null and wordless texts have fingerprint zero and are linked like any other; equal
    texts share a fingerprint, which is compared once. A null ``doc_id`` keeps its row and never becomes
    the smallest; if a component has no other id, ``component_id`` is null. Other columns are ignored.
    """
    marked = settled(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"))
    fps = settled(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(fps, distance))
    rooted = settled(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(linked, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one whose id names the group.

    Columns stay as they are. Of rows that repeat an id only one stays; rows without an id stay.
    """
    groups = near_duplicates(docs, distance=distance)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").select(all_columns(docs))
    return first.dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
