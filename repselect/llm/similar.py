"""SimHash near-dedup at a similarity of word-shingle sets: one document of each group of near copies.

A text is the set of hashes of its five-word shingles; equal texts are one node. Candidates come in two steps,
and the exact Jaccard similarity of the whole sets decides on every one of them.

1. Pigeonring links of the sets' 64-bit SimHash fingerprints, as in ``simhash.links``, within few bits.
2. A similarity of 0.8 turns about ten of 64 bits, and no key of fingerprint segments is selective at that
   distance. So all others come from shared rare shingles: of two sets with a similarity of at least ``s`` both
   have an element in common among their first ``n - ceil(s * n) + 1`` in any order that all sets share. In
   such a bucket fingerprints within ``FAR`` bits are candidates, and of these only pairs whose wide fingerprints
   of 256 bits differ in at most ``WIDE``, so that few whole sets are moved. Elements of many texts are put last in
   the order, so that the others, a text's own, stand first and small buckets come before large ones. A large bucket
   is dealt out in parts and pairs of parts, never cut. In the bucket of an element of many texts, members carry a
   bitmap of their own elements: each bit that only one of two sets has stands for an element the other lacks, and
   pairs that lack too many are dropped. Pages of one template, which share most but not enough, end there, before
   they become pairs; the bound is exact.

Fingerprints of a similarity of 0.8 differ in 8 to 10 bits with a deviation of 3 (12 bits for a set of four), so
``FAR`` and ``FAR_SHORT`` lose fewer than two such pairs in 100,000, whatever the sizes, and the wide ones, 41 bits
with a deviation of 6 (48 for a set of four), fewer than one in a million. No other step can lose a link.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from repselect.llm import bpe, simhash
from repselect.llm.bpe import runs
from repselect.llm.components import connected_components, local_roots
from repselect.llm.quality import BLANKS
from repselect.llm.rows import all_columns
from repselect.session import CLEANUP, released, settled

#: Bits within which fingerprints link at once, bits within which those of a bucket are candidates.
NEAR, FAR = 2, 24
#: Sets below this size turn more bits, and the bits within which they are candidates.
SHORT, FAR_SHORT = 5, 28
#: Fingerprints of 64 bits that make a wide one, its bits within which pairs stay, and those of short sets.
PARTS, WIDE, WIDE_SHORT = 4, 72, 82
#: Members of a bucket that are compared at once.
BUCKET = 2048
#: Elements of more texts than this go to the end of the order, those of most texts first, up to a number that may
#: be broadcast (8 bytes each).
OFTEN, LAST = 32, 1 << 20
#: Elements of a run of texts in which repeated ones are counted.
COUNTED = 1 << 22
#: Bytes of buckets that a Python worker is handed at once.
BATCH = "16m"
#: Bytes of bitmaps of pairs that are held against each other at once.
PAIRED = 1 << 22
#: Words of 64 bits of a bitmap of hashes (2 MB), which is broadcast. It only spares rows that would find no
#: partner; when it is too full for that, nothing else changes.
WORDS = 1 << 18
#: Members and elements of a tile's part in the last round.
TILE, TILE_ELEMENTS = 512, 1 << 19
#: Elements of a tile that are held against each other at once.
COLUMNS = 1 << 13
#: Most rounds in which a member only meets its nearest, before all that is still apart is compared; they end
#: when less than the share ``FRUITFUL`` of these pairs is similar.
ROUNDS, FRUITFUL = 12, 0.1
#: Columns of the other parts of a wide fingerprint.
FIELDS = [f"fp{k}" for k in range(1, PARTS)]
LOG = logging.getLogger(__name__)


def alone(run: Callable) -> Callable:
    """``run`` in a Python worker that first lets go of what encoding has left in it."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        yield from run(batches)

    return first


def elements(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; one of all words if they are fewer, none without words."""
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 7) for a, b in zip(starts, stops)], np.uint64))


def mixed(own: np.ndarray, part: int) -> np.ndarray:
    """Other hashes of the same elements, for each part of a wide fingerprint; part 0 is ``own``."""
    if not part:
        return own
    x = own + np.uint64(part * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(own: np.ndarray, part: int = 0) -> int:
    """Signed 64-bit SimHash of a set of hashes."""
    own = mixed(own, part)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), simhash.CHUNK):
        counts += np.unpackbits(own[at:at + simhash.CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view("<i8")[0])


def least_common(n: int, similarity: float) -> int:
    """Fewest common elements of a union of ``n``; rounding errors aside."""
    return math.ceil(similarity * n - 1e-9)


def _late(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which elements of a set go to the end of the order."""
    if not len(last) or not len(own):
        return np.zeros(len(own), bool)
    return last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own


def early(own: np.ndarray, last: np.ndarray, similarity: float) -> tuple[np.ndarray, int, bytes]:
    """The first elements of a set, as many as it takes to meet every similar set; how many of them are not in
    ``last``; and, if that is not all of them, a bitmap of all the set's elements that are not.

    The bitmap has about half a byte an element, a power of two, and times the elements of ``last`` among the first it
    takes no more room than the set.
    """
    many = len(own) - least_common(len(own), similarity) + 1
    late = _late(own, last)
    rare = own[~late]
    if len(rare) >= many or not len(own):
        return rare[:many], min(many, len(rare)), b""
    room = max(8 * len(own) // (many - len(rare)), 8)
    size = 1 << min((max(len(rare) // 2, 8) - 1).bit_length(), room.bit_length() - 1)
    bits = np.zeros(size * 8, bool)
    bits[rare & np.uint64(size * 8 - 1)] = True
    return np.concatenate((rare, own[late]))[:many], len(rare), np.packbits(bits, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of a bucket's members, folded to the size of the smaller of a pair."""

    def __init__(self, maps: list[bytes]):
        self.maps, self.sizes = maps, np.array(list(map(len, maps)), np.int64)
        self.folded: dict[int, np.ndarray] = {}

    def _of(self, size: int) -> np.ndarray:
        if size not in self.folded:
            out = np.zeros((len(self.maps), size // 8), np.uint64)
            for k in np.flatnonzero(self.sizes >= size):
                out[k] = np.bitwise_or.reduce(np.frombuffer(self.maps[k], np.uint64).reshape(-1, size // 8), axis=0)
            self.folded[size] = out
        return self.folded[size]

    def lacking(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At least how many elements of members ``x[k]`` the members ``y[k]`` lack, and the other way round."""
        out = np.zeros((2, len(x)), np.int64)
        sizes = np.minimum(self.sizes[x], self.sizes[y])
        for size in np.unique(sizes).tolist():
            all_at = np.flatnonzero(sizes == size)
            for at in np.array_split(all_at, -(-len(all_at) * size // PAIRED)):
                a, b = self._of(size)[x[at]], self._of(size)[y[at]]
                both = np.bitwise_count(a & b).sum(axis=1)
                out[0, at], out[1, at] = np.bitwise_count(a).sum(axis=1) - both, np.bitwise_count(b).sum(axis=1) - both
        return out[0], out[1]


def _listed(found: list[np.ndarray]) -> pa.ListArray:
    borders = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(borders, np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _noded(docs: DataFrame) -> DataFrame:
    """``doc_id, text, node``; equal texts are one node, and so are all without words."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.when(F.btrim(text, F.lit(BLANKS)) == "", F.lit(0)).otherwise(F.xxhash64(text)).cast("long").alias("node"))


def _bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes in ``column``; the driver receives one number a word at most."""
    h = F.col(column)
    bits = rows.select(F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(WORDS, np.uint64)
    out[found.word.to_numpy()] = found.bit.to_numpy(np.int64).view(np.uint64)
    return out


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    return (bitmap[(h >> np.uint64(20)) & np.uint64(WORDS - 1)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def _own(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("own")]


def _sets(noded: DataFrame, shingle: int) -> DataFrame:
    """``node, own``: the whole set of each node, eight bytes an element. A node whose texts lie in several
    batches has several equal rows."""
    @alone
    def run(batches):
        for batch in batches:
            node, at = np.unique(batch.column("node").to_numpy(), return_index=True)
            found = [elements(t, shingle).tobytes() for t in batch.column("text").take(pa.array(at)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found, pa.binary())], ["node", "own"])

    return noded.select("node", "text").mapInArrow(run, "node long, own binary")


def _often(sets: DataFrame) -> np.ndarray:
    """Elements of more than ``OFTEN`` texts, as far as runs of texts tell: those that fewer than three of a run
    have are not counted. This decides the order only, so nothing hangs on what is missed."""
    @alone
    def run(batches):
        for batch in batches:
            own = _own(batch)
            for a, b in runs(list(map(len, own)), COUNTED):
                keys, n = np.unique(np.concatenate([*own[a:b], np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[n > 2].view(np.int64)), pa.array(n[n > 2].astype(np.int64))], ["key", "n"])

    counted = sets.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN)
    rows = counted.orderBy(F.desc("n"), "key").limit(LAST).select("key").toPandas()
    return np.sort(rows.key.to_numpy(np.int64).view(np.uint64))


def _prefixes(sets: DataFrame, similarity: float, last) -> DataFrame:
    """``node, n, fp, fp1.., keys, rare, bits``: one row a node, size and wide fingerprint of its set, and what
    ``early`` gives."""
    names = ["node", "n", "fp", *FIELDS, "keys", "rare", "bits"]

    @alone
    def run(batches):
        for batch in batches:
            found = _own(batch)
            keys = [early(x, last.value, similarity) for x in found]
            wide = [pa.array([fingerprint(x, k) for x in found], pa.int64()) for k in range(PARTS)]
            keys, rare, bits = zip(*keys) if keys else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(map(len, found), pa.int32()), *wide, _listed(list(keys)), pa.array(rare, pa.int32()), pa.array(bits, pa.binary())], names)

    rows = sets.mapInArrow(run, "node long, n int, fp long, " + "".join(f"{f} long, " for f in FIELDS) + "keys array<long>, rare int, bits binary")
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in names[1:]])


def _held(sets: DataFrame, wanted) -> DataFrame:
    """``node, own``: the sets of the nodes in the bitmap ``wanted``, one row a node."""
    @alone
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_in(wanted.value, batch.column("node").to_numpy())))

    return sets.mapInArrow(run, "node long, own binary").groupBy("node").agg(F.first("own").alias("own"))


def _entries(prefixes: DataFrame) -> DataFrame:
    """``key, node, n, fp, bits, many``: a row for each early element that other nodes have early, too; ``bits`` are
    those of elements of many texts, else empty. Settled, and ``prefixes``, which must be so, are released."""
    keys = prefixes.select(F.explode("keys").alias("key"))
    shared = settled(keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"))
    bitmap = prefixes.sparkSession.sparkContext.broadcast(_bitmap(shared, "key"))

    @alone
    def run(batches):
        for batch in batches:
            keys, bits = [], []
            for own, rare, own_bits in zip(_sets_of(batch.column("keys")), batch.column("rare").to_pylist(), batch.column("bits").to_pylist()):
                at = np.flatnonzero(_in(bitmap.value, own))
                keys.append(own[at])
                n_rare = int((at < rare).sum())
                bits += [b""] * n_rare + [own_bits] * (len(at) - n_rare)
            many = np.array([len(k) for k in keys], np.int64)
            again = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), many))
            yield pa.RecordBatch.from_arrays([_listed(keys).values, again("node"), again("n"), again("fp"), pa.array(bits, pa.binary())], ["key", "node", "n", "fp", "bits"])

    entries = settled(prefixes.select("node", "n", "fp", "keys", "rare", "bits").mapInArrow(run, "key long, node long, n int, fp long, bits binary").join(shared, "key"))
    released(prefixes, shared)
    return entries


def _sieved(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The ``pairs`` whose wide fingerprints are near enough."""
    side = lambda node, mark: wide.select(F.col("node").alias(node), *[F.col(c).alias(f"{mark}{k}") for k, c in enumerate(wide.columns[1:])])
    differ = [F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(1, PARTS + 1)]
    most = F.when(F.least("x0", "y0") < SHORT, WIDE_SHORT).otherwise(WIDE)
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(sum(differ[1:], differ[0]) <= most).select(*pairs.columns)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b, p, q, near``: whether the whole sets of each pair are similar. Only sets that stand in a pair are moved;
    ``pairs`` must be settled."""
    @alone
    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(*[[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("x", "y")]):
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                out.append(both >= least_common(len(x) + len(y) - both, similarity))
            yield pa.RecordBatch.from_arrays([*map(batch.column, "abpq"), pa.array(out, pa.bool_())], [*"abpq", "near"])

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = _held(sets, sets.sparkSession.sparkContext.broadcast(_bitmap(ends, "node")))
    side = lambda node, own: held.select(F.col("node").alias(node), F.col("own").alias(own))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select(*"abpq", "x", "y").mapInArrow(run, "a long, b long, p long, q long, near boolean")


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements ``sets[x[k]]`` and ``sets[y[k]]`` share."""
    out = np.zeros(len(x), np.int64)
    _, column, many = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), list(map(len, sets))), many[column] > 1
    owner, column = owner[shared], (np.cumsum(many > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        size = -(-min(COLUMNS, width - at) // 64) * 64
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        bits = np.zeros((len(sets), size), bool)
        bits[owner[lo:hi], column[lo:hi] - at] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        for part in np.array_split(np.arange(len(x)), -(-len(x) * size // 8 // PAIRED) or 1):
            out[part] += np.bitwise_count(bits[x[part]] & bits[y[part]]).sum(axis=1, dtype=np.int64)
    return out


class Members:
    """Members of the buckets or tiles of a batch."""

    def __init__(self, column: pa.Array, similarity: float):
        self.similarity, flat = similarity, column.values
        self.borders = column.offsets.to_numpy()
        self.node, self.n, self.fp, self.root, self.side = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        self.bitmaps, names = flat.field(5), flat.type.names
        self.wide = [flat.field(f).to_numpy(zero_copy_only=False).view(np.uint64) for f in FIELDS if f in names]
        self.own, self.known = (flat.field(f) if f in names else None for f in ("own", "known"))

    def decided(self, lo: int, hi: int) -> np.ndarray:
        """Pairs ``i * (hi - lo) + j``, both ways round, of members from ``lo`` to ``hi`` one of which knows the other."""
        at, order = self.known.offsets.to_numpy()[lo:hi + 1], np.argsort(self.node[lo:hi])
        other = self.known.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
        i, node = np.repeat(np.arange(hi - lo), np.diff(at)), self.node[lo:hi][order]
        place = np.searchsorted(node, other) % (hi - lo)
        i, j = i[node[place] == other], order[place[node[place] == other]]
        return np.concatenate((i * (hi - lo) + j, j * (hi - lo) + i))

    def chunks(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``own, cols, far, fit`` of the members from ``lo`` to ``hi``, some of them at once: whether ``own[i]`` and
        ``cols[j]`` have unlike roots, sizes that allow the similarity, fingerprints within ``FAR`` bits (``FAR_SHORT``
        if one is short), wide ones (if given) within ``WIDE`` and bitmaps (if any) that don't rule it out. Members on side
        0 meet those of side 1, if there are two."""
        n, root, side, bits = self.n, self.root, self.side[lo:hi], self.fp.view(np.uint64)
        rows = lo + np.flatnonzero(side == 0)
        cols = lo + np.flatnonzero(side == 1) if side.any() else rows
        maps = Bitmaps(self.bitmaps.slice(lo, hi - lo).to_pylist())
        for k in range(0, len(rows), 256):
            own = rows[k:k + 256]
            far = np.bitwise_count(bits[own, None] ^ bits[None, cols])
            small, large = np.minimum(n[own, None], n[None, cols]), np.maximum(n[own, None], n[None, cols])
            fit = (far <= np.where(small < SHORT, FAR_SHORT, FAR)) & (root[own, None] != root[None, cols]) & (small >= self.similarity * large - 1e-9)
            if self.wide:
                i, j = np.nonzero(fit)
                differ = far[i, j].astype(np.int64)
                for part in self.wide:
                    differ += np.bitwise_count(part[own[i]] ^ part[cols[j]])
                fit[i, j] = differ <= np.where(small[i, j] < SHORT, WIDE_SHORT, WIDE)
            if maps.sizes[0]:
                for at_once in np.array_split(np.flatnonzero(fit), -(-fit.sum() // (1 << 15)) or 1):
                    i, j = np.unravel_index(at_once, fit.shape)
                    p, q = own[i], cols[j]
                    less_p, less_q = maps.lacking(p - lo, q - lo)
                    common = np.minimum(n[p] - less_p, n[q] - less_q)
                    fit[i, j] = common * (1 + self.similarity) >= self.similarity * (n[p].astype(np.int64) + n[q]) - 1e-6
            yield own, cols, far, fit


def _candidates(similarity: float, nearest: bool):
    """Pairs ``a, b`` of buckets that fit, and their roots ``p, q``; with ``nearest``, of each member and the one nearest
    to it."""
    @alone
    def run(batches):
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(4)]
            m = Members(batch.column("all"), similarity)
            for lo, hi in zip(m.borders, m.borders[1:]):
                for own, cols, far, fit in m.chunks(lo, hi):
                    if nearest:
                        best = np.where(fit, far, 255).argmin(axis=1)
                        i = np.flatnonzero(fit[np.arange(len(own)), best])
                        j = best[i]
                    else:
                        i, j = np.nonzero(fit)
                    x, y = own[i], cols[j]
                    x, y = np.where(m.node[x] < m.node[y], (x, y), (y, x))
                    for found, column in zip(out, (m.node[x], m.node[y], m.root[x], m.root[y])):
                        found.append(column)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], [*"abpq"])

    return run


def _neighbours(similarity: float):
    """``a, b, pairs`` of buckets: a row for each member that fits another one, with one member of its group in the
    bucket, the same for the whole group, and the pairs it is the first of. The pairs themselves are not listed."""
    @alone
    def run(batches):
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            m = Members(batch.column("all"), similarity)
            for lo, hi in zip(m.borders, m.borders[1:]):
                star, every, pairs = np.arange(hi - lo), np.arange(hi - lo), np.zeros(hi - lo, np.int64)
                met = np.zeros(hi - lo, bool)
                for own, cols, _, fit in m.chunks(lo, hi):
                    i, j = np.nonzero(fit)
                    x, y = own[i] - lo, cols[j] - lo
                    if not m.side[lo:hi].any():
                        x, y = x[x < y], y[x < y]
                    pairs += np.bincount(x, minlength=hi - lo)
                    met[x] = met[y] = True
                    star = local_roots(hi - lo, np.concatenate((every, x)), np.concatenate((star, y)))
                at = lo + np.flatnonzero(met)
                for found, column in zip(out, (m.node[at], m.node[lo + star[met]], pairs[met])):
                    found.append(column)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b", "pairs"])

    return run


def _decided(similarity: float):
    """``a, b, pairs`` of tiles: links that join all roots with similar members, as a star for each group of roots, and in a
    row without a link the number of pairs whose whole sets were compared."""
    @alone
    def run(batches):
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            m = Members(batch.column("all"), similarity)
            for lo, hi in zip(m.borders, m.borders[1:]):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in m.own.slice(lo, hi - lo)]
                names, of = np.unique(m.root[lo:hi], return_inverse=True)
                star, every, pairs, decided = np.arange(len(names)), np.arange(len(names)), 0, m.decided(lo, hi)
                for own, cols, _, fit in m.chunks(lo, hi):
                    i, j = np.nonzero(fit)
                    x, y = own[i] - lo, cols[j] - lo
                    new = (star[of[x]] != star[of[y]]) & ~np.isin(x * (hi - lo) + y, decided)
                    if not m.side[lo:hi].any():
                        new &= x < y
                    x, y = x[new], y[new]
                    pairs += len(x)
                    both = _common(sets, x, y)
                    union = m.n[lo + x].astype(np.int64) + m.n[lo + y] - both
                    near = both >= np.ceil(similarity * union - 1e-9)
                    star = local_roots(len(names), np.concatenate((every, of[x[near]])), np.concatenate((star, of[y[near]])))
                moved = star != every
                for found, column in zip(out, (names[moved], names[star[moved]], np.zeros(moved.sum(), np.int64))):
                    found.append(column)
                for found, one in zip(out, (names[0], names[0], pairs)):
                    found.append(np.array([one], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b", "pairs"])

    return run


def _buckets(entries: DataFrame, turn: int, whole: bool) -> DataFrame:
    """``all``: members of each bucket in parts of about ``BUCKET``, dealt anew each turn; if ``whole``, large
    buckets also give all pairs of their parts. Wide fingerprints that ``entries`` have go with them."""
    more = [f for f in FIELDS if f in entries.columns]
    parts = F.ceil(F.col("many") / BUCKET).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(turn)), parts).cast("int")
    dealt = _dealt(entries.select("key", "node", "n", "fp", "bits", "root", *more, parts.alias("parts"), part.alias("part")), whole)
    return dealt.groupBy("key", "p", "q").agg(F.collect_list(F.struct("node", "n", "fp", "root", "side", "bits", *more)).alias("all"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("all")


def _dealt(members: DataFrame, whole: bool) -> DataFrame:
    """``members`` in tiles ``p, q`` of their ``part`` of ``parts``: if ``whole``, of all pairs of parts."""
    kept = [c for c in members.columns if c not in ("parts", "part")]
    if not whole:
        return members.select(*kept, F.col("part").alias("p"), F.col("part").alias("q"), F.lit(0).alias("side"))
    dealt = members.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return dealt.select(*kept, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).cast("int").alias("side"))


def _last_links(placed: DataFrame, wide: DataFrame, sets: DataFrame, roots: DataFrame, decided: DataFrame, similarity: float, turn: int) -> tuple[DataFrame, int]:
    """Settled links ``a, b`` of roots that join all components with similar members (and of some with themselves), and
    the number of pairs compared, which are not ``decided`` yet.

    Members that fit another one in a bucket form groups, which are compared tile by tile: a whole set moves once
    a tile, each two members meet in one tile, and a tile gives a star for each of its groups, so that no row stands for a
    pair, however large a group. Only where a group is so large and loose that this would move more sets than its pairs
    do, they are listed and compared one by one.
    """
    placed = placed.join(wide.select("node", *FIELDS), "node")
    met = settled(_buckets(placed, turn, True).mapInArrow(_neighbours(similarity), "a long, b long, pairs long").groupBy("a", "b").agg(F.sum("pairs").alias("pairs")))
    groups = connected_components(met.select("a", "b"))
    members = met.groupBy(F.col("a").alias("node")).agg(F.sum("pairs").alias("pairs")).join(groups.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    members = settled(members.join(wide, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    released(met, groups)
    parts = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_ELEMENTS)).cast("int")
    sizes = members.groupBy("group").agg(parts.alias("parts"), F.count("*").alias("size"), F.sum("pairs").alias("pairs"))
    sizes = settled(sizes.select("group", "parts", ((F.col("parts") == 1) | (F.col("size") * F.col("parts") <= 2 * F.col("pairs"))).alias("tiled")))
    tiled = members.drop("pairs").join(sizes, "group").where("tiled").drop("tiled").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), "parts").cast("int"))
    held = _held(sets, sets.sparkSession.sparkContext.broadcast(_bitmap(members, "node")))
    known = decided.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("known"))
    tiled = tiled.join(known, "node", "left").withColumn("known", F.coalesce("known", F.array().cast("array<long>")))
    tiles = _dealt(tiled, True).join(held, "node").groupBy("group", "p", "q").agg(
        F.collect_list(F.struct("node", "n", "fp", "root", "side", F.lit(b"").alias("bits"), *FIELDS, "own", "known")).alias("all"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("all")
    links = settled(tiles.mapInArrow(_decided(similarity), "a long, b long, pairs long"))
    pairs = links.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    loose = members.join(sizes.where("not tiled"), "group", "left_semi").select("node")
    if not sizes.where("not tiled").isEmpty():
        found = settled(_buckets(placed.join(loose, "node", "left_semi"), turn, True).mapInArrow(_candidates(similarity, False), "a long, b long, p long, q long").dropDuplicates(["a", "b"]).join(decided, ["a", "b"], "left_anti"))
        told = settled(_verified(found, sets, similarity))
        pairs += told.count()
        tiled, links = links, settled(links.select("a", "b").unionByName(told.where("near").select(F.col("p").alias("a"), F.col("q").alias("b"))))
        released(found, told, tiled)
    released(members, sizes)
    return links, pairs


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, Arrow batches hold ``BATCH`` bytes at most (a row of buckets may be large, and Spark's own limit is
    made for small rows), and the shuffle files of every job, counts among them, go when it ends."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, CLEANUP: "true"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after ``links`` of them; the former ones are released."""
    after = connected_components(roots.toDF("a", "b").unionByName(links))
    released(roots)
    return after


def components(noded: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(node, root)`` as ``connected_components`` gives them, of all nodes of ``noded`` with at least ``similarity``.

    Rounds first compare each member of a bucket with the one nearest to it, so that large groups become one
    component by few comparisons; then every candidate that is still in two components is compared, tile by tile. A
    round's links join the roots of the one before, so that components are never worked out anew.
    """
    sets = settled(_sets(noded, shingle))
    last = sets.sparkSession.sparkContext.broadcast(_often(sets))
    prefixes = settled(_prefixes(sets, similarity, last))
    wide = settled(prefixes.drop("keys", "rare", "bits"))  # node, n and the parts of the fingerprint
    entries = _entries(prefixes)
    nodes = entries.select("node", "fp").distinct()  # only those that share a key matter from here on
    names = nodes.groupBy("fp").agg(F.min("node").alias("node"))  # nodes of one fingerprint meet in a star
    stars = nodes.join(names.withColumnRenamed("node", "first"), "fp").where("node <> first").select(F.col("node").alias("x"), F.col("first").alias("y"))
    ring = simhash.links(names.select("fp"), NEAR)
    ring = ring.join(names.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(names.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    proposed = stars.unionByName(ring)
    proposed = settled(proposed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().select("*", F.col("a").alias("p"), F.col("b").alias("q")))
    told = [settled(_verified(proposed, sets, similarity))]
    roots = connected_components(told[0].where("near").select("a", "b"))
    for turn in range(ROUNDS + 1):
        placed = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        placed = placed.join(apart, "key", "left_semi")
        decided = reduce(DataFrame.unionByName, told).where("not near").select("a", "b")  # the others have one root
        if turn and (turn == ROUNDS or near <= FRUITFUL * many):
            break
        found = _buckets(placed, turn, False).mapInArrow(_candidates(similarity, True), "a long, b long, p long, q long").dropDuplicates(["a", "b"])
        released(proposed)
        proposed = settled(_sieved(found.join(decided, ["a", "b"], "left_anti"), wide))
        told.append(settled(_verified(proposed, sets, similarity)))
        near, many = told[-1].agg(F.coalesce(F.sum(F.col("near").cast("long")), F.lit(0)), F.count("*")).first()
        LOG.info("round %d: %d of %d pairs similar", turn, near, many)
        if near:
            roots = _joined(roots, told[-1].where("near").select(F.col("p").alias("a"), F.col("q").alias("b")))
    links, many = _last_links(placed, wide, sets, roots, decided, similarity, turn)
    near = links.where("a <> b").count()
    LOG.info("round %d: %d links of components from %d pairs", turn, near, many)
    if near:
        roots = _joined(roots, links.select("a", "b"))
    released(sets, wide, entries, proposed, links, *told)
    return roots


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable by texts with a Jaccard similarity of at least
    ``similarity``. Null and wordless texts are equal to each other; a null ``doc_id`` keeps its row and never
    names a group, so a group without any other id has a null ``component_id``. Other columns are ignored.
    """
    noded = _noded(docs)
    marked = settled(noded.select("doc_id", "node"))
    with frugal(docs.sparkSession):  # everything in here is settled when it is left
        roots = components(noded, shingle, similarity)
        rooted = settled(marked.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")))
    return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group: the one whose id names it.

    Columns stay as they are. Of rows that repeat an id only one stays; rows without an id stay.
    """
    kept = similar_groups(docs, shingle, similarity).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").select(all_columns(docs))
    return first.dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull()))
