"""Byte-level BPE by depth-first traversal of a trie of distinct words.

The greedy merge order of BPE makes the encoding of a prefix depend on its last token only: the encoding
of ``p`` ends in token ``t`` if ``t`` is a suffix of ``p`` and stands validly behind the last token of the
rest. Distinct words share their prefixes in a trie, so each shared prefix is encoded once.
"""

from __future__ import annotations

import gc
import json
import math
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words that a Python worker remembers before it starts anew; longer words are never remembered.
REMEMBERED, LONGEST = 500_000, 64
#: Characters whose words are held at once.
AT_ONCE = 1 << 19


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the others for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder of one tokenizer file (byte-level BPE without normalizer or prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merges = {}
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # lengths of the tokens of three bytes and more by their last three bytes, the longest first
        ends: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {end: (*sorted(sizes, reverse=True), 2, 1) for end, sizes in ends.items()}
        # the merge behind each token; the short test of pairs needs one merge a token, later than its parts
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.ordered = True
        for (a, b), (rank, made) in self.merges.items():
            earlier = max(self.parts[x][0] if x in self.parts else -1 for x in (a, b))
            self.ordered &= made not in self.parts and earlier < rank
            self.parts.setdefault(made, (rank, a, b))
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: merge the pair of the lowest rank, leftmost first, until none is left."""
        out = [self.id_of[data[k:k + 1]] for k in range(len(data))]
        merges, none = self.merges.get, (1 << 60, 0)
        while len(out) > 1:
            ranks = [merges(p, none)[0] for p in zip(out, out[1:])]
            best = min(ranks)
            if best == none[0]:
                break
            k = ranks.index(best)
            out[k:k + 2] = [self.merges[out[k], out[k + 1]][1]]
        return out

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one end of ``token`` while it is merged: (part, rank of the merge that takes it),
        from the single byte to the token itself, which nothing takes. ``side`` is 1 for left, 2 for right."""
        kept = self.left if side == 1 else self.right
        if token not in kept:
            rank, path, at = math.inf, [], token
            while at in self.parts:
                path.append((at, rank))
                rank, at = self.parts[at][0], self.parts[at][side]
            kept[token] = [*path, (at, rank)][::-1]
        return kept[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b``: the parts at the border are followed in the
        order of the merges that take them. Of equal ranks the leftmost merge is the first."""
        left, right = self.edge(a, 2), self.edge(b, 1)
        i = j = 0
        while True:
            (x, taken_x), (y, taken_y) = left[i], right[j]
            across = self.merges.get((x, y))
            if across and across[0] < taken_x and across[0] <= taken_y:
                return False
            if taken_x == taken_y == math.inf:
                return True
            if taken_x <= taken_y:
                i += 1
            else:
                j += 1

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand right behind token ``a``; -1 is the start of a word."""
        known = self.pairs.get((a, b))
        if known is None:
            if a < 0:
                known = self.merged(self.bytes_of[b]) == [b]
            elif self.ordered:
                known = self.follows(-1, b) and self.apart(a, b)
            else:
                known = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def learn(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words.

        Sorted words with the lengths of their common prefixes are the trie in depth-first order: ``last``
        holds the last token of each prefix on the path, and going on to the next word keeps what it shares.
        The state of a prefix is found when a longer one first asks for it, and found once.
        """
        found: dict[bytes, tuple[int, ...]] = {}
        last: list[int | None] = [-1]
        token_of, lengths, pairs, short = self.id_of.get, self.lengths.get, self.pairs, (2, 1)
        sizes = self.bytes_of
        path = b""

        def state(depth: int) -> int:
            for size in lengths(word[depth - 3:depth] if depth > 2 else word[:depth], short):
                if size <= depth and (token := token_of(word[depth - size:depth])) is not None:
                    before = last[depth - size]
                    if before is None:
                        before = state(depth - size)
                    known = pairs.get((before, token))
                    if known or (known is None and self.follows(before, token)):
                        last[depth] = token
                        return token
            raise ValueError("no token ends here")

        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:]
            last.extend([None] * (len(word) - shared))
            if len(word) > LONGEST:  # from the front, so that no call goes deep
                for depth in range(1, len(word)):
                    if last[depth] is None:
                        state(depth)
            out, at = [], len(word)
            while at:
                token = last[at]
                if token is None:
                    token = state(at)
                out.append(token)
                at -= len(sizes[token])
            out.reverse()
            found[word] = tuple(out)
            path = word
        return found

    def encode_batch(self, texts: list[str]) -> list[array]:
        """Token ids of each whole text; a special token's own text gives its id."""
        return list(chain.from_iterable(self._encode(texts[a:b]) for a, b in runs(list(map(len, texts)), AT_ONCE)))

    def _encode(self, texts: list[str]) -> list[array]:
        cut = [self.special.split(t) if self.special else [t] for t in texts]
        marks = [self.special.findall(t) if self.special else [] for t in texts]
        words = [[WORD.findall(piece) for piece in pieces] for pieces in cut]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        fresh = set(chain.from_iterable(chain.from_iterable(words))).difference(self.words)
        learnt = self.learn([w.encode() for w in fresh])
        batch = {w: learnt[w.encode()] for w in fresh}
        self.words.update((w, ids) for w, ids in batch.items() if len(w) <= LONGEST)
        known = self.words if all(len(w) <= LONGEST for w in fresh) else {**self.words, **batch}
        out = []
        for pieces, special in zip(words, marks):
            ids: list[int] = []
            for k, piece in enumerate(pieces):
                if k:
                    ids.append(self.added[special[k - 1]])
                ids.extend(chain.from_iterable(map(known.__getitem__, piece)))
            out.append(array("i", ids))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_LOADED: dict[str, TrieBpe] = {}


def tokenizer(path: str) -> TrieBpe:
    """The tokenizer of ``path``, loaded once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def forget() -> None:
    """Lets go of the tokenizers of this Python worker and the words they remember, for an operator of another kind
    that runs in the same worker. Encoding leaves cycles, so garbage is collected."""
    if _LOADED:
        _LOADED.clear()
        gc.collect()


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Borders (from, to) of runs of rows with no more than ``limit`` in all, or of one row."""
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and held + size > limit:
            yield at, k
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the tokens of every whole text and the text they give back. Null texts
    count as empty; each input row gives one row; other columns are ignored.

    One pass through Python: rows go back in runs of ``AT_ONCE`` characters, a longer text by itself.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for start, end in runs(pc.utf8_length(texts).to_pylist(), AT_ONCE):
                found = own.encode_batch(texts.slice(start, end - start).to_pylist())
                borders = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = np.concatenate([np.frombuffer(x, np.int32) for x in found if x] or [np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(borders, flat), pa.array(map(own.decode, found), pa.string())],
                    ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(both, StructType([rows.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode_decode``."""
    return encode_decode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
