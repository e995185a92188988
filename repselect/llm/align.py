"""Cross-tokenizer alignment by lockstep merging.

Two tokenizers cut the same bytes into tokens. Their tokens are linked where their byte ranges overlap, and the
bytes are cut where tokens of both end. One NumPy state vector holds the two pointers of every document of a
batch: each step emits a link for every live pointer pair, notes the cuts, moves the pointer whose token ends
first (both at a cut) and drops the pairs that have finished. A long document takes part in several lanes, each
a run of its A tokens, so that it doesn't keep the others' batch waiting.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from repselect.llm.bpe import byte_letters
from repselect.session import settled

#: A tokens of a lane, characters aligned at once, and characters of a chunk, whose documents share one list of
#: id pairs. A longer document is a batch or chunk by itself.
LANE, AT_ONCE, CHUNK = 256, 1 << 18, 1 << 21
#: White space beyond which the recursion of one library's patterns goes too deep; the other one has no such limit.
BLANK = re.compile(r"\s{65536}")
#: Copies of the table of counts among which the chunks' pairs are dealt.
SALT = 8


@dataclass
class Alignment:
    """Tokens, links and cuts of a batch. Positions count all tokens of the batch; document ``d`` owns the A
    tokens ``first_a[d]:first_a[d + 1]``, the B tokens, links and cuts likewise."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    first_link: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    first_cut: np.ndarray


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(link_a, link_b, is_cut)`` in the order of the bytes, for lanes of A tokens ``first[k]:past[k]``.

    ``ends_a`` and ``ends_b`` are the byte offsets where tokens end. Each lane begins at the B token that holds
    its first byte; a step emits one link a live lane, so the links of a lane are just its tokens' overlaps.
    """
    start = np.where(first > 0, ends_a[first - 1], 0)
    a, b, stop = first.copy(), np.searchsorted(ends_b, start, side="right"), past
    out_a, out_b, out_cut = [], [], []
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        out_a.append(a)
        out_b.append(b)
        out_cut.append(end_a == end_b)
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    none = np.zeros(0, np.int64)
    link_a, link_b, cut = (np.concatenate(x) if x else none for x in (out_a, out_b, out_cut))
    # every step of a merge moves a pointer: the sum of both gives each link its own place
    place = np.full(len(ends_a) + len(ends_b), -1, np.int64)
    place[link_a + link_b] = np.arange(len(link_a))
    order = place[place >= 0]
    return link_a[order], link_b[order], cut[order].astype(bool)


class Aligner:
    """The tokenizers of both sides and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            if vocab[a + b] < max(vocab[a], vocab[b]):
                raise ValueError("ids of merges must ascend in their order")
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path_a = path_a
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        size = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(size)))]
        self.size_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.span = size  # id pairs are numbered a * span + b
        self.names = [f"{i}{mark}" for i in range(max(len(self.bytes_a), size)) for mark in ",|;"]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides; none for a text that is null, empty or not given back byte by byte."""
        if not text:
            return [], []
        want = " " + text
        a, b, raw = self.a.encode_ordinary(want) if not BLANK.search(want) else self.spaced(want), self.b.encode(text), want.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if same else ([], [])

    def spaced(self, text: str) -> list[int]:
        """A's ids by the slower library."""
        slow = tokenizers.Tokenizer.from_file(self.path_a)
        slow.encode_special_tokens = True
        return slow.encode(text, add_special_tokens=False).ids

    def align(self, texts: list[str | None]) -> Alignment:
        """Links and cuts of whole texts, all of them in lockstep."""
        both = list(map(self.tokens, texts))
        n_a, n_b = (np.array([len(x[side]) for x in both], np.int64) for side in (0, 1))
        ids_a, ids_b = (np.fromiter((i for x in both for i in x[side]), np.int64, int(n.sum())) for side, n in ((0, n_a), (1, n_b)))
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        lanes = -(-n_a // LANE)
        doc = np.repeat(np.arange(len(texts)), lanes)
        first = first_a[doc] + LANE * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        # all documents lie on one axis of bytes: both sides of each have the same length
        link_a, link_b, cut = lockstep(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]), first, np.minimum(first + LANE, first_a[doc + 1]))
        cut_a, cut_b = link_a[cut], link_b[cut]
        return Alignment(ids_a, ids_b, first_a, first_b, link_a, link_b, np.searchsorted(link_a, first_a), cut_a, cut_b, np.searchsorted(cut_a, first_a))

    def groups(self, found: Alignment) -> list[str]:
        """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
        g = len(found.cut_a)
        own_a, own_b = (np.diff(x, prepend=-1) for x in (found.cut_a, found.cut_b))
        group_a, group_b = np.repeat(np.arange(g), own_a), np.repeat(np.arange(g), own_b)
        codes = np.empty(len(found.ids_a) + len(found.ids_b), np.int64)
        ends_a, ends_b = np.zeros(len(found.ids_a), np.int64), np.zeros(len(found.ids_b), np.int64)
        ends_a[found.cut_a], ends_b[found.cut_b] = 1, 2
        # an A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own, too
        codes[np.arange(len(found.ids_a)) + (found.cut_b - own_b + 1)[group_a]] = 3 * found.ids_a + ends_a
        codes[np.arange(len(found.ids_b)) + (found.cut_a + 1)[group_b]] = 3 * found.ids_b + ends_b
        parts = list(map(self.names.__getitem__, codes.tolist()))
        borders = (found.first_a + found.first_b).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip(borders, borders[1:])]


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two tokenizer files, loaded once a Python worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def _cut(items: Iterator[tuple[object, str | None]], limit: int) -> Iterator[list[tuple[object, str | None]]]:
    """Runs of items of about ``limit`` characters."""
    held, size = [], 0
    for item in items:
        if held and size + len(item[1] or "") > limit:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[1] or "") + 1
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _lists(values: np.ndarray, borders: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, ids_a, ids_b, link_a, link_b, cut_a, cut_b`` of every whole text.

    ``ids_a`` and ``ids_b`` are the tokens of a space and the text. Links and cuts are positions in them, from 0:
    link ``k`` joins tokens ``link_a[k]`` and ``link_b[k]``, whose bytes overlap; group ``k`` ends with tokens
    ``cut_a[k]`` and ``cut_b[k]``. Texts that are null, empty or not given back byte by byte have empty lists. Each
    input row gives one row; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for items in _cut(_rows(batches), AT_ONCE):
            found = own.align([text for _, text in items])
            lists = []
            for values, borders, shift in (
                    (found.ids_a, found.first_a, None), (found.ids_b, found.first_b, None), (found.link_a, found.first_link, found.first_a),
                    (found.link_b, found.first_link, found.first_b), (found.cut_a, found.first_cut, found.first_a), (found.cut_b, found.first_cut, found.first_b)):
                if shift is not None:
                    values = values - np.repeat(shift[:-1], np.diff(borders))
                lists.append(_lists(values.astype(np.int32), borders))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], kind), *lists], ["doc_id", "ids_a", "ids_b", "link_a", "link_b", "cut_a", "cut_b"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select("doc_id", "text")
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    ints = [StructField(c, ArrayType(IntegerType())) for c in ("ids_a", "ids_b", "link_a", "link_b", "cut_a", "cut_b")]
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *ints]))


#: Numbers of a document that need nothing of the rest of the corpus.
OWN = ("n_a", "n_b", "n_groups", "n_links")


def _chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a chunk of documents: the chunk's sorted distinct id pairs (``pairs``) with the number of its
    documents that hold each, and flat lists of what its documents are: ids, own numbers, digests of their groups,
    and for each of their distinct pairs its place in ``pairs`` (``local``) and its links (``times``)."""
    rows = docs.select("doc_id", "text")
    longs, ints = ArrayType(LongType()), ArrayType(IntegerType())
    schema = StructType([
        StructField("chunk", LongType()), StructField("pairs", longs), StructField("holders", ints), StructField("doc_ids", ArrayType(rows.schema["doc_id"].dataType)),
        *[StructField(c, ints) for c in OWN], StructField("digests", ArrayType(StringType())), StructField("distinct", ints), StructField("local", ints), StructField("times", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for items in _cut(_rows(batches), CHUNK):
            parts, digests = {c: [] for c in (*OWN, "distinct", "codes", "times")}, []
            for some in _cut(iter(items), AT_ONCE):
                found, n = own.align([text for _, text in some]), len(some)
                n_links = np.diff(found.first_link)
                whole = len(own.bytes_a) * own.span
                keys, times = np.unique(np.repeat(np.arange(n), n_links) * whole + found.ids_a[found.link_a] * own.span + found.ids_b[found.link_b], return_counts=True)
                for name, x in zip(parts, (np.diff(found.first_a), np.diff(found.first_b), np.diff(found.first_cut), n_links, np.bincount(keys // whole, minlength=n), keys % whole, times)):
                    parts[name].append(x)
                digests.extend(hashlib.sha256(x.encode()).hexdigest() if x else "" for x in own.groups(found))
            flat = {name: np.concatenate(x) for name, x in parts.items()}
            pairs, local, holders = np.unique(flat["codes"], return_inverse=True, return_counts=True)
            row = {
                "chunk": chunk, "pairs": pairs, "holders": holders.astype(np.int32), "doc_ids": [k for k, _ in items], **{c: flat[c].astype(np.int32) for c in OWN},
                "digests": digests, "distinct": flat["distinct"].astype(np.int32), "local": local.astype(np.int32), "times": flat["times"].astype(np.int32)}
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row.values(), arrow)], schema=arrow)
            chunk += 1

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def pair_counts(chunks: DataFrame, span: int) -> DataFrame:
    """``pair, n, best``: the documents that hold each id pair linked, and whether no pair of the same A id has more.

    Chunks have counted their own documents. A window holds the pairs of one A id: no more than B has ids.
    """
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"pair div {span}"))))


def linked_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row for each row of ``docs``.

    An id pair's count is the number of documents that hold it linked; rows that repeat count each. ``n_best`` are
    the links whose count is the highest of their A id, ties included; ``count_sum`` adds the counts of all links;
    ``groups_sha256`` is the digest of the groups as ``a1,a2|b1;a3|b2,b3``. Texts that are null, empty or not given
    back byte by byte by both sides have zeros and ''. A null ``doc_id`` keeps its row; other columns are ignored;
    an empty table gives an empty one. Chunks number their pairs, so a pair goes through the shuffle once a
    chunk, not once a document; pairs that every chunk has are dealt to ``SALT`` copies of the counts.
    """
    chunks = settled(_chunks(docs, path_a, path_b))
    span = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    copies = pair_counts(chunks, span).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    asked = chunks.select("chunk", F.pmod(F.hash("chunk"), F.lit(SALT)).alias("salt"), F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(copies, ["pair", "salt"]).select("chunk", F.struct("at", "n", "best").alias("x"))
    answers = told.groupBy("chunk").agg(F.sort_array(F.collect_list("x")).alias("x")).select("chunk", F.col("x.n").alias("n"), F.col("x.best").alias("best"))
    held = chunks.drop("pairs", "holders").join(answers, "chunk", "left")
    kind = chunks.schema["doc_ids"].dataType.elementType
    schema = StructType([
        StructField("doc_id", kind), *[StructField(c, LongType()) for c in (*OWN, "n_best", "count_sum")], StructField("groups_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].values for c in batch.schema.names if c != "chunk"}
                own = {c: row[c].to_numpy().astype(np.int64) for c in (*OWN, "distinct", "local", "times")}
                doc, size = np.repeat(np.arange(len(row["doc_ids"])), own["distinct"]), len(row["doc_ids"])
                n, best = (np.zeros(0, np.int64) if row[c] is None else row[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "best"))
                sums = np.zeros((2, size), np.int64)
                np.add.at(sums[0], doc, own["times"] * best[own["local"]])
                np.add.at(sums[1], doc, own["times"] * n[own["local"]])
                yield pa.RecordBatch.from_arrays([row["doc_ids"], *[pa.array(own[c]) for c in OWN], *map(pa.array, sums), row["digests"]], schema.fieldNames())

    return held.mapInArrow(run, schema)
