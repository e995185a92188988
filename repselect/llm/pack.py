"""Packing documents into training sequences by the sum-of-squares rule.

Windows of ``width`` tokens are filled online. A level array counts the open windows at each fill; a document goes
where the sum of the squared counts grows least, which keeps windows of all fills at hand, so that most documents
find one that they fill up. Whole windows of a long document stand by themselves; only its rest is placed. What is
open at the end is swept: pieces of the emptiest windows are cut to fill the fullest, and the last window is cut
into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from repselect.llm.bpe import runs

#: Words that a Python worker remembers before the older half goes; longer words are never remembered.
REMEMBERED, LONGEST = 350_000, 64

#: Open windows that a task holds, with their ids, before it sweeps them (16 MB at 2048 tokens each).
OPEN = 2048
#: Bytes of ids that go back to Spark at once, and characters encoded at once.
OUT, AT_ONCE = 1 << 23, 1 << 20
#: What stands between words that are encoded together: a character that is a word by itself.
MARK = "\0"
#: Letters from here on may combine with the one before, so that case and composition don't commute.
BEYOND = re.compile("[\u0300-\U0010ffff]")
#: What the tokenizer cuts off behind a letter or digit.
SIGNS = string.punctuation.encode()


class Words(dict):
    """Ids of known words; a word that is asked for and not known is noted and gives None. What has not been asked
    for during ``REMEMBERED`` words is forgotten."""

    def __init__(self):
        self.former: dict[bytes, bytes] = {}
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes | None:
        found = self.former.get(word)
        if found is None:
            self.fresh.append(word)
        else:
            self[word] = found
        return found

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.former = dict(self)
            self.clear()


class WordTokenizer:
    """Ids of a tokenizer file whose tokens never reach across ASCII white space: it drops white space, and its
    normalizer looks at no neighbour behind it. Each distinct word is encoded once.

    Words of letters below U+0300 go through the library many at once, with a mark between them, in small letters and
    without its normalizer, whose composition leaves them as they are; others pass through the whole of it one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.shown = [s.lower().encode() for s in self.special]
        self.plain = tokenizers.Tokenizer(self.whole.model)  # Python's lower() is quicker than the library's normalizer
        self.plain.pre_tokenizer = self.whole.pre_tokenizer
        self.mark = self.whole.encode(MARK, add_special_tokens=False).ids
        if len(self.mark) != 1 or self.whole.encode(f"A {MARK} b", add_special_tokens=False).ids[-2] != self.mark[0]:
            raise ValueError("a tokenizer of another kind")
        self.words = Words()

    def border(self, word: bytes) -> int:
        """Where the signs at the end of a word start, if a letter or digit stands before them, else 0."""
        at = len(word.rstrip(SIGNS))
        if not 0 < at < len(word) <= LONGEST:
            return 0
        last = word[:at].decode()[-1]
        return at if last < "\u0300" and last.isalnum() and not any(s in word.lower() for s in self.shown) else 0

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words into ``words``; those that end in signs are put together from two parts."""
        own, plain, cut = self.words, {}, []
        for word in words:
            at = self.border(word)
            if at:
                cut.append((word, word[:at], word[at:]))
                plain.update((part, None) for part in cut[-1][1:] if own[part] is None)
            else:
                plain[word] = None
        self.encode_new(list(plain))
        own.update((word, own[stem] + own[signs]) for word, stem, signs in cut)

    def encode_new(self, words: list[bytes]) -> None:
        many, single = [], []
        for word in words:
            text = word.decode()
            (many if text.isascii() or not BEYOND.search(text) else single).append(text)
        for at in range(0, len(many), 2048):
            some = many[at:at + 2048]
            joined = f" {MARK} ".join(some).lower()
            if joined.count(MARK) >= len(some) or any(s.lower() in joined for s in self.special):
                single.extend(some)
                continue
            ids = np.array(self.plain.encode_batch_fast([f"{joined} {MARK}"], add_special_tokens=False)[0].ids, "<u4")
            raw, stops = ids.tobytes(), (np.flatnonzero(ids == self.mark[0]) * 4).tolist()
            self.words.update(zip((w.encode() for w in some), (raw[a:b] for a, b in zip([0, *(x + 4 for x in stops)], stops))))
        for at in range(0, len(single), 4096):
            some = single[at:at + 4096]
            for word, found in zip(some, self.whole.encode_batch_fast(some, add_special_tokens=False)):
                self.words[word.encode()] = np.array(found.ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        self.words.age()
        get, fresh, found, again = self.words.__getitem__, self.words.fresh, [], []
        for text in texts:
            raw = (text or "").encode()
            if raw.isascii() or not BEYOND.search(text):  # small letters of A to Z are the same word to the tokenizer
                small = raw.lower()
                if not any(s in small for s in self.shown):  # special tokens are told by their case
                    raw = small
            words, known = raw.split(), len(fresh)
            found.append(list(map(get, words)))
            if len(fresh) > known:
                again.append((found[-1], words))
        if again:
            new = list(dict.fromkeys(fresh))
            self.learn(new)
            fresh.clear()
            for ids, words in again:
                for k, x in enumerate(ids):
                    if x is None:
                        ids[k] = get(words[k])
            for word in new:
                if len(word) > LONGEST:
                    del self.words[word]
        return list(map(b"".join, found))

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of ``path``, loaded once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


#: A piece of a document: its number, the tokens ahead of it in the document, its ids, tokens of the document.
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Online sum-of-squares packing of one stream of documents. ``done`` gathers the closed sequences."""

    def __init__(self, width: int, limit: int = OPEN):
        self.width, self.limit = width, limit
        self.levels = np.zeros(width + 1, np.int64)  # open windows by fill; none counts as full or empty
        self.windows: list[list[list[Piece]]] = [[] for _ in range(width)]
        self.held = 0
        self.done: list[list[Piece]] = []

    def level_for(self, size: int) -> int:
        """The fill to which ``size`` tokens are added: leaving a level of n windows saves 2n - 1 squares, and
        joining one costs 2n + 1; a full window and a fresh one count nothing. Of equal costs the fullest window."""
        cost = 2 * self.levels[size:] + 1
        cost[-1] = 0
        cost[1:] -= 2 * self.levels[1:self.width - size + 1] - 1
        usable = self.levels[:self.width - size + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def add(self, doc: object, ids: np.ndarray) -> None:
        """Places one document."""
        n, width = len(ids), self.width
        whole = n - n % width
        self.done.extend([(doc, at, ids[at:at + width], n)] for at in range(0, whole, width))
        rest = n - whole
        if not rest:
            return
        level = self.level_for(rest)
        window = self.windows[level].pop() if level else []
        self.levels[level] -= level > 0
        window.append((doc, whole, ids[whole:], n))
        if level + rest == width:
            self.done.append(window)
            self.held -= level > 0
        else:
            self.windows[level + rest].append(window)
            self.levels[level + rest] += 1
            self.held += level == 0
            if self.held > self.limit:
                self.sweep()

    def sweep(self) -> None:
        """Fills the fullest windows with pieces of the emptiest; at most one window stays open."""
        queue = [(fill, window) for fill in range(self.width - 1, 0, -1) for window in self.windows[fill]]
        for windows in self.windows:
            windows.clear()
        self.levels[:] = 0
        self.held = 0
        front, back = 0, len(queue) - 1
        while front < back:
            fill, window = queue[front]
            left, source = queue[back]
            while fill < self.width and source:
                doc, start, ids, n = source.pop()
                take = min(self.width - fill, len(ids))
                window.append((doc, start, ids[:take], n))
                if take < len(ids):
                    source.append((doc, start + take, ids[take:], n))
                fill, left = fill + take, left - take
            queue[front], queue[back] = (fill, window), (left, source)
            if not source:
                back -= 1
            if fill == self.width:
                self.done.append(window)
                front += 1
        if front == back and queue[front][0]:
            fill, window = queue[front]
            self.windows[fill].append(window)
            self.levels[fill] += 1
            self.held = 1

    def finish(self) -> None:
        """Sweeps and cuts the last window into powers of two, the largest first."""
        self.sweep()
        for fill in np.flatnonzero(self.levels).tolist():
            pieces = self.windows[fill].pop()[::-1]
            self.levels[fill] -= 1
            self.held -= 1
            for bit in range(fill.bit_length() - 1, -1, -1):
                want, sequence = fill & 1 << bit, []
                while want:
                    doc, start, ids, n = pieces.pop()
                    sequence.append((doc, start, ids[:want], n))
                    if want < len(ids):
                        pieces.append((doc, start + want, ids[want:], n))
                    want -= min(want, len(ids))
                if sequence:
                    self.done.append(sequence)


def pack(docs: DataFrame, path: str, width: int = 2048, end: int = 1) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: one row for each piece of a document.

    A document's ids are those of its whole text and ``end``; a null or empty text has ``end`` alone, and a row that
    repeats is packed again. ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers, ``start``
    counts the document's ids before it, ``offset`` the sequence's. Every sequence has ``width`` tokens but the
    last ones of each task, whose lengths are powers of two, so no token of padding is needed; at most one window a
    task is cut in this way. A null ``doc_id`` is kept; other columns are ignored; an empty table gives an
    empty one.

    Each task packs its own partition in one pass and holds the ids of ``OPEN`` windows at most, beside one
    Arrow batch. Sequence numbers hold the partition's, so they hang on the order of the input rows: give a table
    or ``settled`` rows if results must be equal after a task is run again.
    """
    rows = docs.select("doc_id", "text")
    schema = StructType([
        rows.schema["doc_id"], StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()), StructField("doc_tokens", LongType()),
        StructField("sequence_id", LongType()), StructField("offset", LongType())])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, sequence = word_tokenizer(path), Packer(width), TaskContext.get().partitionId() << 40

        def out() -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in arrow]
            for window in packer.done:
                offset = 0
                for doc, start, ids, n in window:
                    for column, x in zip(columns, (doc, start, len(ids), ids.tobytes(), n, sequence, offset)):
                        column.append(x)
                    offset += len(ids)
                sequence += 1
            packer.done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            texts, size = batch.column(1).fill_null(""), 0
            for start, stop in runs(pc.utf8_length(texts).to_pylist(), AT_ONCE):
                for doc, ids in zip(batch.column(0).slice(start, stop - start).to_pylist(), own.encode_batch(texts.slice(start, stop - start).to_pylist())):
                    packer.add(doc, np.frombuffer(ids + closing, "<u4"))
                    size += len(ids)
                if size > OUT:
                    yield out()
                    size = 0
            yield out()
        packer.finish()
        yield out()

    return rows.mapInArrow(run, schema)


def pieces(packed: DataFrame) -> DataFrame:
    """``pack``'s rows with ``ids_crc32`` for their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
