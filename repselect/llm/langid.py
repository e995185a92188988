"""Language ID by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: each slot holds a bit a language, and the bitwise and of
an n-gram's slots gives every language that may contain it. A text's n-grams are looked up together; each
language's count of hits, corrected for that filter's false positives, decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from repselect.llm.draw import drawn_texts
from repselect.llm.rows import quoted

#: Most training texts of a language (those of the smallest hash), n-gram length, slots of
#: the filter, slots of an n-gram, and the least share of a language's n-grams that gets one in.
SAMPLE, GRAM, SLOTS, HASHES, SHARE = 2000, 4, 1 << 18, 3, 1e-6


def grams(text: str | None, gram: int = GRAM) -> np.ndarray:
    """Hashes of the letter n-grams of a whole text, lower case, with one blank for all between words."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[np.minimum(codes, len(_letters()) - 1)], codes, 32)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.uint64)
    codes = np.concatenate((codes, np.full(max(0, gram - len(codes)), 32, np.uint64)))
    out = np.zeros(len(codes) - gram + 1, np.uint64)
    for k in range(gram):
        out = out * np.uint64(0x110000) + codes[k:len(codes) - gram + 1 + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.array([chr(c).isalpha() for c in range(0x32400)] + [False]))
    return _TABLE[0]


def places(hashes: np.ndarray, slots: int, k: int) -> np.ndarray:
    """Slot of each hash for its ``k``-th function."""
    return ((hashes >> np.uint64(20 * k % 44)) ^ (hashes * np.uint64(2 * k + 1) >> np.uint64(24))) % np.uint64(slots)


@dataclass
class Filters:
    """Bit ``l % 64`` of ``masks[l // 64, slot]`` is set if an n-gram of ``langs[l]`` falls there; ``false_rate``
    by language."""

    langs: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    hashes: int
    gram: int

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text, self.gram)
        if not len(found) or not self.langs:
            return "und", 0.0
        slots = [places(found, self.masks.shape[1], k) for k in range(self.hashes)]
        hits = np.zeros(len(self.langs))
        for word, row in enumerate(self.masks):
            mask = np.bitwise_and.reduce([row[at] for at in slots])
            for b in range(64 * word, min(64 * word + 64, len(self.langs))):
                hits[b] = np.count_nonzero(mask & np.uint64(1 << b % 64))
        true = np.clip((hits / len(found) - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        best = int(np.argmax(true))
        return self.langs[best], float(true[best])


def train(docs: DataFrame, sample: int = SAMPLE, gram: int = GRAM, slots: int = SLOTS, hashes: int = HASHES, share: float = SHARE) -> Filters:
    """Filters from the ``text`` and non-null ``lang`` of ``docs``.

    The fit takes at most ``sample`` distinct texts of each language, those of the smallest hash, in one pass
    for all languages. The driver receives at most a mask a slot for each 64 languages.
    """
    drawn = drawn_texts(docs.where(F.col("lang").isNotNull()), sample, ("lang",))
    langs = sorted(r.lang for r in docs.where("lang is not null and text is not null").select("lang").distinct().collect())  # their names
    words = max(1, -(-len(langs) // 64))
    if not langs:
        return Filters([], np.zeros((words, slots), np.uint64), np.zeros(0), hashes, gram)
    number = drawn.sparkSession.createDataFrame(list(enumerate(langs)), "b int, lang string")
    drawn = drawn.join(number, "lang").select("b", "text")

    def count(batches):
        for pdf in batches:
            for b, texts in pdf.groupby("b").text:
                hs, n = np.unique(np.concatenate([grams(t, gram) for t in texts]), return_counts=True)
                yield pd.DataFrame({"b": np.full(len(hs), b, np.int32), "h": hs.view(np.int64), "n": n.astype(np.int64)})

    counts = drawn.mapInPandas(count, "b int, h long, n long").groupBy("b", "h").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("b").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "b").where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * share))

    def slot(batches):
        for pdf in batches:
            hs = pdf.h.to_numpy().view(np.uint64)
            for k in range(hashes):
                yield pd.DataFrame({"word": pdf.b // 64, "slot": places(hs, slots, k).astype(np.int64), "mask": np.int64(1) << pdf.b.to_numpy(np.int64) % 64})

    filled = frequent.select("b", "h").mapInPandas(slot, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((words, slots), np.uint64)
    masks[filled.word.to_numpy(np.int64), filled.slot.to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(masks[b // 64] & np.uint64(1 << b % 64)) / slots for b in range(len(langs))])
    return Filters(langs, masks, fill ** hashes, hashes, gram)


def held_out(doc_id: str = "doc_id"):
    """True where the document may not be learnt from; a null id counts as learnable."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Filters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (both replaced if they exist; ``_found`` is left out).

    Only the text is looked at. ``und`` with score 0 if it is null or has no letter, or if nothing was
    learnt. The score is the corrected share of the text's n-grams that the language contains; ties go to
    the language first by name, and so does a text that no language contains, with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of the size fixed by its slots

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = sent.value
        return pd.DataFrame([own.predict(x) for x in texts], columns=["lang_pred", "score"])

    kept = [quoted(c) for c in docs.columns if c not in ("lang_pred", "score", "_found")]
    return docs.select(*kept, run("text").alias("_found")).select(*kept, "_found.lang_pred", "_found.score")
