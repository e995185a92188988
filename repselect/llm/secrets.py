"""Secret scans by patterns and character Markov models, with DataFrame functions only.

Two first-order models of characters are counted from labelled tokens: random strings and ordinary
identifiers. A token's log-likelihood ratio over its transitions tells which of the two it resembles.

Only tokens of 20 characters or more, with a letter and a digit, are scored. Of 1000 random tokens not
learnt from of 20, 32, 40 and 64 characters in each of hex, base 32 and letters with digits (either case),
base 64 and mixed case, at least 99.9 % reach the margin with the models of sf0.001, sf0.01 and sf0.1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from repselect.llm.draw import drawn_texts
from repselect.llm.rows import whole_row

#: Fixed patterns of the base kinds, in their order, the group that counts and its least length.
KINDS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
MARKOV = "markov"
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Most texts whose tokens are labelled samples (those of the smallest hash), and the least mean
#: log-likelihood ratio of a transition.
SAMPLE, MARGIN = 4000, 1.0
#: Beyond any offset.
FAR = (1 << 31) - 1
SPANS = "array<struct<start:int,ord:int,stop:int,kind:string,word:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, the value worked out once however often the body names it, in lambdas, too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, combine: Callable[[Column, Column], Column], empty: Column, back: bool = False) -> Column:
    """Running ``combine`` of an array from its front, or from its end if ``back``.

    Each step combines elements twice as far apart as the one before, so an array of n elements takes log n passes
    and nothing is copied element by element.
    """
    doubling = F.array(*[F.lit(1 << k) for k in range(30)])
    step = lambda a, s: F.transform(a, lambda x, i: combine(x, F.coalesce(F.get(a, i + s if back else i - s), empty)))
    return let(values, lambda v: F.aggregate(F.filter(doubling, lambda s: s < F.size(v)), v, step))


def spans_of(text: Column, pattern: str, group: int, least: int, kind: str, order: int) -> Column:
    """``array<struct(start, ord, stop, kind, word)>`` of the matches whose ``group`` has ``least`` characters.

    The pieces between the matches and the matches themselves alternate, so their lengths in code points
    add up to the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    steps = F.filter(F.zip_with(gaps, F.arrays_zip(whole.alias("w"), held.alias("g")), lambda gap, m: F.struct(
        gap.alias("gap"), F.char_length(m["w"]).alias("n"), F.char_length(m["g"]).alias("g"), m["w"].alias("w"))), lambda m: m["w"].isNotNull())
    ends = lambda v: F.zip_with(v, scan(F.transform(v, lambda m: m["gap"] + m["n"]), lambda x, y: x + y, F.lit(0)), lambda m, end: F.struct(m["n"].alias("n"), m["g"].alias("g"), m["w"].alias("w"), end.alias("end")))
    spans = F.transform(F.filter(let(steps, ends), lambda m: m["g"] >= least), lambda m: F.struct(
        (m["end"] - m["n"]).alias("start"), F.lit(order).alias("ord"), m["end"].alias("stop"), F.lit(kind).alias("kind"), m["w"].alias("word")))
    return F.when(F.exists(held, lambda x: F.char_length(x) >= least), spans).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start and then kind as listed."""
    parts = []
    for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        if kind == "hex":  # a maximal run, without stopping at each short one
            pattern = f"(?<![0-9a-f])[0-9a-f]{{{least},}}+"
        if kind == "access":  # likewise: a run of 20 or more is the first in its row of letters
            parts.append(F.when(F.contains(text, F.lit("AKIA")), spans_of(text, pattern, group, least, kind, order)).otherwise(
                F.array().cast(SPANS)))
            continue
        parts.append(spans_of(text, pattern, group, least, kind, order))
    return F.sort_array(F.concat(*parts))


def alphabets(digest: Column) -> dict[str, Column]:
    """Random strings of each alphabet from a hex digest of 64 characters."""
    piece = lambda at, n: F.substring(digest, at, n)
    five_bits = F.concat(*[F.lpad(F.conv(piece(at, 5), 16, 32), 4, "0") for at in range(1, 60, 5)])
    base32 = F.translate(F.upper(five_bits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    lower = F.lower(F.concat(*[F.substring(F.lpad(F.conv(piece(at, 15), 16, 36), 12, "0"), -10, 10) for at in (1, 16, 31, 46)]))
    return {"hex": digest, "upper hex": F.upper(digest), "base 32": base32, "lower": lower, "upper": F.upper(lower), "base 64": F.base64(F.unhex(digest))}


def samples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled tokens ``(token, random)``.

    Ordinary: the words of letters of at most ``sample`` distinct texts, those of the smallest hash. Random:
    the same texts' SHA-256 in hex, base 32 and letters with digits of either case, and in base 64, so that as
    many strings of each alphabet are known.
    """
    drawn = drawn_texts(docs, sample)
    ordinary = drawn.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_-]{5,40}"), F.lit(0))).alias("token"))
    ordinary = ordinary.where(~F.col("token").rlike("[0-9a-f]{16}|[0-9].*[0-9]"))
    digest = F.sha2(F.concat_ws(":", F.lit("secret"), "text"), 256)
    random = drawn.select(F.explode(F.array(*alphabets(digest).values())).alias("token"))
    return ordinary.withColumn("random", F.lit(False)).unionByName(random.withColumn("random", F.lit(True)))


def _states(token: Column) -> Column:
    """Alphabet positions of the characters, 0 for any other and ahead of the first."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, ``STATES`` squared numbers, from ``(token, random)``.

    Transitions are smoothed towards the shares of single characters and those by one, so that characters
    which ordinary tokens seldom hold tell as much from few documents; without samples every ratio is zero.
    The driver receives at most two counts a transition, whatever the number of samples. Null and empty
    tokens are left out.
    """
    walk = labelled.where(F.length("token") > 0).select("random", _states(F.col("token")).alias("s"))
    steps = walk.select("random", F.explode(F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: a * STATES + b)).alias("step"))
    counts = {(r.random, r.step): r.n for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    single = {k: [sum(counts.get((k, a * STATES + b), 0) for a in range(STATES)) + 1 for b in range(STATES)] for k in (True, False)}
    share = {k: [x / sum(own) for x in own] for k, own in single.items()}
    out = []
    for a in range(STATES):
        total = {k: sum(counts.get((k, a * STATES + b), 0) for b in range(STATES)) for k in (True, False)}
        for b in range(STATES):
            p, q = ((counts.get((k, a * STATES + b), 0) + STATES * share[k][b]) / (total[k] + STATES) for k in (True, False))
            out.append(math.log(p / q) if counts else 0.0)
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions: above zero, more like a random string."""
    table = F.array(*map(F.lit, model))
    total = F.aggregate(
        F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)), F.struct(F.lit(0).alias("s"), F.lit(0.0).alias("x")),
        lambda a, c: F.struct(c.alias("s"), (a["x"] + F.get(table, a["s"] * STATES + c)).alias("x")), lambda a: a["x"])
    return total / F.greatest(F.char_length(token), F.lit(1))


def with_spans(docs: DataFrame, keep: list[str], model: list[float], margin: float = MARGIN) -> DataFrame:
    """``keep``, then ``base_spans`` and ``spans``: sorted ``array<struct(start, ord, stop, kind, word)>`` of each
    whole ``text``; columns in ``keep`` must not bear these names.

    Base spans stay as they are; a token with letters and digits whose ratio reaches ``margin`` is added
    unless it overlaps one. Offsets count code points, ends exclusive. Null texts have none. Work grows with a text's
    spans and their logarithm: overlaps are told by the farthest end of the base spans that begin before a token
    and the nearest start of those that follow.
    """
    one = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
    tokens = F.when(F.col("_t").rlike(TOKEN), spans_of(F.col("_t"), TOKEN, 0, 20, MARKOV, len(KINDS))).otherwise(F.array().cast(SPANS))
    two = one.select(*keep, base_spans(F.col("_t")).alias("base_spans"), tokens.alias("_more"))
    base = lambda s: s["ord"] < len(KINDS)
    farthest = lambda v: scan(F.transform(v, lambda s: F.when(base(s), s["stop"]).otherwise(0)), F.greatest, F.lit(0))
    nearest = lambda v: scan(F.transform(v, lambda s: F.when(base(s), s["start"]).otherwise(FAR)), F.least, F.lit(FAR), back=True)
    placed = let(F.sort_array(F.concat("base_spans", "_more")), lambda v: F.zip_with(
        F.zip_with(v, farthest(v), lambda s, x: F.struct(s.alias("s"), x.alias("before"))), nearest(v), lambda p, y: F.struct(p["s"].alias("s"), p["before"].alias("before"), y.alias("after"))))
    odd = lambda s: s["word"].rlike("[0-9]") & s["word"].rlike("[A-Za-z]") & (ratio(s["word"], model) >= margin)
    added = F.transform(F.filter(placed, lambda p: ~base(p["s"]) & (p["before"] <= p["s"]["start"]) & (p["after"] >= p["s"]["stop"]) & odd(p["s"])), lambda p: p["s"])
    spans = F.when(F.size("_more") > 0, F.sort_array(F.concat("base_spans", added))).otherwise(F.col("base_spans"))
    return two.select(*keep, "base_spans", spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_secrets(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: one row for each row of ``docs``.

    Null and empty texts have no span. Without any document the models are even and nothing is added.
    Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    found = with_spans(rows, ["doc_id"], train(samples(rows)), margin)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``<secret>`` and ``n_chars`` counted anew.

    Spans that overlap are replaced together. Texts without secrets, nulls among them, and all other
    columns stay as they are.
    """
    whole = docs.select(whole_row(docs).alias("_row"), "text")
    found = with_spans(whole, ["_row"], train(samples(docs)), margin)
    text = F.col("_row")["text"]
    # a span that begins where all before it have ended starts a new secret
    ends = let(F.col("spans"), lambda v: F.zip_with(v, scan(F.transform(v, lambda s: s["stop"]), F.greatest, F.lit(0)), lambda s, x: F.struct(s["start"].alias("start"), x.alias("end"))))
    behind = let(ends, lambda v: F.transform(v, lambda s, i: F.struct(F.coalesce(F.get(v, i - 1)["end"], F.lit(0)).alias("at"), s["start"].alias("start"), s["end"].alias("end"))))
    piece = lambda chars, at, n: F.array_join(F.slice(chars, at + 1, n), "")
    walk = let(F.struct(behind.alias("b"), F.split(text, "").alias("chars")), lambda v: F.concat(
        F.array_join(F.transform(F.filter(v["b"], lambda s: s["start"] >= s["at"]), lambda s: F.concat(piece(v["chars"], s["at"], s["start"] - s["at"]), F.lit("<secret>"))), ""),
        piece(v["chars"], F.element_at(v["b"], -1)["end"], F.size(v["chars"]))))
    any_span = F.size("spans") > 0
    clean = found.select("_row", any_span.alias("_any"), F.when(any_span, walk).otherwise(text).alias("_clean"))
    new = {"text": F.col("_clean"), "n_chars": F.when(F.col("_any"), F.char_length("_clean").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return clean.select(*[new[c].alias(c) if new.get(c) is not None else F.col("_row")[c].alias(c) for c in docs.columns])
