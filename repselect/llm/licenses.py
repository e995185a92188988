"""License scans: Aho-Corasick over whole texts for notice phrases and identifier tags, and a
shunting-yard parser for licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Fixed base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "apache license": "apache",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "isc license": "isc",
    "do whatever you want license": "wtfpl",
}
#: The words of an identifier tag, whose expression follows in the text.
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier\s*:[ \t]*", re.I)
TAIL = re.compile(r"[A-Za-z0-9.+:\-() \t]*")
#: Stems of licence identifiers, as the public list of them has: the part ahead of the first ``-``. Other words
#: are no licences, but for identifiers that a document defines itself.
STEMS = {
    "0bsd", "afl", "agpl", "apache", "artistic", "beerware", "blueoak", "bsd", "bsl", "busl", "cc", "cc0", "cddl", "cecill", "cpl", "ecl", "efl", "elastic", "epl", "eupl", "gfdl", "gpl",
    "hpnd", "ijg", "ipl", "isc", "lgpl", "lppl", "mit", "mpl", "ms", "ncsa", "odbl", "odc", "ofl", "ogl", "openssl", "osl", "pddl", "php", "postgresql", "psf", "python", "qpl", "ruby",
    "sissl", "sleepycat", "sspl", "tcl", "unicode", "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl"}
OWN = ("licenseref-", "documentref-")
#: Stems under which a text may be used without asking, and starts of identifiers of the others that allow it.
PERMISSIVE = {"0bsd", "afl", "apache", "beerware", "blueoak", "bsd", "bsl", "cc0", "ecl", "hpnd", "ijg", "isc", "mit", "ncsa", "odc", "ofl", "openssl", "pddl", "php", "postgresql", "psf", "python", "tcl", "unicode",
              "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl"}
PERMISSIVE_STARTS = ("cc-by-1", "cc-by-2", "cc-by-3", "cc-by-4", "cc-pddc", "ms-pl")
#: What makes an identifier behind ``with`` an exception, and those that lift the licence's conditions.
EXCEPTION = "exception"
LIFTING = ("classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "font-exception-2.0", "autoconf-exception-", "bison-exception-", "linux-syscall-note")

# A-Z lowered; every other ASCII character that is no letter or digit becomes a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
PART = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
RANK = {"or": 1, "and": 2, "with": 3}


def stem(identifier: str) -> str:
    return identifier.partition("-")[0].rstrip("+")


def is_identifier(part: str, exception: bool = False) -> bool:
    """Whether a lower-case word is a licence identifier, or behind ``with`` an exception."""
    if exception:
        return EXCEPTION in part or part in LIFTING or part.startswith(OWN)
    return stem(part) in STEMS or part.startswith(OWN)


def is_permissive(identifier: str) -> bool:
    return stem(identifier) in PERMISSIVE or identifier.startswith(PERMISSIVE_STARTS)


def parse(expression: str) -> list[str] | None:
    """Reverse Polish form of a licence expression by the shunting-yard algorithm; None if malformed.

    ``with`` binds tighter than ``and``, ``and`` tighter than ``or``; operators in either case.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether one is due
    rest = PART.sub("", expression)
    if rest.strip():
        return None
    for part in PART.findall(expression.lower()):
        if part == "(":
            if not operand:
                return None
            waiting.append(part)
        elif part == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif part in RANK:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[part]:
                out.append(waiting.pop())
            waiting.append(part)
            operand = True
        else:
            if not operand:
                return None
            out.append(part)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(polish: list[str]) -> tuple[bool, set[str]]:
    """(whether the expression lets a text be used freely, its licence identifiers)."""
    stack: list[tuple[bool, str]] = []
    licences: set[str] = set()
    exceptions: set[str] = set()
    for part in polish:
        if part not in RANK:
            stack.append((is_permissive(part), part))
            licences.add(part)
            continue
        (right, name), (left, own) = stack.pop(), stack.pop()
        if part == "with":
            exceptions.add(name)
            stack.append((left or name.startswith(LIFTING), own))
        else:
            stack.append((left and right if part == "and" else left or right, ""))
    return stack[0][0], licences - exceptions


def expression_of(tail: str) -> list[str] | None:
    """The parsed expression at the start of what follows a tag: the longest run of parts that parses and
    whose words are all identifiers."""
    parts = PART.findall(TAIL.match(tail)[0])
    whole, depth, operand, before = 0, 0, True, ""  # parts up to the last place where all is closed
    for n, part in enumerate(parts, 1):
        part, before, last = part.lower(), part.lower(), before
        if part not in RANK and part not in "()" and not is_identifier(part.rstrip("."), last == "with"):
            break
        if (part == "(" or part not in RANK and part != ")") != operand or part == ")" and not depth:
            break
        depth += (part == "(") - (part == ")")
        operand = part == "(" or part in RANK
        name = part.rstrip(".")
        if not operand and not depth and name and name not in RANK:
            whole = n
    return parse(" ".join(parts[:whole]).rstrip(".")) if whole else None


def tails(text: str) -> list[str]:
    """What follows each tag, up to the end of the line or the next tag."""
    tags = list(TAG_TEXT.finditer(text))
    stops = [m.start() for m in tags[1:]] + [len(text)]
    return [TAIL.match(text, m.end(), stop)[0] for m, stop in zip(tags, stops)]


def _automaton() -> ahocorasick.Automaton:
    own = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        own.add_word(f" {phrase} ", (phrase, label))
    own.make_automaton()
    return own


def scan(text: str | None, own: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permitted)."""
    words = (text or "").encode().translate(FOLD).split()
    folded = f" {b' '.join(words).decode()} "
    base, labels, places = set(), set(), 0
    n_base, first, last, word, seen, tagged = 0, None, None, 0, 0, False
    for end, (phrase, label) in own.iter(folded):
        start = end - len(phrase) - 1
        if phrase == TAG:
            tagged = True
            continue
        places += 1
        labels.add(label)
        if phrase in BASE:
            if start < seen:
                word, seen = 0, 0
            word += folded.count(" ", seen, start)
            seen = start
            n_base += 1
            base.add(label)
            first = word if first is None else min(first, word)
            last = word if last is None else max(last, word)
    expressions, permitted = [], None
    if tagged:
        for tail in tails(text):
            if polish := expression_of(tail):
                free, ids = evaluate(polish)
                expressions.append(" ".join(polish))
                labels |= ids
                permitted = free if permitted is None else permitted and free
    score = 1.0 if expressions else 1.0 - 0.5 ** places
    return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, permitted)


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permitted"]
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id`` and the columns of ``SCHEMA``.

    ``n_base, first_word, last_word, base_labels`` tell of the base phrases alone; ``labels`` adds those of
    further notices and the identifiers in tagged expressions. ``score`` is 1 if an expression parses, else
    ``1 - 2^-places``. ``permitted``: whether all expressions let the text be used freely, null without one.
    Null and empty texts have no words; malformed expressions give no label. Other columns are ignored.
    """

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        own = _automaton()
        out = pd.DataFrame([scan(x, own) for x in texts], columns=COLUMNS)
        return out.astype({"first_word": "Int64", "last_word": "Int64", "permitted": "boolean"})

    return docs.select("doc_id", run("text").alias("found")).select("doc_id", "found.*")
