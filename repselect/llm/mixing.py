"""Soft-membership mixing of documents to target weights, with DataFrame functions only.

A naive Bayes classifier fitted on the labelled table gives each document posteriors over domains; its features
are shares of characters and the evidence of words that the labels tell apart. Rates
``r >= 0`` of documents, ``x`` tokens long, then fit ``sum_i r_i x_i p_id`` to the target of each domain by
projected gradient descent: every step sums all documents to one number a domain and moves each rate by
the weighted residuals, cut off at zero.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from repselect.llm.rows import whole_row
from repselect.session import settled

#: A domain is a pair of labels: quality and toxic. Default weights: mostly good and civil text.
WEIGHTS = {"1,0": 0.85, "1,1": 0.02, "0,0": 0.12, "0,1": 0.01}
ANCHOR = "1,0"
#: Labels whose telling words are learnt, each for a feature of its own.
TOLD = ["toxic"]
FEATURES = ["length", "symbols", "capitals", "marks", "variety", *[f"told_{x}" for x in TOLD]]
#: Most labelled documents that words are learnt from, those of the smallest hash of their id; most words learnt of
#: a label, and the least deviations by which a word's log odds must differ from even.
LABELLED, WORDS, SURE = 10_000, 1000, 4.0
#: Most steps of the fit, least variance of a feature, most times that a domain's tokens are wanted.
STEPS, SMALLEST_VARIANCE, REPEATS = 60, 1e-3, 4.0
LOG = logging.getLogger(__name__)


def _words(text: Column) -> Column:
    """Distinct words of letters and digits, lower case."""
    return F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"))


def learn_words(labelled: DataFrame, label: str) -> dict[str, float]:
    """Log odds of the words that tell ``label`` 1 from 0, by the documents that hold them.

    ``labelled`` has the text and the label; rows without the label are left out. Half a document is added to each
    count; words within ``SURE`` deviations of even odds are dropped, and of the others the ``WORDS`` surest
    kept, which bounds what the driver receives.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(_words(F.coalesce("text", F.lit(""))).alias("w"), F.col(label).cast("int").alias("y"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        return {}
    counts = rows.select(F.explode("w").alias("word"), "y").where("word <> ''").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = lambda k, of: (F.col(k) + 0.5) / (of - F.col(k) + 0.5)
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (ones - F.col("a") + 0.5) + 1 / (n - ones - F.col("b") + 0.5))
    weight = F.ln(odds("a", ones) / odds("b", n - ones))
    sure = counts.select("word", weight.alias("x"), (F.abs(weight) / spread).alias("z")).where(F.col("z") >= SURE)
    return {r.word: r.x for r in sure.orderBy(F.desc("z"), "word").limit(WORDS).collect()}


def features(docs: DataFrame, keep: list[str], told: dict[str, dict[str, float]]) -> DataFrame:
    """``keep``, ``tokens`` (words, long) and ``FEATURES`` (double) of whole texts; null counts as empty.
    ``told``: the learnt words of each label."""
    t = F.coalesce("text", F.lit(""))
    held = _words(F.col("_t"))
    one = docs.select(*keep, t.alias("_t")).select(*keep, "_t", F.char_length("_t").cast("double").alias("_n"), held.alias("_w"))
    left = lambda letters: F.regexp_count("_t", F.lit(f"[{letters}]")).cast("double")
    share = lambda c: c / F.greatest(F.col("_n"), F.lit(1.0))
    words = F.regexp_count("_t", F.lit("[^ \\t\\n\\x0B\\f\\r]+"))

    def evidence(own: dict[str, float]) -> Column:
        if not own:
            return F.lit(0.0)
        names = F.array(*map(F.lit, own))
        weights = F.create_map(*[F.lit(x) for kv in own.items() for x in kv])
        return F.aggregate(F.array_intersect("_w", names), F.lit(0.0), lambda s, w: s + F.element_at(weights, w))

    return one.select(
        *keep, words.cast("long").alias("tokens"),
        F.ln(F.col("_n") + 1).alias("length"), share(left("#*$%&|<>")).alias("symbols"), share(left("A-Z")).alias("capitals"),
        share(left("!?")).alias("marks"),
        (F.size("_w") / F.greatest(words, F.lit(1))).cast("double").alias("variety"),
        *[evidence(told.get(x, {})).alias(f"told_{x}") for x in TOLD])


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, dict[str, float]]:
    """The telling words of each label in ``TOLD``, from at most ``LABELLED`` labelled documents. Their labels are
    broadcast, of that number at most, so no text is shuffled."""
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *TOLD)
    drawn = known.orderBy(F.xxhash64("doc_id"), *TOLD).limit(LABELLED)
    labelled = settled(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))
    return {x: learn_words(labelled, x) for x in TOLD}


def fit_classifier(labelled: DataFrame) -> list[dict]:
    """One entry a domain: its name, log prior, means and variances of ``FEATURES``.

    The sums are Spark's over all labelled rows; the driver receives one row a domain (two labels of two
    values). Rows without both labels are left out.
    """
    named = labelled.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).withColumn("domain", F.concat_ws(",", "quality", "toxic"))
    rows = named.groupBy("domain").agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.var_pop(f).alias(f"v_{f}") for f in FEATURES]).orderBy("domain").collect()
    total = sum(r.n for r in rows)
    return [{"domain": r.domain, "prior": math.log(r.n / total), "mean": [r[f"m_{f}"] for f in FEATURES], "var": [max(r[f"v_{f}"], SMALLEST_VARIANCE) for f in FEATURES]} for r in rows]


def posteriors(model: list[dict]) -> Column:
    """``array<double>`` over the model's domains."""
    scores = F.array(*[
        reduce(lambda a, b: a + b, [
            F.lit(d["prior"]), *[F.lit(-0.5 * math.log(v)) - (F.col(f) - m) * (F.col(f) - m) / (2 * v) for f, m, v in zip(FEATURES, d["mean"], d["var"])]])
        for d in model])
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _rate(moves: list[list[float]]) -> Column:
    """The rate after the given steps: each takes the product of posteriors and residuals off."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*[F.array(*map(F.lit, c)) for c in moves])
    product = lambda c: F.aggregate(F.zip_with("p", c, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(steps, F.lit(1.0), lambda r, c: F.greatest(F.lit(0.0), r - product(c)))


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], anchor: str = ANCHOR, repeats: float = REPEATS, steps: int = STEPS, tolerance: float = 1e-6):
    """``(moves, targets, totals)`` from ``members(tokens, p)``; ``_rate(moves)`` is the rate of a row.

    Targets stand in the proportion of the weights. The anchor domain keeps its tokens, unless another would
    then be wanted more than ``repeats`` times over: the whole is scaled down until none is. Domains without a
    weight get none; one that is weighted but has no tokens can't be had and is told in the log. Residuals are
    divided by the domain's tokens, which bounds the gradient's slope by one whatever the data. A step is one
    pass with one number a domain to the driver; rates so far are kept every few steps; it ends early within
    ``tolerance`` of all targets. Tokens of each domain (there, wanted, reached) are logged, as a warning if the
    whole was scaled down, a domain is missing or the last step ends beyond ``tolerance``.
    """
    ks = range(len(domains))
    rated = members.select("tokens", *[F.col("p")[k].alias(f"p{k}") for k in ks], F.lit(1.0).alias("r"))
    mass = [x or 0.0 for x in rated.agg(*[F.sum(F.col("tokens") * F.col(f"p{k}")) for k in ks]).first()]
    weight = [weights.get(d, 0.0) for d in domains]
    scale = next((m / w for d, m, w in zip(domains, mass, weight) if d == anchor and w > 0 and m > 0), sum(mass) / (sum(weight) or 1.0))
    held = min([scale, *[repeats * m / w for w, m in zip(weight, mass) if w > 0 and m > 0]])
    targets = [w * held if m > 0 else 0.0 for w, m in zip(weight, mass)]
    missing = [d for d, w, m in zip(domains, weight, mass) if w > 0 and not m > 0] + sorted(set(d for d in weights if weights[d] > 0) - set(domains))
    moves: list[list[float]] = []
    totals = mass
    for step in range(1, steps + 1):
        off = [(s - t) / m if m > 0 else 0.0 for s, t, m in zip(totals, targets, mass)]
        if max(map(abs, off), default=0.0) <= tolerance:
            break
        moves.append(off)
        product = reduce(lambda a, b: a + b, [F.col(f"p{k}") * off[k] for k in ks])
        rated = rated.withColumn("r", F.greatest(F.lit(0.0), F.col("r") - product))
        if step % 8 == 0:
            rated = settled(rated)
        totals = [x or 0.0 for x in rated.agg(*[F.sum(F.col("r") * F.col("tokens") * F.col(f"p{k}")) for k in ks]).first()]
    short = max((abs(s - t) / m for s, t, m in zip(totals, targets, mass) if m > 0), default=0.0)
    for row in zip(domains, mass, targets, totals):
        LOG.info("domain %s: %.0f tokens there, %.0f wanted, %.0f reached", *row)
    if held < scale:
        LOG.warning("the mixture is scaled down to %.2g of the anchor's tokens, so that no domain is repeated more than %g times", held / scale, repeats)
    if missing:
        LOG.warning("no tokens of the weighted domains %s", ", ".join(missing))
    if short > tolerance:
        LOG.warning("after %d steps a domain is off its target by %.2g of its tokens", len(moves), short)
    return moves, targets, totals


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, anchor: str = ANCHOR) -> DataFrame:
    """``doc_id, source, tokens, domain, p, rate, wanted, reached``: one row for each row of ``docs``.

    ``domain`` is the likeliest one, ``wanted`` and ``reached`` its tokens by the targets and by all rates. A
    document labelled more than once is learnt from once a label row. Null texts have no tokens; null ids and
    sources keep their rows. Without labels every rate is 1 and ``domain`` null. Other columns are ignored.
    """
    own = settled(features(docs, ["doc_id", "source"], learn(docs, labels)))
    labelled = own.join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    model = fit_classifier(labelled)
    if not model:
        none = F.lit(None).cast("double")
        return own.select("doc_id", "source", "tokens", F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"), none.alias("wanted"), none.alias("reached"))
    members = settled(own.select("doc_id", "source", "tokens", posteriors(model).alias("p")))
    moves, targets, totals = fit_rates(members, [d["domain"] for d in model], weights or WEIGHTS, anchor)
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    of = lambda values: F.get(F.array(*map(F.lit, values)), best)
    return members.select("doc_id", "source", "tokens", of([d["domain"] for d in model]).alias("domain"), "p", _rate(moves).alias("rate"), of(targets).alias("wanted"), of(totals).alias("reached"))


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies of a rate: the part behind the point is decided by a hash of ``key``."""
    return F.floor(rate + F.pmod(F.xxhash64(*key, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, anchor: str = ANCHOR) -> DataFrame:
    """``docs`` with each row repeated by its rate (none, once or more); columns as they are.

    The rate is worked out from the row itself, so no text is shuffled. Labels are joined by narrow rows. Whole
    copies are decided by id and text, so that rows that repeat an id or have none don't share one fate; rows
    equal in both do.
    """
    told = learn(docs, labels)
    own = settled(features(docs, ["doc_id"], told))
    model = fit_classifier(own.join(labels.select("doc_id", "quality", "toxic"), "doc_id"))
    if not model:
        return docs
    members = settled(own.select("tokens", posteriors(model).alias("p")))
    moves, _, _ = fit_rates(members, [d["domain"] for d in model], weights or WEIGHTS, anchor)
    rows = features(docs.select(whole_row(docs).alias("_row"), "text"), ["_row"], told).withColumn("p", posteriors(model))
    many = F.array_repeat(F.lit(1), copies(_rate(moves), F.col("_row")["doc_id"], F.col("_row")["text"]))
    # outer, so that no filter on the array's size moves down and scores the text twice
    return rows.select("_row", F.explode_outer(many).alias("_c")).where("_c is not null").select("_row.*")
