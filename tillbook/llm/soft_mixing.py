"""Mixing to target weights with soft domain membership.

A classifier of hashed words, fitted on the labelled table, gives every document a
posterior over domains. Nonnegative rates are then fitted by projected gradient on the
squared distance between expected domain tokens, the sum of rate * tokens * posterior,
and their targets. The gradient of a document's rate is its posterior times one vector,
the miss. Steps are summed and their sum is projected, so the rates are a function of the
posterior and one vector, and each step is one aggregation over (tokens, posterior):
nothing of a document's size or number passes through the driver. The Gram matrix of the
documents above the least rate is the metric of a step, which makes them few. Of all
rates that meet the targets these are the nearest to 1.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import text_of
from tillbook.plans.worktables import materialize

#: Hash buckets of words; labelled rows the classifier reads at most.
BUCKETS, SAMPLE_ROWS = 4096, 20_000
#: How far the mean of a text's word weights moves the posterior.
STRENGTH = 10.0
SMOOTHING = 1.0
#: A fit ends when the gradient, in shares of the tokens, is below ``CLOSE``. ``RIDGE`` is the
#: weight of the rates' distance from 1; it bounds the pull of targets that are out of reach.
STEPS, CLOSE, RIDGE = 100, 1e-9, 1e-9
#: Rates of at least more than 0 make tokens more, by this factor at most.
GROWTH = 4.0
RATE_DIGITS = 6


@dataclass(frozen=True)
class Classifier:
    """Log prior of each domain and, per bucket, log of how likely the domain has its words."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    words: tuple[tuple[float, ...], ...] = field(repr=False)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def fit_classifier(docs: DataFrame, domains: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Naive Bayes on at most about ``sample_rows`` rows of ``domains`` (doc_id, domain).

    Null domains and doc_ids do not count; a doc_id with several takes the smallest. The
    domains are few (their names come to the driver). Without labelled rows there is one
    domain, "all".
    """
    rows = domains.filter("doc_id is not null and domain is not null")
    rows = materialize(rows.groupBy("doc_id").agg(F.min("domain").alias("domain")), "domains")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    share = min(1.0, sample_rows / max(1, sum(sizes.values())))
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(share * 1_000_000)
    # the sample is bounded by the parameter
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    words = texts.join(F.broadcast(rows.filter(dealt)), "doc_id").select(
        "domain", F.explode(_words(F.col("text"))).alias("word")
    )
    counts = words.groupBy("domain", _bucket(F.col("word")).alias("bucket")).count().collect()
    names = tuple(sorted(sizes)) or ("all",)
    seen = np.full((len(names), BUCKETS), SMOOTHING)
    for r in counts:
        seen[names.index(r["domain"]), r["bucket"]] += r["count"]
    likely = np.log(seen / seen.sum(axis=1, keepdims=True))
    likely -= likely.mean(axis=0)
    prior = np.log(np.array([sizes.get(n, 1) for n in names], float) / max(1, sum(sizes.values())))
    return Classifier(names, tuple(prior), tuple(tuple(float(x) for x in row) for row in likely))


def _constant(values) -> Column:
    """Nested numbers as one literal."""
    depth = np.ndim(values)
    return F.from_json(F.lit(json.dumps(values)), "array<" * depth + "double" + ">" * depth)


def _summed(places: Column, weights: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda s, b: s + weights[b])


def with_posterior(df: DataFrame, text: str, classifier: Classifier) -> DataFrame:
    """Add ``tokens``, the number of words, and ``p``, probabilities in the order of the
    classifier's domains; without words they are the prior. Steps are columns of their
    own, so that each is computed once.
    """
    n = F.greatest(F.col("tokens"), F.lit(1))
    logs = [
        F.lit(float(prior)) + _summed(F.col("_buckets"), _constant(words)) / n * STRENGTH
        for prior, words in zip(classifier.prior, classifier.words, strict=True)
    ]
    return (
        df.withColumn("_buckets", F.transform(_words(F.col(text)), _bucket))
        .withColumn("tokens", F.size("_buckets").cast("long"))
        .withColumn("_logs", F.array(*logs))
        .withColumn("_most", F.array_max("_logs"))
        .withColumn("_likely", F.transform("_logs", lambda x: F.exp(x - F.col("_most"))))
        .withColumn("_sum", F.aggregate("_likely", F.lit(0.0), lambda s, x: s + x))
        .withColumn("p", F.transform("_likely", lambda x: x / F.col("_sum")))
        .drop("_buckets", "_logs", "_most", "_likely", "_sum")
    )


@dataclass(frozen=True)
class Pull:
    """Rates are 1 less the product of ``by`` and the posterior less ``base``, ``least`` at
    least. ``miss`` is the largest distance from a target, as a share of the tokens."""

    by: tuple[float, ...]
    base: tuple[float, ...]
    least: float
    miss: float = 0.0

    def free_rate(self, p: Column) -> Column:
        moved = [(p[i] - self.base[i]) * y for i, y in enumerate(self.by)]
        return reduce(lambda r, m: r - m, moved, F.lit(1.0))

    def rate(self, p: Column) -> Column:
        return F.greatest(F.lit(self.least), self.free_rate(p))


def _measure(known: DataFrame, pull: Pull, aim: np.ndarray, size: float):
    """At ``pull``: by how much each sum misses its aim, the Gram matrix of the documents
    above the least rate, and the height of the dual objective whose slope is the miss."""
    k = len(pull.by)
    rows = known.select(
        (F.col("tokens") / F.lit(size)).alias("t"),
        *[(F.col("p")[i] - pull.base[i]).alias(f"q{i}") for i in range(k)],
        pull.free_rate(F.col("p")).alias("u"),
    )
    t, u, least = F.col("t"), F.col("u"), F.lit(pull.least)
    q = [F.col(f"q{i}") for i in range(k)]
    free = F.when(u >= least, t).otherwise(0.0)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(t * F.greatest(least, u) * x) for x in q]
    sums += [F.sum(free * q[i] * q[j]) for i, j in pairs]
    sums.append(F.sum(t * F.when(u > least, u * u / 2).otherwise(least * u - least * least / 2)))
    found = np.array(rows.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first(), float)
    gram = np.zeros((k, k))
    for (i, j), value in zip(pairs, found[k:-1], strict=True):
        gram[i, j] = gram[j, i] = value
    y = np.array(pull.by)
    return found[:k] - aim, gram, -found[-1] - aim @ y - RIDGE * (y @ y) / 2


def fit_rates(
    known: DataFrame,
    targets: list[float],
    least: float = 0.0,
    total: float | None = None,
    growth: float = GROWTH,
) -> Pull:
    """Rates from ``known`` (tokens, p) whose expected domain tokens are in the proportions
    of ``targets``.

    ``total`` is the number of tokens aimed at: by default what there is, or with rates of
    at least ``least`` > 0 whatever number lets the rates stay nearest to 1, up to ``growth``
    times what there is. Targets out of reach are met in least squares, and ``miss`` tells
    how far they are.
    """
    k = len(targets)
    size = float(known.agg(F.sum("tokens")).first()[0] or 0)
    weights = np.array(targets, float) / max(sum(targets), 1e-12)
    shares_only = total is None and least > 0
    base = weights if shares_only else np.zeros(k)
    by = np.zeros(k)

    def pulled(y: np.ndarray, miss: float = 0.0) -> Pull:
        return Pull(tuple(map(float, y)), tuple(map(float, base)), float(least), miss)

    if not size:
        return pulled(by)
    aim = np.zeros(k) if shares_only else weights * ((size if total is None else total) / size)
    miss, gram, height = _measure(known, pulled(by), aim, size)
    slope, part = miss - RIDGE * by, 1.0
    for _ in range(STEPS):
        if np.abs(slope).max() <= CLOSE:
            break
        way = np.linalg.solve(gram + RIDGE * np.eye(k), slope)
        tried = _measure(known, pulled(by + part * way), aim, size)
        steep = tried[0] - RIDGE * (by + part * way)
        if tried[2] < height + 1e-4 * part * (slope @ way) and np.abs(steep).max() >= np.abs(slope).max():
            part /= 2  # too far: documents came to the least rate or left it
            continue
        by, part = by + part * way, 1.0
        (miss, gram, height), slope = tried, steep
    found = pulled(by, float(np.abs(miss).max()))
    if shares_only:
        out = known.agg(F.sum(F.col("tokens") * found.rate(F.col("p")))).first()[0]
        if out > growth * size:  # so few documents lack the domains that shrink
            return fit_rates(known, targets, least, growth * size)
    return found


def copies(r: Column, *key: Column) -> Column:
    """How often a row is taken: the rate, rounded up or down by a hash of ``key``."""
    u = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(2**30)) / float(2**30)
    return (F.floor(r) + (u < r - F.floor(r)).cast("long")).cast("int")


@dataclass(frozen=True)
class Mixture:
    classifier: Classifier
    pull: Pull
    known: DataFrame  # doc_id, tokens, p of every row


def fit(
    docs: DataFrame, domains: DataFrame, targets: dict[str, float], least: float = 0.0
) -> Mixture:
    """Fit posteriors and rates. Domains without a target get the weight 0."""
    classifier = fit_classifier(docs, domains)
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    known = materialize(
        with_posterior(texts, "text", classifier).select("doc_id", "tokens", "p"), "posteriors"
    )
    weights = [float(targets.get(d, 0.0)) for d in classifier.domains]
    if not any(weights):
        weights = [1.0] * len(weights)
    return Mixture(classifier, fit_rates(known, weights, least), known)


def rates(mixture: Mixture) -> DataFrame:
    """Per row: doc_id, tokens, p_<domain>, rate, copies.

    A null or empty text has no tokens and the prior as its posterior. Rows that repeat
    repeat and get equal rates; an empty table gives no rows. Without labels the only
    domain is "all". Targets out of reach are met in least squares.
    """
    r = F.round(mixture.pull.rate(F.col("p")), RATE_DIGITS)
    names = mixture.classifier.domains
    rows = mixture.known.withColumn("rate", r)
    return rows.select(
        "doc_id",
        "tokens",
        *[F.round(F.col("p")[i], RATE_DIGITS).alias(f"p_{n}") for i, n in enumerate(names)],
        "rate",
        copies(F.col("rate"), F.col("doc_id")).alias("copies"),
    )


def mixed(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """``docs`` with every row as often as its rate says; all columns stay as they are."""
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_of(docs).alias("text")
    )
    rows = with_posterior(rows, "text", mixture.classifier)
    r = F.round(mixture.pull.rate(F.col("p")), RATE_DIGITS)
    taken = rows.select("row", copies(r, F.col("row.doc_id")).alias("n"))
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")
