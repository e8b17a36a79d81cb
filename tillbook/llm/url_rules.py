"""URL filters: explicit host rules first, rules mined from labelled URLs for the rest.

A URL is a set of tokens: scheme, labels of the host and the words in them, segments of the
path, its extension, keys of the query. Over labelled URLs, each with a token that says
whether it was unwanted, FP-growth finds frequent combinations; its association rules that
conclude "unwanted" with enough confidence and rows are kept, and a rule that says no more
than one with fewer tokens goes. An inverted index lists every rule under its rarest token.
A URL looks up its tokens there and fits a rule if it has all of the rule's tokens.

Only DataFrame functions and Spark's FP-growth are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import located
from tillbook.plans.worktables import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The token of an unwanted labelled URL. Tokens of URLs begin with a letter and a colon.
UNWANTED = "unwanted"

#: A mined rule concludes "unwanted" for this share of its labelled URLs at least, ...
CONFIDENCE = 0.6
#: ... for this share of all labelled URLs, ...
SUPPORT = 0.001
#: ... and for this number of them.
LEAST_ROWS = 20

MINED = "rule array<string>, confidence double, rows long"


class HostRule(NamedTuple):
    verdict: str
    """allow or block."""
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_rule(verdict: str, place: str) -> HostRule:
    """``place`` is a host and a path: ``example.net/en/``."""
    if verdict not in ("allow", "block"):
        raise ValueError(f"neither allow nor block: {verdict}")
    host, slash, rest = place.partition("/")
    return HostRule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + rest)


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """Lower-case text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, an empty array for a null one or one without ``://``.

    ``s:`` scheme, ``h:`` labels of the host, ``w:`` their words where a hyphen parts them,
    ``p:`` segments of the path with runs of digits as 0, ``x:`` the extension, ``q:`` keys
    of the query.
    """
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "[&;]"), lambda x: F.substring_index(x, "=", 1))
    extension = F.regexp_extract(path, r"(?s)\.([^./]+)$", 1)
    body = F.regexp_replace(path, r"(?s)\.[^./]+$", "")
    segments = F.split(F.regexp_replace(body, "[0-9]+", "0"), "/")

    def named(kind: str, found: Column) -> Column:
        some = F.filter(found, lambda x: x != "")
        return F.transform(some, lambda x: F.concat(F.lit(f"{kind}:"), lowered(x)))

    found = F.concat(
        named("s", F.array(F.substring_index(url, "://", 1))),
        named("h", labels),
        named("w", words),
        named("p", segments),
        named("x", F.array(extension)),
        named("q", keys),
    )
    empty = F.array().cast("array<string>")
    return F.when(url.contains("://"), F.array_distinct(found)).otherwise(empty)


def mine(
    labelled: DataFrame,
    confidence: float = CONFIDENCE,
    support: float = SUPPORT,
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """Rules (rule, confidence, rows) from ``labelled`` (url, unwanted); rows are the unwanted.

    ``unwanted`` is true or 1, false or 0; rows where it is null say nothing. Each row
    counts, repeated URLs too. A URL without tokens counts as a row that fits no rule.
    A rule stays only if no part of its tokens is a rule of the same or higher confidence.
    Without labelled rows, or without unwanted ones, there are no rules.
    """
    spark = labelled.sparkSession
    unwanted = F.col("unwanted").cast("boolean")
    marked = labelled.filter(unwanted.isNotNull()).select(
        F.concat(
            tokens_of(F.col("url")), F.when(unwanted, F.array(F.lit(UNWANTED))).otherwise(F.array())
        ).alias("items")
    )
    marked = materialize(marked, "labelled-urls")
    rows = marked.count()
    bad = marked.filter(F.array_contains("items", UNWANTED)).count()
    least = max(least_rows, support * rows)
    if bad < least:
        return spark.createDataFrame([], MINED)
    # half a row less: the share is a double and must not lose a rule at the bound
    miner = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows, minConfidence=confidence)
    model = miner.fit(marked)
    found = model.associationRules.filter(F.element_at("consequent", 1) == UNWANTED).select(
        F.array_sort("antecedent").alias("rule"),
        "confidence",
        F.round(F.col("support") * rows).cast("long").alias("rows"),
    )
    return _pruned(materialize(found.filter(F.col("rows") >= least), "mined-rules"))


def _pruned(rules: DataFrame) -> DataFrame:
    """``rules`` without those that a rule of fewer tokens makes needless."""
    every = rules.select(F.col("rule").alias("wide"), F.col("confidence").alias("of_wide"))
    needless = (
        every.withColumn("token", F.explode("wide"))
        .join(index(rules), "token")
        .filter(
            (F.size("rule") < F.size("wide"))
            & (F.col("confidence") >= F.col("of_wide"))
            & (F.size(F.array_except("rule", "wide")) == 0)
        )
    )
    wide = needless.select(F.col("wide").alias("rule")).distinct()
    return materialize(rules.join(wide, "rule", "left_anti").select("rule", "confidence", "rows"), "rules")


def index(rules: DataFrame) -> DataFrame:
    """``rules`` with the ``token`` they are listed under: the one that fewest rules hold."""
    tokens = rules.withColumn("token", F.explode("rule"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held"))
    rarest = (
        tokens.join(held, "token")
        .groupBy("rule")
        .agg(F.min(F.struct("held", "token"))["token"].alias("token"))
    )
    return rules.join(rarest, "rule")


def judge(urls: DataFrame, listed: Sequence[HostRule], mined: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence), one row a row of ``urls``.

    A listed rule fits its host and all its subdomains if the URL's path starts with the
    rule's; the longest wins, then the one of the longer host, then block. ``rule`` is its
    text, else null. Where none fits, a mined rule blocks, and all other URLs are allowed;
    ``mined_rule`` is the fitting one of the highest confidence, then of most rows, then the
    first in order. Listed rules are few and become an expression, mined ones are joined.
    A null URL, or one without ``://``, has an empty host and path, fits nothing and is
    allowed. Null and repeated page ids are kept as rows of their own; other columns of
    ``urls`` are not read. An empty table gives no rows.
    """
    urls, place = located(urls.select("page_id", "url"))
    url = F.col("url").cast("string")
    rows = urls.select(
        "page_id", place.alias("place"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url")
    )
    host, path = F.col("host"), F.col("path")

    def fits(rule: HostRule) -> Column:
        at = (host == rule.host) | host.endswith("." + rule.host)
        return at & path.startswith(rule.path) & (host != "")

    best_first = sorted(set(listed), key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(best_first):
        rule = F.when(fits(r), r.text).otherwise(rule)
        verdict = F.when(fits(r), r.verdict).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)

    open_rows = rows.filter("verdict is null").select("place", tokens_of(F.col("url")).alias("tokens"))
    fitting = (
        open_rows.withColumn("token", F.explode("tokens"))
        .join(index(mined), "token")
        .filter(F.size(F.array_except("rule", "tokens")) == 0)
        .groupBy("place")
        .agg(F.min(F.struct(-F.col("confidence"), -F.col("rows"), F.col("rule")))["rule"].alias("mined_rule"),
             F.max("confidence").alias("confidence"))
    )
    blocked = F.col("mined_rule").isNotNull()
    return rows.join(fitting, "place", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        "mined_rule",
        "confidence",
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, unwanted) of pages that ``labels`` (doc_id, quality, toxic) covers by page_id.

    Unwanted is what is toxic or of low quality. Rows whose label is null are left out.
    """
    unwanted = (labels["toxic"] == 1) | (labels["quality"] == 0)
    marks = labels.select(labels["doc_id"].alias("page_id"), unwanted.alias("unwanted"))
    return pages.select("page_id", "url").join(marks, "page_id").filter("unwanted is not null").select("url", "unwanted")
