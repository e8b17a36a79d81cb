"""Host rules by hand; mined rules against an enumeration of all token sets."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tillbook.llm import url_rules as op
from tillbook.llm.queries import HOST_RULES

PAGES = "page_id long, url string"


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), PAGES)


def no_rules(spark):
    return spark.createDataFrame([], op.MINED)


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Net/x?y#z", "a.net", "/x", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://net/x", "net", "/x", "net/", "block"),
        ("http://hornet/x", "hornet", "/x", None, "allow"),
        ("http://b.example.net/en/1", "b.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
        ("http://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://example.com/de", "example.com", "/de", None, "allow"),
        ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        ("http://a.net:80/x", "a.net:80", "/x", None, "allow"),
        ("http://a.net?q=/x", "a.net", "", None, "allow"),
        ("x?u=ftp://a.net/y://z", "a.net", "/y://z", "net/", "block"),
        ("http:///en/", "", "/en/", None, "allow"),
        ("http://É.NET/\nb", "É.net", "/\nb", "net/", "block"),
        ("a.net/x", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_host_rules(spark, url, host, path, rule, verdict):
    row = op.judge(pages(spark, [url]), HOST_RULES, no_rules(spark)).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_the_longest_rule_wins_then_the_longer_host_then_block(spark):
    rules = [op.host_rule(*r) for r in (
        ("allow", "net/abc"), ("block", "a.net/a"), ("allow", "a.net/a"), ("block", "net/")
    )]
    row = op.judge(pages(spark, ["http://a.net/abc"]), rules, no_rules(spark)).first()
    assert (row.rule, row.verdict) == ("a.net/a", "block")
    with pytest.raises(ValueError):
        op.host_rule("maybe", "net/")


def tokens(spark, urls):
    return [
        frozenset(r.t) for r in pages(spark, urls).select("page_id", op.tokens_of(F.col("url")).alias("t")).orderBy("page_id").collect()
    ]


def test_tokens(spark):
    found = tokens(spark, ["HTTPS://m.Casino-Win.example.com/en/40-33/a.b.html?Page=2&ref#q=1", None, "x", "a://"])
    assert found[0] == {
        "s:https", "h:m", "h:casino-win", "h:example", "h:com", "w:casino", "w:win",
        "p:en", "p:0-0", "p:a.b", "x:html", "q:page", "q:ref",
    }
    assert found[1:] == [frozenset(), frozenset(), {"s:a"}]


def random_urls(n, seed):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        word = rng.choice(["casino", "news", "ads", "blog", "shop"])
        url = f"http{rng.choice(['', 's'])}://{word}-{rng.choice('xyz')}.example.com/{rng.choice(['en', 'de'])}/{rng.randrange(99)}"
        chance = 0.9 if word == "casino" or ("ads" in url and "/de/" in url) else 0.1
        rows.append((url, int(rng.random() < chance)))
    return rows + [(None, 1), ("no address", 0), ("http://news-x.example.com/en/1", None)]


def plain_rules(spark, rows, confidence, support, least):
    known = [(t, bad) for t, (_, bad) in zip(tokens(spark, [u for u, _ in rows]), rows) if bad is not None]
    every = {}
    for found, bad in known:
        for n in range(1, len(found) + 1):
            for part in itertools.combinations(sorted(found), n):
                seen = every.setdefault(part, [0, 0])
                seen[0] += 1
                seen[1] += bad
    least = max(least, support * len(known))
    return {p: (b / n, b) for p, (n, b) in every.items() if b >= least and b / n >= confidence}


def test_mined_rules(spark):
    rows = random_urls(400, 5)
    labelled = spark.createDataFrame(rows, "url string, unwanted int")
    expected = plain_rules(spark, rows, 0.6, 0.02, 15)
    needed = {
        p: v for p, v in expected.items()
        if not any(q != p and set(q) < set(p) and expected[q][0] >= v[0] for q in expected)
    }
    mined = op.mine(labelled, 0.6, 0.02, 15)
    assert {tuple(r.rule): (r.confidence, r.rows) for r in mined.collect()} == needed
    assert ("w:casino",) in needed and len(needed) < len(expected)

    urls = [u for u, _ in rows]
    judged = op.judge(pages(spark, urls), [], mined).orderBy("page_id").collect()
    for found, row in zip(tokens(spark, urls), judged):
        fitting = [(-c, -n, p) for p, (c, n) in needed.items() if set(p) <= found]
        assert row.verdict == ("block" if any(set(p) <= found for p in expected) else "allow")
        assert (tuple(row.mined_rule) if row.mined_rule else None) == (min(fitting)[2] if fitting else None)
    listed = [op.host_rule("allow", "com/en/")]
    assert {r.verdict for r in op.judge(pages(spark, urls), listed, mined).filter("rule is not null").collect()} == {"allow"}


def test_nothing_to_learn(spark):
    schema = "url string, unwanted int"
    for rows in ([], [("http://a.b/c", None)], [("http://a.b/c", 0)] * 50, [("http://a.b/c", 1)] * 19):
        assert op.mine(spark.createDataFrame(rows, schema)).count() == 0
    rows = [("http://a.b/c", 1)] * 20
    rule = op.mine(spark.createDataFrame(rows, schema)).collect()
    assert all(len(r.rule) == 1 and (r.confidence, r.rows) == (1.0, 20) for r in rule) and len(rule) == 4


def test_rows_stay_as_they_are(spark):
    rows = [(1, "http://a.net/"), (1, "http://a.net/"), (1, "http://b.org/"), (None, "http://a.net/"), (None, None), (2, "http://a.net/" + "x" * 300_000)]
    df = spark.createDataFrame(rows, PAGES)
    clashing = df.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "token", "tokens", "place", "file", "confidence")})
    mined = spark.createDataFrame([(["h:b"], 0.9, 30)], op.MINED)
    for frame in (df, clashing):
        found = op.judge(frame, HOST_RULES, mined)
        assert sorted([(r.page_id, r.verdict) for r in found.collect()], key=str) == sorted(
            [(1, "block"), (1, "block"), (1, "block"), (None, "block"), (None, "allow"), (2, "block")], key=str
        )
    assert op.judge(df.limit(0), HOST_RULES, mined).count() == 0


def test_labels_of_pages(spark):
    labels = spark.createDataFrame(
        [(0, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, 1), (4, 1, None), (9, 1, 1)], "doc_id long, quality int, toxic int"
    )
    found = op.labelled_pages(pages(spark, ["a", "b", "c", "d", "e", "f"]), labels)
    assert sorted(map(tuple, found.collect())) == [("a", False), ("b", True), ("c", True), ("d", True)]
