"""Importance resampling against a plain computation, and numbering over many parts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import awkward, documents, sentences, with_clashes

from tillbook.llm import arrow_resampling as op
from tillbook.llm.common import numbered


def plain_runs(text, longest):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [
        " ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]


def plain_resample(rows, target, longest, buckets, percent, least):
    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    here = Counter(bucket(r) for _, t in rows for r in plain_runs(t, longest)[1])
    there = Counter(bucket(r) for t in target for r in plain_runs(t, longest)[1])
    s_all, t_all = sum(here.values()), sum(there.values())
    found = []
    for doc_id, text in rows:
        words, runs = plain_runs(text, longest)
        weight = sum(
            math.floor(
                1000
                * math.log((there[b] + 1) * (s_all + buckets) / ((here[b] + 1) * (t_all + buckets)))
            )
            for b in map(bucket, runs)
        )
        key = f"2024:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        found.append([doc_id, words, len(runs), weight, score, None])
    able = sorted(
        (r for r in found if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2])
    )
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, found), key=str)


TEXTS = ["The the. THE-the é x7", "", None, "a", "one two one two one", "É é Ⅷ 日本 a日b", "  .,! "]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs(longest):
    texts = [t or "" for t in TEXTS]
    found = [[] for _ in texts]
    for owner, buckets in op.runs(pa.array(texts), longest, 10_000):
        for o, b in zip(owner.tolist(), buckets.tolist()):
            found[o].append(b)
    for text, have in zip(texts, found):
        assert have == [zlib.crc32(r.encode()) % 10_000 for r in plain_runs(text, longest)[1]]


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (3, 50, 45, 2), (2, 7, 100, 0)])
def test_against_plain(spark, longest, buckets, percent, least, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_BYTES", 700)
    rng = random.Random(longest)
    texts = sentences(3, 60, 30) + TEXTS + [" ".join(rng.choices("abc", k=n)) for n in range(40)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, "other words"), (None, texts[9]), (None, None)]
    target = [*sentences(3, 70, 25)[50:], None, ""]
    found = op.resample(
        documents(spark, *rows),
        spark.createDataFrame([(t,) for t in target], "text string"),
        longest,
        buckets,
        percent,
        least,
    )
    assert sorted(map(tuple, found.collect()), key=str) == plain_resample(
        rows, target, longest, buckets, percent, least
    )


def test_awkward_and_empty_tables(spark):
    docs, target = awkward(spark), documents(spark, (1, "one two"))
    plain = sorted(map(tuple, op.resample(docs, target, least_words=1, percent=50).collect()), key=str)
    clashing = with_clashes(docs).withColumns({"n_words": F.lit(1), "_part": F.lit(2), "bucket": F.lit(3)})
    assert plain == sorted(
        map(tuple, op.resample(clashing, target, least_words=1, percent=50).collect()), key=str
    )
    assert op.resample(docs.limit(0), target).count() == 0
    uniform = op.resample(docs, target.limit(0), least_words=1, percent=100)
    assert uniform.count() == docs.count()
    assert uniform.filter("rank is not null").count() == uniform.filter("n_words > 0").count()
    drawn = op.drawn_documents(clashing, uniform)
    assert drawn.columns == clashing.columns
    assert drawn.filter("text is null").count() == 1  # shares its null id with a drawn row


def test_numbers_go_on_over_parts(spark):
    rows = [("hot", i % 37, i) for i in range(900)] + [(g, 1, 1) for g in "abc"]
    df = spark.createDataFrame(rows, "g string, a long, b long")
    order = [F.col("a").desc(), F.col("b")]
    found = numbered(df, ["g"], order, "nth", rows_per_part=50)
    assert found.select("g", "a", "b").distinct().count() == 903
    hot = [r for r in found.collect() if r.g == "hot"]
    assert [r.nth for r in sorted(hot, key=lambda r: (-r.a, r.b))] == list(range(1, 901))
    some = numbered(df, [], [F.col("g"), *order], "nth", upto=10, rows_per_part=50).collect()
    assert len(some) == 903 and sorted(r.nth for r in some if r.nth) == list(range(1, 11))
