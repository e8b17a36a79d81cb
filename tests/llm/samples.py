"""Small tables with the awkward cases: nulls, empties, repeats, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("at", "digest", "row", "p", "tokens", "copies", "rep", "band", "score", "shard", "_key", "n")


def documents(spark, *rows):
    """(doc_id, text) rows with the other columns of documents."""
    full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark):
    """Null and repeated ids and texts, white space alone, one very long text."""
    return documents(
        spark,
        (1, "one two three four five six"),
        (1, "one two three four five six"),
        (2, "one  two three\tfour five six"),
        (3, None),
        (4, ""),
        (5, " \n "),
        (6, "word " * 60_000),
        (None, "one two three four five six"),
        (None, None),
        (7, "Ünï çødé 日本語   <|endoftext|> x"),
    )


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def sentences(seed: int, n: int, words: int = 40) -> list[str]:
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]
