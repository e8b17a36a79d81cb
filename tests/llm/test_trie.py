"""The prefix trie against one built of Python dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tillbook.llm import prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]

    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = (turn is not None, turn or 0, digest(role, text))
            convs.setdefault(conv_id, []).append((key, (role, text)))
    convs = {c: [t for _, t in sorted(turns, key=lambda x: x[0])] for c, turns in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        found, todo = [], [path]
        while todo:
            found.append(todo.pop())
            todo += children.get(found[-1], [])
        return found

    out = []
    for path, m in members.items():
        under = below(path)
        out.append((
            min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children.get(path, [])),
            sum(p not in children for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p),
            hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows):
    df = op.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert tuple(df.columns) == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def conversation(conv_id, texts):
    return [(conv_id, i, "user" if i % 2 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,longest", [(1, 6), (2, 9), (3, 40)])
def test_random_conversations(spark, seed, longest):
    rng, rows = random.Random(seed), []
    stem = [rng.choice("ab") for _ in range(longest)]
    for c in rng.sample(range(-150, 450), 70):
        cut = rng.randrange(longest + 1)
        texts = stem[:cut] + [rng.choice(["a", "bé", "ccc", None, ""]) for _ in range(rng.randrange(4))]
        rows += conversation(c, texts)
    assert found(spark, rows) == plain_trie(rows)


def test_many_blocks_and_ends(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 3)
    stem = [f"t{i}" for i in range(70)]
    rows = []
    for c in range(0, 40):
        rows += conversation(c, stem[: (64, 65, 70, 8, 16)[c % 5]])
    rows += conversation(40, stem[:30] + ["x"] * 20) + conversation(41, stem[:30] + ["x"] * 19 + ["y"])
    assert found(spark, rows) == plain_trie(rows)


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "of no conversation"),
        (7, None, "user", "first"),
        (7, 1, None, None),
        (7, 1, "", ""),
        (7, 2, "user", "long " * 50_000),
        (7, 2, "user", "same number"),
        (8, 0, "a", "bc"),
        (9, 0, "ab", "c"),
        (9, 0, "ab", "c"),
        (300, 0, "user", "hi"),
        (301, 0, "user", "hi"),
    ]
    assert found(spark, rows) == plain_trie(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit("clash") for c in ("id", "pos", "block", "t1", "node", "h", "base", "parent")})
    assert sorted(map(tuple, op.prefix_trie(clashing).collect()), key=str) == plain_trie(rows)


def test_turnless_and_empty(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = conversation(c, ["only", "two"])
    assert plain_trie(rows)[0][:6] == (c, 0, None, 1, 0, 1)
    assert found(spark, rows) == plain_trie(rows)
    assert found(spark, []) == []
