"""Words that are toxic only together, and what the machine and the packing do exactly."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from samples import documents

from tillbook.llm import bin_packing
from tillbook.llm import factor_machine as op


def meeting_words(n, seed):
    """Toxic where both words come or neither does, so that neither says anything alone."""
    rng = random.Random(seed)
    filler = [f"filler{i}x" for i in range(60)]
    rows = []
    for i in range(n):
        here = [w for w in ("qorvan", "tulmek") if rng.random() < 0.5]
        words = [*here, *rng.choices(filler, k=12)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(len(here) != 1)))
    return rows


def test_fit_finds_words_that_only_tell_together(spark):
    rows = meeting_words(3000, 1)
    docs = documents(spark, *[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = op.score(docs, op.fit(docs, labels)).filter("held_out").collect()
    truth = {i: y for i, _, y in rows}
    assert len(found) > 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.95


def test_pairs_by_count():
    """The statistic of a pair against one counted pair by pair."""
    rng = random.Random(3)
    texts = [sorted(rng.sample(range(9), rng.randrange(6))) for _ in range(300)]
    y = np.array([float({1, 4} <= set(t) or (3 in t and rng.random() < 0.5)) for t in texts])

    def g(holds):
        said = 0.0
        for there, c in itertools.product((True, False), (0, 1)):
            n = sum(h == there and k == c for h, k in zip(holds, y))
            if n:
                said += 2 * n * math.log(n * len(y) / (sum(h == there for h in holds) * (y == c).sum()))
        return said if sum(holds) >= op.LEAST_TEXTS else 0.0

    alone = [g([i in t for t in texts]) for i in range(9)]
    wanted = set()
    for i, j in itertools.combinations(range(9), 2):
        if g([i in t and j in t for t in texts]) - max(alone[i], alone[j]) >= op.LEAST_PAIR_G:
            wanted |= {i + 100, j + 100}
    assert {101, 104} <= wanted
    terms = np.array([t for x in texts for t in x])
    assert op.choose_pairs(set(range(100, 109)), terms, np.array([len(t) for t in texts]), y) == wanted


def test_score_is_a_double_loop_over_pairs():
    rng = np.random.default_rng(2)
    machine = op.Machine({}, 0.3, rng.normal(0, 1, 20), rng.normal(0, 0.5, (20, op.FACTORS)))
    for n in (0, 1, 2, 9, 20):
        terms = rng.choice(20, n, replace=False)
        z = machine.bias + sum(machine.weights[t] for t in terms)
        z += sum(machine.vectors[a] @ machine.vectors[b] for a, b in itertools.combinations(terms, 2))
        assert machine.score(terms) == pytest.approx(1 / (1 + math.exp(-z)))


def test_no_candidates_no_pairs():
    assert op.choose_pairs(set(), np.zeros(0, int), np.zeros(5, int), np.array([0.0, 1, 0, 1, 1])) == set()


@pytest.mark.parametrize("seed", range(6))
def test_fullest_bin_against_all_sets(seed):
    rng = random.Random(seed)
    for _ in range(40):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(1, 40)
        sums = {
            sum(length * n for length, n in zip(counts, taken))
            for taken in itertools.product(*[range(n + 1) for n in counts.values()])
        }
        used = bin_packing.fullest(counts, room)
        assert all(0 < n <= counts[length] for length, n in used.items())
        assert sum(length * n for length, n in used.items()) == max(s for s in sums if s <= room)
