"""Sharding, packing, mixing, vector cells and toxicity scores."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import awkward, documents, sentences, with_clashes

from tillbook.llm import bin_packing, factor_machine, shard_tree, soft_mixing, spherical_cells
from tillbook.llm.encoding import encode_with

TREE = shard_tree.regular_tree(2, 3, 2)


def test_shards(spark):
    rows = shard_tree.shard_documents(documents(spark, *((i, "x" * (i % 9)) for i in range(3000))), TREE).collect()
    slots = {}
    for r in rows:
        assert r.size == r.doc_id % 9 + 16
        assert r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 9))
        assert r.grown_shard in (r.shard, 12)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(12))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(150 < len(s) < 350 for s in slots.values())
    assert 130 < sum(r.grown_shard == 12 for r in rows) < 330


def test_shards_follow_weights_and_move_only_where_they_change(spark):
    light = shard_tree.Node("a", (shard_tree.Node("ar", (shard_tree.Node("s0", shard=0),)),))
    heavy = shard_tree.Node("b", (shard_tree.Node("br", (shard_tree.Node("s1", shard=1, own_weight=3.0),)),))
    more = shard_tree.Node("b", (shard_tree.Node("br", (shard_tree.Node("s1", shard=1, own_weight=5.0),)),))
    keys = spark.range(4000).withColumn("key", F.col("id").cast("string"))
    placed = shard_tree.assign(keys, shard_tree.Node("root", (light, heavy)), F.col("key"), "was")
    placed = shard_tree.assign(placed, shard_tree.Node("root", (light, more)), F.col("key"), "now").collect()
    assert 2850 < sum(r.was == 1 for r in placed) < 3150
    assert all(r.now == 1 for r in placed if r.was == 1)
    assert sum(r.now != r.was for r in placed) > 200


def test_shards_of_awkward_rows(spark):
    rows = shard_tree.shard_documents(with_clashes(awkward(spark)), TREE).collect()
    assert len(rows) == 10
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert len({(r.shard, r.slot) for r in rows}) == 10
    assert shard_tree.shard_documents(documents(spark), TREE).collect() == []


def check_packing(rows, texts, capacity):
    encode = encode_with()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        ids = np.array([*encode(text or ""), 2], "<u4")
        pieces = sorted(of[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.length == capacity for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return len(bins)


def test_packing(spark):
    rng = random.Random(3)
    texts = {i: " ".join(sentences(i, 1, words=rng.randrange(70))) for i in range(400)}
    rows = bin_packing.pack_documents(documents(spark, *texts.items()), capacity=128).collect()
    used = check_packing(rows, texts, 128)
    assert used <= -(-sum(r.length for r in rows) // 128) + 2


def test_packing_of_awkward_rows(spark):
    rows = bin_packing.pack_documents(with_clashes(awkward(spark))).collect()
    assert sum(r.length for r in rows if r.doc_id in (3, 4)) == 2
    assert Counter(r.doc_id for r in rows)[1] == 2
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert bin_packing.pack_documents(documents(spark)).collect() == []


def test_patterns_fill_bins():
    rng = random.Random(1)
    for _ in range(30):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 300)))
        found = bin_packing.patterns(dict(counts), 40)
        used = Counter()
        for lengths, times in found:
            assert sum(x * n for x, n in lengths.items()) <= 40
            for x, n in lengths.items():
                used[x] += n * times
        assert used == counts
    best = bin_packing.fullest({7: 3, 5: 2, 3: 1}, 20)
    assert sum(x * n for x, n in best.items()) == 20


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_mixing_meets_its_targets(spark):
    good, bad = sentences(1, 150), [t.replace("w", "v") for t in sentences(2, 50)]
    docs = documents(spark, *enumerate(good + bad))
    domains = spark.createDataFrame(
        [(i, "high" if i < 150 else "low") for i in range(0, 200, 2)] + [(None, "low"), (1, None)],
        "doc_id long, domain string",
    )
    mixture = soft_mixing.fit(docs, domains, {"high": 0.5, "low": 0.5})
    rows = soft_mixing.rates(mixture).collect()
    assert all(abs(r.p_high + r.p_low - 1) < 1e-5 and r.rate >= 0 for r in rows)
    have = [sum(r.rate * r.tokens * p for r, p in zip(rows, ps, strict=True)) for ps in (
        [r.p_high for r in rows], [r.p_low for r in rows])]
    total = sum(r.tokens for r in rows)
    assert abs(have[0] - total / 2) < 1e-5 * total and abs(have[1] - total / 2) < 1e-5 * total
    assert mixture.pull.miss < 1e-6
    assert np.mean([(r.p_high > 0.5) == (r.doc_id < 150) for r in rows if r.doc_id % 2]) > 0.95
    nearest = brute_rates(mixture, [0.5 * total] * 2, 0.0)
    assert all(abs(r.rate - nearest[r.doc_id]) < 1e-4 for r in rows)


def brute_rates(mixture, aim, least):
    """The rates nearest to 1 that meet ``aim``: every rate by itself, small safe steps."""
    known = mixture.known.collect()
    q, t = np.array([r.p for r in known]), np.array([[r.tokens] for r in known], float)
    gram, pull = (q * t).T @ q, np.zeros(q.shape[1])
    for _ in range(20_000):
        rate = np.maximum(least, 1 - q @ pull)
        pull += np.linalg.solve(gram, (q * t).T @ rate - aim)
    return {r.doc_id: x for r, x in zip(known, rate, strict=True)}


@pytest.mark.parametrize("least, high", [(0.0, 0.97), (0.0, 0.2), (1.0, 0.55), (1.0, 0.9)])
def test_mixing_of_soft_members(spark, least, high):
    rng = np.random.default_rng(3)
    known = spark.createDataFrame(
        [(i, int(rng.integers(1, 400)), [float(x), float(1 - x)]) for i, x in enumerate(rng.beta(0.5, 0.2, 300))],
        "doc_id long, tokens long, p array<double>",
    )
    pull = soft_mixing.fit_rates(known, [high, 1 - high], least)
    rows = known.select("doc_id", "tokens", "p", pull.rate(F.col("p")).alias("rate")).collect()
    out = sum(r.tokens * r.rate for r in rows)
    assert pull.miss < 1e-6 and min(r.rate for r in rows) >= least
    assert abs(sum(r.tokens * r.rate * r.p[0] for r in rows) / out - high) < 1e-6
    if not least:  # with a least rate the total is free, so the nearest of one total differ
        nearest = brute_rates(soft_mixing.Mixture(None, pull, known), np.array([high, 1 - high]) * out, 0.0)
        assert all(abs(r.rate - nearest[r.doc_id]) < 1e-4 for r in rows)


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_mixing_tells_targets_out_of_reach(spark, least):
    known = spark.createDataFrame(
        [(i, 10, [0.6 + i / 1000, 0.4 - i / 1000]) for i in range(100)], "doc_id long, tokens long, p array<double>"
    )
    pull = soft_mixing.fit_rates(known, [0.9, 0.1], least)
    rows = known.select("tokens", pull.rate(F.col("p")).alias("rate")).collect()
    assert pull.miss > 0.05
    assert sum(r.tokens * r.rate for r in rows) <= 1000 * soft_mixing.GROWTH * 1.1


def test_mixing_with_rates_of_one_at_least_keeps_every_row(spark):
    docs = with_clashes(documents(spark, *enumerate(sentences(1, 60))))
    domains = spark.createDataFrame([(i, "high" if i % 3 else "low") for i in range(60)], "doc_id long, domain string")
    mixture = soft_mixing.fit(docs, domains, {"high": 0.3, "low": 0.7}, least=1.0)
    mixed = soft_mixing.mixed(docs, mixture)
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    assert set(counts) == set(range(60)) and max(counts.values()) > 1
    assert counts == {r.doc_id: r.copies for r in soft_mixing.rates(mixture).collect()}


def test_mixing_of_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = soft_mixing.rates(soft_mixing.fit(with_clashes(awkward(spark)), none, {})).collect()
    assert len(rows) == 10 and all(r.rate == 1.0 and r.copies == 1 for r in rows)
    empty = soft_mixing.fit(documents(spark), none, {"high": 1.0})
    assert soft_mixing.rates(empty).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_links(rows, least=0.9):
    fine = {
        i: np.array(v, np.float32).astype(float) for i, v, _ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    ids = sorted(fine)
    near = {i: set() for i, _, _ in rows if i is not None}
    for a in ids:
        for b in ids:
            if a != b and len(fine[a]) == len(fine[b]):
                cosine = fine[a] @ fine[b] / np.sqrt(fine[a] @ fine[a] * (fine[b] @ fine[b]))
                if cosine >= least:
                    near[a].add(b)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen))
    return out


@pytest.mark.parametrize("block", [16, 2048])
def test_vector_cells(spark, monkeypatch, block):
    monkeypatch.setattr(spherical_cells, "VECTORS_PER_CELL", 40)
    monkeypatch.setattr(spherical_cells, "BLOCK_VALUES", 12 * block)
    monkeypatch.setattr(spherical_cells, "PRODUCT_VALUES", 7 * block)
    rng, rows = np.random.default_rng(4), []
    for spread in (0.0, 0.2, 0.35, 0.45, 0.6):
        for _ in range(12):
            center = rng.normal(size=12)
            for _ in range(6):
                rows.append((len(rows), [float(x) for x in center + spread * rng.normal(size=12)], 0))
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 12, 0), (903, [float("nan")] * 12, 0),
             (904, [float("inf")] + [1.0] * 11, 0), (905, [None] + [1.0] * 11, 0),
             (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [-0.0, 1.0], 0), (909, [0.0, 1.0], 0)]
    found = spherical_cells.near_duplicates(with_clashes(vectors(spark, rows)), sample_rows=200).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (5, [1.0, 0.1], 0), (0, [-1.0, 0.0], 0), (0, [-1.0, 5.0], 0)]
    found = spherical_cells.near_duplicates(vectors(spark, rows).withColumn("vec_id", F.col("vec_id").cast("int")))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == [
        (0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 1, 1), (5, 1, 1)
    ]


def test_vectors_null_ids_repeats_and_empty_table(spark):
    rows = [(None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)]
    found = spherical_cells.near_duplicates(vectors(spark, rows)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, True)]
    assert [r.n_links for r in found if r.vec_id == 1] == [2, 2]
    assert spherical_cells.near_duplicates(vectors(spark, [])).collect() == []


def toxic_corpus():
    rng = random.Random(5)
    texts, rows = sentences(11, 900), []
    for i, text in enumerate(texts):
        words, toxic = text.split(), int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randrange(40), "blorg" + rng.choice(["ed", "ing", "ers", "s"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = documents(spark, *((i, t) for i, t, _ in rows))
    labels = labelled(spark, [(i, 1, t) for i, _, t in rows])
    scored = factor_machine.score(docs, factor_machine.fit(docs, labels)).collect()
    truth = {i: t for i, _, t in rows}
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    # held-out labels teach nothing
    turned = labelled(
        spark, [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in rows]
    )
    again = factor_machine.score(docs, factor_machine.fit(docs, turned)).collect()
    assert np.allclose([r.score for r in sorted(scored)], [r.score for r in sorted(again)])
    clean = factor_machine.without_toxic(with_clashes(docs), factor_machine.fit(docs, labels))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored if not r.predicted}


def test_machine_learns_pairs():
    """Two terms that are toxic only together."""
    rng = np.random.default_rng(1)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    terms = [np.flatnonzero([x, y]) for x, y in zip(a, b, strict=True)]
    y = (a == b).astype(float)
    machine = factor_machine.train({0: 0, 1: 1}, np.concatenate(terms), np.array([len(t) for t in terms]), y)
    assert np.mean([(machine.score(t) >= 0.5) == bool(v) for t, v in zip(terms, y, strict=True)]) > 0.95


def test_toxicity_of_awkward_rows_and_without_labels(spark):
    docs = with_clashes(awkward(spark))
    for labels in ([], [(1, 1, 1)], [(1, None, None), (None, 1, 1), (2, 1, 7)]):
        machine = factor_machine.fit(docs, labelled(spark, labels))
        rows = factor_machine.score(docs, machine).collect()
        assert machine is None and len(rows) == 10 and {r.score for r in rows} == {0.0}
    rows = toxic_corpus()
    taught = documents(spark, *((i, t) for i, t, _ in rows))
    machine = factor_machine.fit(taught, labelled(spark, [(i, 1, t) for i, _, t in rows]))
    scored = factor_machine.score(docs, machine).collect()
    assert len({r.score for r in scored if r.doc_id in (3, 4, 5)}) == 1
    assert factor_machine.score(documents(spark), machine).collect() == []
