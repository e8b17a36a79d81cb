"""Importance resampling towards a target distribution, by Arrow kernels.

Words come from ``ascii_lower`` and ``split_pattern_regex``, one flat array of them from
``list_flatten``; ``dictionary_encode`` turns it into indices. A run of two words is a pair
of an index and the index shifted by one, a longer run a pair of a shorter run and a word;
pairs are dictionary-encoded in turn, so that CRCs are taken of distinct runs alone. A
document's weight is a segment sum over the gains taken for its runs' buckets.

Two passes over the texts: the first counts buckets (a table of ``buckets`` rows, whatever
the corpus), the second weighs. Ranks are given over range partitions of narrow rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import numbered, text_of
from tillbook.plans.worktables import materialize

LONGEST = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024

#: What lies between words: ASCII that is neither a digit nor a lower-case letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters handled at once, in whole texts.
CHUNK_BYTES = 8_000_000


def runs(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``longest`` words: the text each run is of, and its bucket."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    encoded = pc.dictionary_encode(flat.filter(real))
    owner = owner.filter(real).to_numpy(zero_copy_only=False)
    words, first = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    names, ids = first, words
    for n in range(1, longest + 1):
        if n > 1:
            ids = ids[: max(len(words) - n + 1, 0)]
            within = owner[: len(ids)] == owner[n - 1 :]
            pairs = ids * max(len(first), 1) + words[n - 1 :]
            pairs[~within] = -1
            encoded = pc.dictionary_encode(pa.array(pairs))
            ids, pairs = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary.to_numpy()
            ids = ids.astype(np.int64)
            crossing = pairs < 0
            pairs = np.where(crossing, 0, pairs)
            if len(pairs):
                left, right = names.take(pa.array(pairs // len(first))), first.take(pa.array(pairs % len(first)))
                names = pc.binary_join_element_wise(left, right, " ")
            valid = ~crossing[ids] if len(ids) else np.zeros(0, bool)
        else:
            valid = np.ones(len(ids), bool)
        crc = (zlib.crc32(x) % buckets for x in names.cast(pa.binary()).to_pylist())
        of_name = np.fromiter(crc, np.int64, len(names))
        yield owner[: len(ids)][valid], of_name.take(ids[valid])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut between rows where they hold more than ``CHUNK_BYTES`` of text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, ends[stop - 1]


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): runs of words in all texts by bucket. A task returns a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for chunk in _chunks(batches):
            for _, found in runs(chunk.column("text"), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(text_of(docs).alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Per bucket the thousandfold log of how much likelier it is in the target, rounded down."""
    all_source = float(sum(source.values()) + buckets)
    all_target = float(sum(target.values()) + buckets)
    return [
        math.floor(
            1000
            * math.log(
                (target.get(b, 0) + 1.0) * all_source / ((source.get(b, 0) + 1.0) * all_target)
            )
        )
        for b in range(buckets)
    ]


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel draw in thousandths, rounded down; it follows from the id alone."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    buckets, by_bucket = len(gain), np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            n = chunk.num_rows
            words, features, weight = None, np.zeros(n, np.int64), np.zeros(n, np.int64)
            for owner, found in runs(chunk.column("text"), longest, buckets):
                here = np.bincount(owner, minlength=n)
                words = here if words is None else words
                features += here
                sums = np.concatenate([[0], np.cumsum(by_bucket.take(found))])
                ends = np.cumsum(here)
                weight += sums[ends] - sums[ends - here]
            ids = chunk.column("doc_id")
            drawn = np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (words, features, weight, weight + drawn))],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), a row for each row of ``docs``.

    ``percent`` of the documents with ``least_words`` words or more are drawn without
    replacement: those of the highest scores (weight plus Gumbel noise), ranked from 1;
    ``rank`` is null for the others. A null or empty text has no features, weight 0, and is
    not drawn unless ``least_words`` is 0. Equal scores go by doc_id, nulls last, then by
    n_features; a null doc_id draws its noise as an empty one. Rows of a repeated id count
    one by one and share their noise. Without any target text the target is uniform. An
    empty table gives no rows. Only doc_id and text are read of ``docs``, text of ``target``.
    """
    def counted(texts: DataFrame) -> dict[int, int]:  # ``buckets`` numbers at most
        return {r["bucket"]: r["n"] for r in bucket_counts(texts, longest, buckets).collect()}

    gain = gains(counted(docs), counted(target), buckets)
    scored = materialize(weigh(docs, gain, longest, seed), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    take = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    ranked = numbered(able, [], order, "rank", upto=take)
    others = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others)


def drawn_documents(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose id was drawn; rows of one id go together."""
    drawn = resampled.filter("rank is not null").select("doc_id").distinct()
    same = docs["doc_id"].eqNullSafe(drawn["doc_id"])
    return docs.join(drawn, same, "left_semi")
