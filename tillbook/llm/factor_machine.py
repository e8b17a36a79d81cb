"""Toxicity scores from a factorization machine over hashed terms.

Terms are words and their first letters, so that inflected forms of one stem share a
term. From a bounded sample of labelled rows terms are chosen: those that tell the classes
apart best alone, and those that do so where they meet another, though they may say nothing
alone. A machine is fitted on them that weighs single terms and, through a vector per term,
every pair of terms that meet in a text. Scoring is one pass over all texts.

The model is bounded: at most ``TERMS`` telling terms and ``PAIR_TERMS`` of pairs. Pairs are
looked for among ``PAIR_CANDIDATES`` terms, a quarter of them the most telling, the others
the most frequent; a pair of words rarer than these is not seen unless its words tell alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.plans.worktables import materialize

#: Hash space of terms; terms kept of it; length of a term's vector.
BUCKETS, TERMS, FACTORS = 2**20, 2048, 8
#: Labelled rows that the fit reads at most.
SAMPLE_ROWS = 12_000
#: First bytes of a word that make a term of their own.
STEMS = (4, 5, 6, 7)
#: Texts that a term must occur in to be kept, and the G statistic it must reach.
LEAST_TEXTS, LEAST_G = 3, 15.0
#: Terms whose pairs are counted, terms kept for their pairs, and by how much the G statistic
#: of a pair must exceed those of its terms; with half a million pairs chance gives about 25.
PAIR_CANDIDATES, PAIR_TERMS, LEAST_PAIR_G = 1024, 512, 60.0
STEPS, RATE, RIDGE = 100, 0.1, 1e-3
#: Words whose terms a task remembers.
REMEMBERED = 200_000
HELD_OUT_OF = 5

_MARKS = b".,;:!?\"'()[]{}<>|*#%&$-_/\\"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def terms_of(word: bytes) -> list[int]:
    """Hash buckets of a word and its stems; marks at its ends do not count."""
    word = word.strip(_MARKS)
    parts = [b"=" + word] if word else []
    parts += [word[:n] for n in STEMS if len(word) > n]
    return [xxhash.xxh3_64_intdigest(p) % BUCKETS for p in parts]


class _Remembered(dict):
    """word -> bytes of its terms' numbers, or of their buckets; forgets all when full."""

    def __init__(self, numbers: dict[int, int] | None = None):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        terms = terms_of(word)
        if self.numbers is not None:
            terms = [self.numbers[t] for t in terms if t in self.numbers]
        self[word] = found = array("i", terms).tobytes() if terms else b""
        return found


def term_set(text: str | None, remembered: _Remembered) -> np.ndarray:
    found = b"".join(map(remembered.__getitem__, words_of(text)))
    return np.unique(np.frombuffer(found, np.int32))


@dataclass(frozen=True)
class Machine:
    """``numbers``: bucket of each term that was kept -> its place in the arrays."""

    numbers: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        v = self.vectors[terms]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.bias + float(self.weights[terms].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out() -> F.Column:
    """crc32 of doc_id as text, modulo 5, is 0: such rows never teach."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "UTF-8")) % HELD_OUT_OF == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """A machine fitted on at most about ``sample_rows`` labelled rows, or None.

    Only rows with a label 0 or 1 that are not held out count; a doc_id with several
    labels takes the largest. Without rows of both classes there is nothing to fit.
    """
    usable = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    usable = materialize(usable, "labels")
    share = min(1.0, sample_rows / max(1, usable.count()))
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    sample = usable.filter(dealt < F.lit(int(share * 1_000_000)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # the sample's size is bounded by the parameter, so it may be broadcast
    texts = materialize(texts.join(F.broadcast(sample), "doc_id").select("text", "toxic"), "sample")
    counts = texts.mapInArrow(_count_terms, "term int, toxic int, n long")
    counts = counts.groupBy("term", "toxic").agg(F.sum("n").alias("n")).filter("n > 0").toArrow()
    term, toxic, n = (counts.column(k).to_numpy() for k in range(3))
    of_class = np.zeros((2, BUCKETS + 1))
    np.add.at(of_class, (toxic, term), n)
    rows = of_class[:, BUCKETS]
    if not rows.all():
        return None
    of_class = of_class[:, :BUCKETS]
    said = telling(of_class, rows)
    chosen = choose(of_class, said)
    candidates = pair_candidates(of_class, said, rows)
    partners = choose_pairs(candidates, *_numbered(texts, _by_bucket(candidates)))
    numbers = _by_bucket(chosen | partners)
    return train(numbers, *_numbered(texts, numbers))


def _by_bucket(terms: set[int]) -> dict[int, int]:
    return {t: i for i, t in enumerate(sorted(terms))}


def _numbered(texts: DataFrame, numbers: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sample: the numbers of the terms in all texts, how many a text has, and its label."""
    known = texts.sparkSession.sparkContext.broadcast(numbers)
    fed = texts.mapInArrow(_number_terms(known), "toxic int, terms array<int>").toArrow()
    terms = fed.column(1).combine_chunks()
    ends = terms.offsets.to_numpy()
    found = terms.values.to_numpy()[ends[0] : ends[-1]]
    return found, np.diff(ends), fed.column(0).to_numpy().astype(float)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a term; the term BUCKETS counts the texts."""
    count = np.zeros((2, BUCKETS + 1), np.int64)
    remembered = _Remembered()
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            count[toxic, term_set(text.as_py(), remembered)] += 1
            count[toxic, BUCKETS] += 1
    toxic, term = np.nonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(term, pa.int32()), pa.array(toxic, pa.int32()), pa.array(count[toxic, term])],
        names=["term", "toxic", "n"],
    )


def telling(of_class: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The G statistic of each term's presence: how much it says about the class."""
    total = rows.sum()
    seen = of_class.sum(axis=0)
    said = np.zeros(of_class.shape[1])
    for c in (0, 1):
        for there, all_there in ((of_class[c], seen), (rows[c] - of_class[c], total - seen)):
            with np.errstate(divide="ignore", invalid="ignore"):
                part = there / total * np.log(there * total / (all_there * rows[c]))
            said += np.where(there > 0, part, 0)
    return np.where(seen < LEAST_TEXTS, 0, 2 * total * said)


def choose(of_class: np.ndarray, said: np.ndarray) -> set[int]:
    """Terms that say most alone."""
    best = np.argsort(-np.where(said < LEAST_G, 0, said), kind="stable")[:TERMS]
    return {int(t) for t in best if said[t] >= LEAST_G}


def pair_candidates(of_class: np.ndarray, said: np.ndarray, rows: np.ndarray) -> set[int]:
    """The most telling terms, and the most frequent ones that some texts lack."""
    seen = of_class.sum(axis=0)
    best = [int(t) for t in np.argsort(-said, kind="stable")[: PAIR_CANDIDATES // 4] if said[t] >= LEAST_G]
    common = np.where((seen >= LEAST_TEXTS) & (seen <= 0.95 * rows.sum()), seen, 0)
    common[best] = 0
    most = np.argsort(-common, kind="stable")[: PAIR_CANDIDATES - len(best)]
    return {*best, *(int(t) for t in most if common[t])}


def choose_pairs(
    candidates: set[int], terms: np.ndarray, lengths: np.ndarray, y: np.ndarray
) -> set[int]:
    """Terms of the pairs whose meeting says more than either of them, best pairs first."""
    names = sorted(candidates)
    there = np.zeros((len(y), len(names)), np.float32)
    there[np.repeat(np.arange(len(y)), lengths), terms] = 1
    together = np.stack([there[y == c].T @ there[y == c] for c in (0, 1)]).astype(float)
    rows = np.array([(y == 0).sum(), (y == 1).sum()], float)
    said = telling(together.reshape(2, -1), rows).reshape(together.shape[1:])
    alone = np.diag(said)
    gain = np.triu(said - np.maximum.outer(alone, alone), 1)
    left, right = np.nonzero(gain >= LEAST_PAIR_G)
    found: set[int] = set()
    for k in np.argsort(-gain[left, right], kind="stable"):
        if len(found) >= PAIR_TERMS:
            break
        found |= {names[left[k]], names[right[k]]}
    return found


def _number_terms(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Remembered(known.value)
        for batch in batches:
            found = [term_set(t.as_py(), remembered) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "terms"]
            )

    return run


def train(numbers: dict[int, int], terms: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> Machine:
    """Logistic loss by Adam on all rows at once; the classes weigh the same in total."""
    n_terms = len(numbers)
    rng = np.random.default_rng(7)
    w, v, bias = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, FACTORS)), 0.0
    row = np.repeat(np.arange(len(y)), lengths)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    order = np.argsort(terms, kind="stable")
    starts = np.searchsorted(terms[order], np.arange(n_terms))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v, np.zeros(1))]

    def per_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), *x.shape[1:]))
        full = np.flatnonzero(lengths)
        if len(full):
            out[full] = np.add.reduceat(x, np.cumsum(lengths)[full] - lengths[full], axis=0)
        return out

    def per_term(x: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(x[order], np.minimum(starts, max(0, len(terms) - 1)), axis=0)
        out[np.bincount(terms, minlength=n_terms) == 0] = 0
        return out

    for step in range(1, STEPS + 1 if len(terms) else 1):
        at = v[terms]
        total = per_row(at)
        z = bias + per_row(w[terms]) + 0.5 * (total**2 - per_row(at**2)).sum(axis=1)
        miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        grads = (
            per_term(miss[row]) + RIDGE * w / n_terms,
            per_term(miss[row, None] * (total[row] - at)) + RIDGE * v / n_terms,
            np.array([miss.sum()]),
        )
        moves = []
        for (first, second), g in zip(moments, grads, strict=True):
            first += 0.1 * (g - first)
            second += 0.01 * (g**2 - second)
            moves.append(
                RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            )
        w, v, bias = w - moves[0], v - moves[1], bias - float(moves[2][0])
    return Machine(numbers, bias, w, v)


def without_toxic(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns; see ``score``."""
    known = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = known.value
        remembered = _Remembered(machine.numbers) if machine else None
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            clean = [not machine or machine.score(term_set(t.as_py(), remembered)) < 0.5 for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    A null or empty text has no terms and gets the score of the machine's bias. Without a
    machine (no labels of both classes) every score is 0. Rows that repeat repeat; an
    empty table gives no rows. Columns other than doc_id and text are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = known.value
        remembered = _Remembered(machine.numbers) if machine else None
        for batch in batches:
            scores = [
                machine.score(term_set(t.as_py(), remembered)) if machine else 0.0
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
