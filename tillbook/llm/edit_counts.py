"""Token counts that follow edits: a tree of segment sums per document.

A text is cut into segments before single spaces between other characters, where no
pre-token can reach across, so counts of segments add up to the count of the text. A
binary tree holds sums of characters and tokens over the segments. An edit descends to
the segments that it touches, re-encodes those and a neighbour whose border it disturbs,
and updates the sums above; everything else keeps its count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.encoding import RANKS, encode_with

#: Characters after which the next border is taken.
SEGMENT_CHARS = 512

#: A border lies before the space. White space is what Unicode or ASCII calls so.
_BORDER = re.compile(r"\S(?= \S)")

EDITS = "array<struct<at: int, removed: int, inserted: string>>"


def borders(text: str, size: int = SEGMENT_CHARS) -> list[int]:
    """Starts of the segments and the end of the text."""
    found, at = [0], 0
    while len(text) - at > size and (m := _BORDER.search(text, at + size - 1)):
        at = m.end()
        found.append(at)
    return [*found, len(text)]


class SegmentTree:
    """Sums over segments; node 1 is the root, the leaves fill the last level."""

    def __init__(self, text: str, encode, chars: list[int] | None = None, tokens: list[int] | None = None):
        """Cut and count ``text``, or take the kept ``chars`` and ``tokens`` of its segments."""
        self.encode, self.reencoded = encode, 0
        if chars is None:
            cuts = borders(text)
            self.segments = [text[a:b] for a, b in pairwise(cuts)]
            tokens = [len(encode(s)) for s in self.segments]
        else:
            cuts = [0]
            for n in chars:
                cuts.append(cuts[-1] + n)
            self.segments = [text[a:b] for a, b in pairwise(cuts)]
        self._plant(list(tokens))

    def _plant(self, tokens: list[int]) -> None:
        self.size = 1 << max(0, (len(self.segments) - 1).bit_length())
        pad = [0] * (self.size - len(self.segments))
        self.chars = [0] * self.size + [len(s) for s in self.segments] + pad
        self.tokens = [0] * self.size + tokens + pad
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.segments)

    def leaves(self) -> tuple[list[int], list[int]]:
        """(characters, tokens) of the segments, to be kept."""
        end = self.size + len(self.segments)
        return self.chars[self.size : end], self.tokens[self.size : end]

    def _find(self, at: int) -> tuple[int, int]:
        """The segment that holds character ``at`` (the last one for the end), and its start."""
        if at >= self.chars[1]:
            k = max((i for i, s in enumerate(self.segments) if s), default=0)
            return k, self.chars[1] - len(self.segments[k])
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, k: int, segment: str) -> None:
        self.segments[k] = segment
        node = self.size + k
        chars, tokens = len(segment), len(self.encode(segment)) if segment else 0
        self.reencoded += chars
        by_chars, by_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += by_chars
            self.tokens[node] += by_tokens
            node //= 2

    def _beside(self, k: int, step: int) -> int:
        """The nearest segment on that side that is not empty, or -1."""
        k += step
        while 0 <= k < len(self.segments) and not self.segments[k]:
            k += step
        return k if 0 <= k < len(self.segments) else -1

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` by ``inserted``.

        What lies beyond the ends of the text is left out.
        """
        at = min(max(at, 0), self.chars[1])
        removed = min(max(removed, 0), self.chars[1] - at)
        first, start = self._find(at)
        last = self._find(at + removed - 1)[0] if removed else first
        joined = "".join(self.segments[first : last + 1])
        joined = joined[: at - start] + inserted + joined[at - start + removed :]
        # a neighbour joins in while the border to it is none any more
        while (before := self._beside(first, -1)) >= 0 and not _holds(self.segments[before], joined):
            joined, first = self.segments[before] + joined, before
        while (after := self._beside(last, 1)) >= 0 and not _holds(joined, self.segments[after]):
            joined, last = joined + self.segments[after], after
        if len(joined) > 4 * SEGMENT_CHARS:  # grown too long: cut anew
            parts = [joined[a:b] for a, b in pairwise(borders(joined))]
            self.reencoded += len(joined)
            tokens = self.leaves()[1]
            self.segments[first : last + 1] = parts
            tokens[first : last + 1] = [len(self.encode(p)) for p in parts]
            self._plant(tokens)
            return
        for k in range(first + 1, last + 1):
            self._set(k, "")
        self._set(first, joined)


def _holds(left: str, right: str) -> bool:
    return len(right) > 1 and bool(left) and bool(_BORDER.match(left[-1] + right[:2]))


def trees(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, chars, tokens: the segments of each document, to be kept and edited later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encode_with(path)
        for batch in batches:
            kept = [SegmentTree(t.as_py() or "", encode).leaves() for t in batch.column(1)]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in kept], ints) for k in (0, 1))],
                names=["doc_id", "chars", "tokens"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, chars array<int>, tokens array<int>")


def recount(rows: DataFrame, edits: Column, path: str = RANKS) -> DataFrame:
    """Per row: doc_id, n_tokens, n_segments, n_tokens_edited, n_chars_edited, n_chars_reencoded.

    ``rows`` has doc_id and text, and chars and tokens if trees were kept (else they are
    made). ``edits`` is an array of (at, removed, inserted), applied in order; positions
    count characters of the text as the edits before left it. A null text is empty, null
    edits are none, null members of an edit are 0 and "". Rows that repeat repeat; an
    empty table gives no rows.
    """
    kept = {"chars", "tokens"} <= set(rows.columns)
    rows = rows.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        edits.cast(EDITS).alias("edits"),
        *(["chars", "tokens"] if kept else []),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encode_with(path)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text, edits, *leaves = (batch.column(k)[i].as_py() for k in range(1, batch.num_columns))
                tree = SegmentTree(text or "", encode, *leaves)
                before, segments = tree.total, len(tree.segments)
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                out.append((before, segments, tree.total, tree.chars[1], tree.reencoded))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(5))],
                names=["doc_id", *COUNTS],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ("n_tokens", "n_segments", "n_tokens_edited", "n_chars_edited", "n_chars_reencoded")
