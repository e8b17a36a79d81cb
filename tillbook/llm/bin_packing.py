"""Packing documents into sequences by minimum bin slack.

Documents become runs of token ids, longer ones are cut, and what is packed is lengths:
how many pieces there are of each of at most ``capacity`` lengths. Bin by bin, a bitset
subset-sum over the available lengths finds the fullest combination around the longest
piece left; it is taken as often as the counts allow and removed. The patterns number
about as many as the lengths, whatever the number of documents; pieces find their place
in them by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import with_positions
from tillbook.llm.encoding import RANKS, encode_with
from tillbook.plans.worktables import materialize

CAPACITY = 1024
END_ID = 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full, but for the first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encode_with(path)
        for batch in batches:
            rows, crcs, ids = [], [], []
            for i, text in enumerate(batch.column(1)):
                ids_of = encode(text.as_py() or "")
                held = memoryview(np.array([*ids_of, END_ID], "<u4").tobytes())
                for k, (start, length) in enumerate(cut(len(held) // 4, capacity)):
                    part = held[4 * start : 4 * (start + length)]
                    rows.append((i, k, start, length))
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            owner, piece, start, length = np.array(rows, np.int64).reshape(-1, 4).T
            columns = [
                batch.column(0).take(pa.array(owner)),
                pa.array(piece.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array(crcs, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, and how often each, that fill ``room`` best; long ones are preferred.

    Bit s of the set tells that s can be made from the lengths seen so far.
    """
    keep = (1 << (room + 1)) - 1
    made, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        steps.append((length, made))
        left, chunk = min(counts[length], room // length), 1
        while left:  # copies in powers of two
            take = min(chunk, left)
            made |= (made << (take * length)) & keep
            left, chunk = left - take, 2 * chunk
        if made >> room & 1:
            break
    at, used = made.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> at & 1:
            used[length] = used.get(length, 0) + 1
            at -= length
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a bin and how often each, number of such bins) until nothing is left."""
    left = {length: n for length, n in counts.items() if n}
    found = []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest(left, capacity - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[length] // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        found.append((used, times))
    return found


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (doc_id, piece, length, ...) with sequence_id and offset.

    The places table has a row for each length of each pattern, bounded by the capacity,
    and goes to every task.
    """
    spark = made.sparkSession
    # at most `capacity` rows
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    places, first = [], 0
    taken = dict.fromkeys(counts, 0)
    for used, times in patterns(counts, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            places.append((length, taken[length], taken[length] + n * times, n, first, offset))
            taken[length] += n * times
            offset += n * length
        first += times
    places = spark.createDataFrame(
        places, "length long, low long, high long, copies long, first long, base long"
    )
    ranked = with_positions(made, "length", ["doc_id", "piece"], "_rank")
    in_range = (ranked["length"] == places["length"]) & (ranked["_rank"] >= places["low"]) & (
        ranked["_rank"] < places["high"]
    )
    within = F.col("_rank") - F.col("low")
    return ranked.join(F.broadcast(places), in_range).select(
        *[ranked[c] for c in made.columns],
        (F.col("first") + F.floor(within / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + within % F.col("copies") * ranked["length"]).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = RANKS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end id; a null or empty text is the end id alone. Rows
    that repeat, also with a null doc_id, are packed as often as they come. An empty table
    gives no rows. Columns other than doc_id and text are not read.
    """
    return pack(materialize(pieces(docs, capacity, path), "pieces"), capacity)
