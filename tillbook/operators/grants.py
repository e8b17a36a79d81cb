"""First come, first served: requests granted in order against a limited quantity.

A request is granted when its quantity is at most what the granted requests before it
have left of its key's quantity; a refused one leaves everything for the next. The ways
to that answer, chosen per key:

* up to ``fold_limit`` requests: one task gets the key's rows in order and folds all keys of
  an Arrow batch at once by level jumps (see :func:`fold`). The rows travel whole, once, and
  come out as verdicts, so that nothing has to be brought back to them;
* more requests, and demand fits or nothing is there to give: every request has the same
  answer, found by a join alone;
* more requests, and demand exceeds the quantity: the requests are cut into ordered blocks
  that are summarised and folded side by side (see :func:`_refused_in_blocks`), so no task
  gets the whole key. Key, order and quantity travel one way, ids of refused ones back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions import zero_if_null
from tillbook.plans.worktables import materialize

FOLD_LIMIT = 1_000_000
BLOCK_ROWS = 1_000_000

# Keys broadcast at most; more of them are joined by shuffle.
BROADCAST_KEYS = 100_000

# Bins that requests are counted in to find keys with many of them.
COUNT_BINS = 4096
# Repeated sketches that are listed in the filter at most; more of them become bitmaps.
LISTED_SKETCHES = 1_000
# Repeated sketches whose bitmaps are broadcast at most; more of them are joined by shuffle.
BITMAP_SKETCHES = 32_000_000
# Bits of the bitmaps for each sketch, and bits in one binary of ``bitmap_construct_agg``.
BITS_PER_SKETCH, BITMAP = 16, 32_768

WHOLE, NONE, BLOCKS = "whole", "none", "blocks"
ROW = "_row"
TWICE = "_twice"
MANY = "_many"
PLACE, LAST, HELD = "_place", "_last", "_held"
ASKS, SUPPLY = "_asks", "_supply"
# What a row tells of its key's supply in a column ``rest``: taken up to here, or not asked for.
ASKED, UNASKED = "asked", "unasked"


def _bit(sketch: Column, bitmaps: int) -> tuple[Column, Column]:
    """In which of ``bitmaps`` bitmaps a sketch lies, and at which bit of it."""
    place = F.pmod(sketch, F.lit(bitmaps * BITMAP))
    return F.floor(place / BITMAP).alias("bitmap"), (place % BITMAP).alias("bit")


def _marked_twice(requests: DataFrame, sketch: Column, twice: DataFrame) -> DataFrame:
    """``requests`` with ``TWICE``: surely true where ``twice`` has the sketch, by chance elsewhere.

    Nothing is shuffled, unless there are so many sketches that their bitmaps outgrow a broadcast.
    """
    n = twice.count()
    if n <= LISTED_SKETCHES:
        return requests.withColumn(TWICE, sketch.isin([r["sketch"] for r in twice.collect()]))
    if n > BITMAP_SKETCHES:
        marks = twice.withColumn(TWICE, F.lit(True))
        found = requests.withColumn("sketch", sketch).join(marks, "sketch", "left")
        return found.withColumn(TWICE, F.col(TWICE).isNotNull()).drop("sketch")
    bitmaps = 1 << max(0, (n * BITS_PER_SKETCH - 1) // BITMAP).bit_length()
    bits = twice.select(*_bit(F.col("sketch"), bitmaps)).groupBy("bitmap").agg(
        F.bitmap_construct_agg("bit").alias("_bits")
    )
    bitmap, bit = _bit(sketch, bitmaps)
    placed = requests.select("*", bitmap.alias("_bitmap"), bit.alias("_bit"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1")
    return (
        placed.join(F.broadcast(bits.withColumnRenamed("bitmap", "_bitmap")), "_bitmap", "left")
        .withColumn("_byte", byte)
        .withColumn(TWICE, F.coalesce(hit == 1, F.lit(False)))
        .select(*requests.columns, TWICE)
    )


def _without_repeats(
    requests: DataFrame, unique: str, order: Sequence[str], repeated: str
) -> DataFrame:
    """``requests`` with the reason ``repeated`` where an earlier sound row has the id.

    A first pass counts 64-bit sketches of the ids. Rows whose sketch comes twice, and some
    more by chance, are written; among them the first row of each id is found exactly. The
    others are left where they are. Earlier is what comes first by ``order``, then by the
    other columns; of rows that are equal throughout any one stays.
    """
    sound = F.col("reason").isNull()
    sketch = F.xxhash64(unique)
    twice = materialize(
        requests.filter(sound)
        .select(sketch.alias("sketch"))
        .groupBy("sketch")
        .count()
        .filter("count > 1")
        .select("sketch"),
        "repeated-sketches",
    )
    if twice.isEmpty():
        return requests
    marked = _marked_twice(requests, sketch, twice)
    # a row without an id or with a reason is never doubtful
    doubt = F.coalesce(sound & F.col(TWICE), F.lit(False))
    doubtful = materialize(
        marked.filter(doubt).select(*requests.columns, F.monotonically_increasing_id().alias(ROW)),
        "doubtful-requests",
    )
    rest = [c for c in requests.columns if c not in (*order, unique)]
    first = doubtful.groupBy(unique).agg(F.min(F.struct(*order, *rest, ROW))[ROW].alias("first"))
    again = F.when(F.col(ROW) != F.col("first"), repeated).cast("string")
    judged = materialize(
        doubtful.join(first, unique).withColumn("reason", again).select(*requests.columns),
        "judged-repeats",
    )
    return marked.filter(~doubt).select(*requests.columns).unionByName(judged)


def _many_requests(sound: DataFrame, key: str, fold_limit: int) -> tuple[int, DataFrame | None]:
    """How many requests there are, and demand and count of the keys with over ``fold_limit``.

    Requests are counted in bins of keys first; only keys of full bins are counted one by one.
    """
    place = F.pmod(F.xxhash64(key), F.lit(COUNT_BINS))
    bins = sound.groupBy(place.alias("bin")).count().collect()  # as many as bins
    full = [r["bin"] for r in bins if r["count"] > fold_limit]
    if not full:
        return sum(r["count"] for r in bins), None
    some = sound.filter(place.isin(full)) if len(full) < len(bins) / 2 else sound
    counts = some.groupBy(key).agg(
        F.sum("qty").alias("demand"), F.count("*").alias("request_count")
    )
    many = materialize(counts.filter(F.col("request_count") > fold_limit), "keys-of-many")
    return sum(r["count"] for r in bins), many


def grant_in_order(
    requests: DataFrame,
    supply: DataFrame,
    key: str,
    unknown: str,
    too_much: str,
    order: Sequence[str] = ("seq", "request_id"),
    fold_limit: int = FOLD_LIMIT,
    block_rows: int = BLOCK_ROWS,
    unique: str | None = None,
    repeated: str | None = None,
    taken: str | None = None,
    rest: str | None = None,
) -> DataFrame:
    """All requests with the supply columns and a final ``reason``, NULL when granted; written.

    ``requests`` has ``key``, ``qty``, ``order`` and ``reason``; equal places in ``order``
    are told apart by the other columns. Requests that come with a reason keep it and take
    nothing; the others ask for at least 1. They get ``unknown`` when their key has no
    supply and ``too_much`` when their quantity is more than what is left. With ``unique``
    the first of several requests that share it is judged, the others get ``repeated``.
    ``supply`` has one row per key with ``opening`` and any columns to carry along; refused
    requests may lack them. A column ``taken`` has at one row of each key the sum granted, 0 at
    its other rows, and NULL at those of keys with over ``fold_limit`` requests.

    With ``rest`` a large batch brings the whole supply along, which the shuffle for the fold
    carries anyhow: that column is ``ASKED`` at the last request of a key that is held, and
    ``UNASKED`` at rows more, one for each row of supply without a request or with over
    ``fold_limit`` of them. A small batch, which leaves supply where it is, lacks the column.
    """
    if unique:
        rows, ident = _without_repeats(requests, unique, order, repeated), unique
    else:
        rows = materialize(requests.withColumn(ROW, F.monotonically_increasing_id()), "requests")
        ident = ROW
    ties = [] if unique else [c for c in requests.columns if c not in (key, "reason")]
    order = tuple(dict.fromkeys((*order, *ties, ident)))
    asks = F.col("reason").isNull() & F.col(key).isNotNull()
    sound = rows.filter(asks)
    asked, many = _many_requests(sound, key, fold_limit)
    supply = supply.filter(F.col(key).isNotNull())
    if asked <= BROADCAST_KEYS:  # a small batch does not shuffle a large supply
        keys = materialize(sound.select(key).distinct(), "asked-keys")
        supply = materialize(supply.join(F.broadcast(keys), key, "left_semi"), "asked-supply")
        rest = None
    plain = supply
    # The join takes the window's layout, so that counting is no shuffle more.
    supply = supply.withColumn(HELD, F.count("*").over(Window.partitionBy(key)))

    own = [c for c in requests.columns if c != "reason"]
    carried = [c for c in supply.columns if c not in (key, HELD)]
    extra = [HELD, taken] if taken else [HELD]
    parts = [
        rows.filter(~asks)
        .withColumns({c: F.lit(None).cast(supply.schema[c].dataType) for c in carried})
        .withColumns({HELD: F.lit(None).cast("long"), **({taken: F.lit(0).cast("long")} if taken else {})})
        .withColumn("reason", F.coalesce("reason", F.lit(unknown)))
    ]
    hot_keys = many.count() if many else 0
    cool = sound
    if hot_keys:
        # A fold brings a key's rows together, so hot keys leave before its shuffle.
        few = F.broadcast if hot_keys <= BROADCAST_KEYS else (lambda df: df)
        marks = few(many.select(key, F.lit(True).alias(MANY)))
        marked = sound.join(marks, key, "left").withColumn(MANY, F.col(MANY).isNotNull())
        if hot_keys > BROADCAST_KEYS:  # a shuffle join that every reader would join anew
            marked = materialize(marked, "marked-requests")
        cool, hot = (marked.filter(m).drop(MANY) for m in (~F.col(MANY), F.col(MANY)))
        judged = _judge_many(
            hot, few(many), supply, key, order, ident, unknown, too_much, block_rows
        )
        parts.append(judged.withColumn(taken, F.lit(None).cast("long")) if taken else judged)
    kept = [*own, *carried, "reason", *extra]
    if rest:
        parts = [p.withColumn(rest, F.lit(None).cast("string")) for p in parts]
        kept.append(rest)
        queue = _queue_with_rest(cool, plain, key, order, rest)
    else:
        queue = _queue(cool.join(supply, key, "left"), key, order)
    parts.append(_judge(queue, unknown, too_much, kept, taken))
    verdicts = materialize(reduce(DataFrame.unionByName, [p.select(*kept) for p in parts]), "verdicts")
    twice = verdicts.filter(F.col(HELD) > 1).first()
    if twice:
        raise ValueError(f"{key} {twice[key]} is held {twice[HELD]} times")
    return verdicts.drop(HELD)


def _queue(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Requests that met their supply, each key's in order."""
    turn = Window.partitionBy(key).orderBy(*order)
    return df.select(
        "*",
        F.row_number().over(turn).alias(PLACE),
        F.lead(F.lit(True)).over(turn).isNull().alias(LAST),
    )


def _queue_with_rest(
    requests: DataFrame, supply: DataFrame, key: str, order: Sequence[str], rest: str
) -> DataFrame:
    """As :func:`_queue`, and the rows of supply that no request meets.

    Both lie in one shuffle, a key's supply before its requests. An outer join would leave
    its rows in no layout that the window could use.
    """
    carried = [c for c in supply.columns if c != key]
    given = supply.select(key, F.struct(*carried).alias(SUPPLY), F.lit(False).alias(ASKS))
    asked = requests.withColumn(ASKS, F.lit(True))
    turn = Window.partitionBy(key).orderBy(ASKS, *order)
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = asked.unionByName(given, allowMissingColumns=True).select(
        *requests.columns,
        ASKS,
        F.when(F.col(ASKS), F.first(SUPPLY).over(whole)).otherwise(F.col(SUPPLY)).alias(SUPPLY),
        F.sum(F.when(F.col(ASKS), 0).otherwise(1)).over(whole).alias(HELD),
        F.max(ASKS).over(whole).alias("_wanted"),
        F.row_number().over(turn).alias(PLACE),
        F.lead(F.lit(True)).over(turn).isNull().alias(LAST),
    )
    held = F.col(HELD) > 0
    return met.filter(F.col(ASKS) | ~F.col("_wanted")).select(
        *requests.columns,
        *[F.col(SUPPLY)[c].alias(c) for c in carried],
        # rows of one key that nobody asks for are no fault
        F.when(~F.col(ASKS), 1).when(held, F.col(HELD)).cast("long").alias(HELD),
        F.when(F.col(ASKS), F.col(PLACE) - F.col(HELD)).otherwise(1).cast("int").alias(PLACE),
        LAST,
        F.when(~F.col(ASKS), UNASKED).when(F.col(LAST) & held, ASKED).alias(rest),
    )


def _judge(
    queue: DataFrame, unknown: str, too_much: str, kept: list[str], taken: str | None
) -> DataFrame:
    """``kept`` columns of ``queue``, among them ``reason`` and ``taken``: each key served in order."""
    given = [c for c in kept if c not in ("reason", taken)]

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(PLACE).to_numpy()
            starts = _starts(place, last)
            qty, opening = (
                pc.fill_null(batch.column(c), 0).to_numpy().astype(np.int64) for c in ("qty", "opening")
            )
            left = opening[starts]
            if place[0] != 1:
                starts, left = np.append(0, starts), np.append(rest, left)
            granted, left = fold(qty, starts, left)
            rest, last = int(left[-1]), int(place[-1])
            refusal = pc.if_else(pc.is_null(batch.column(HELD)), unknown, too_much)
            reason = pc.if_else(pa.array(granted), pa.scalar(None, pa.string()), refusal)
            columns = {c: batch.column(c) for c in given} | {"reason": reason}
            if taken:
                ends = np.append(starts[1:], len(qty)) - 1
                total = np.zeros(len(qty), np.int64)
                total[ends] = opening[ends] - left.astype(np.int64)
                last_rows = batch.column(LAST).to_numpy(zero_copy_only=False)
                columns[taken] = pa.array(np.where(last_rows, total, 0))
            yield pa.RecordBatch.from_arrays([columns[c] for c in kept], names=kept)

    types = {c: queue.schema[c].dataType for c in (*given, "reason")} | ({taken: T.LongType()} if taken else {})
    return queue.mapInArrow(serve, T.StructType([T.StructField(c, types[c]) for c in kept]))


def _judge_many(
    requests: DataFrame,
    many: DataFrame,
    supply: DataFrame,
    key: str,
    order: Sequence[str],
    ident: str,
    unknown: str,
    too_much: str,
    block_rows: int,
) -> DataFrame:
    """Requests of keys that have too many of them for one task, judged."""
    way = (
        F.when(F.col("demand") <= F.col("opening"), WHOLE)
        .when(F.col("opening") < 1, NONE)
        .otherwise(BLOCKS)
    )
    ways = materialize(supply.join(many, key).withColumn("way", way).drop("demand"), "ways")
    twice = ways.filter(F.col(HELD) > 1).first()
    if twice:
        raise ValueError(f"{key} {twice[key]} is held {twice[HELD]} times")
    large = ways.filter(F.col("way") == BLOCKS).select(key, "opening", "request_count")
    size = large.agg(
        F.sum("request_count").alias("rows"),
        F.max("opening").alias("opening"),
        F.count("*").alias("keys"),
    ).first()
    refused = F.lit(None).cast("boolean")
    rows = requests
    if size["rows"]:
        small = F.broadcast if size["keys"] <= BROADCAST_KEYS else (lambda df: df)
        narrow = requests.select(*dict.fromkeys((key, "qty", *order)))
        marks = _refused_in_blocks(
            narrow.join(small(large), key).drop("request_count"),
            large,
            key,
            order,
            ident,
            blocks=math.ceil(size["rows"] / block_rows),
            levels=size["opening"].bit_length(),
        )
        marks = materialize(
            marks.select(ident).withColumn("_refused", F.lit(True)), "refused-requests"
        )
        rows, refused = rows.join(marks, ident, "left"), F.col("_refused")
    # Spark may split the rows of a hot key here: nothing after the join needs them together.
    way = F.col("way")
    refusal = F.when(way.isNull(), unknown).when((way == NONE) | refused, too_much)
    return rows.join(ways.drop("request_count"), key, "left").withColumn("reason", refusal)


def fold(qty: np.ndarray, starts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which requests are granted, and what each unit has left, of units that lie in a row.

    Unit u has the requests from ``starts[u]`` to the next start and ``left[u]`` to give.
    While that is between ``2**n`` and ``2**(n + 1)``, requests below ``2**n`` are granted,
    larger ones only if they fit, and the first request that takes it below ``2**n`` is
    found by a running sum. So a round takes every unit down a level at least, and there
    are at most as many rounds as the largest quantity has bits.
    """
    n, units = len(qty), len(starts)
    bits = int(left.max(initial=0)).bit_length() + n.bit_length()
    kind = np.int64 if bits < 62 else object  # running sums must not overflow
    qty, left = qty.astype(kind), left.astype(kind)
    granted = np.zeros(n, bool)
    at = np.arange(n)  # requests still open
    unit = np.repeat(np.arange(units), np.diff(np.append(starts, n)))
    while len(at):
        has = left[unit] > 0
        at, unit = at[has], unit[has]
        if not len(at):
            break
        ones = left.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            ones |= ones >> shift
        low = (ones - (ones >> 1))[unit]
        q, room = qty[at], left[unit]
        small = q < low
        total = np.cumsum(np.where(small, q, 0))
        first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        before = np.where(first > 0, total[first - 1], 0)
        size = np.diff(np.append(first, len(at)))
        taken = total - np.repeat(before, size)
        falls = np.where(small, room - taken < low, q <= room - taken)
        places = np.where(falls, np.arange(len(at)), len(at))
        stop = np.minimum.reduceat(places, first)
        end = np.minimum(stop, first + size - 1)
        stops = np.repeat(stop, size)
        here = np.arange(len(at))
        granted[at[(here <= stops) & (small | (here == stops))]] = True
        ended = stop < len(at)
        large = ended & ~small[end]
        left[unit[first]] -= taken[end] + np.where(large, q[end], 0)
        on = here > stops
        at, unit = at[on], unit[on]
    return granted, left


def _in_order(df: DataFrame, unit: list[str], order: Sequence[str], *columns: Column | str) -> DataFrame:
    """``columns`` of ``df`` with each unit's rows in one task, in order; ``place`` counts from 1.

    The window keeps Spark from rearranging the rows at run time; a bare ``repartition``
    would not. The functions that follow in the same task check that they get them so.
    """
    place = F.row_number().over(Window.partitionBy(*unit).orderBy(*order)).alias("place")
    return df.select("*", place).select(*unit, "qty", "place", *columns)


def _starts(place: np.ndarray, last: int) -> np.ndarray:
    """Where units begin in a batch that follows a row of place ``last``."""
    new = place == 1
    if (place != np.where(new, 1, np.append(last, place[:-1]) + 1)).any():
        raise RuntimeError("requests came out of order")
    return np.flatnonzero(new)


def _served(
    df: DataFrame, unit: list[str], opening: str, order: Sequence[str], refused: str | None = None
) -> DataFrame:
    """Each unit of ``df`` served in order from ``opening``.

    The column ``refused`` of refused rows, or without one what a unit has left (``unit``,
    left).
    """
    ident = [refused] if refused else []
    queue = _in_order(df, unit, order, *ident, F.col(opening).alias("opening"))
    kept = ident or [*unit, "place"]

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            starts = _starts(place, last)
            qty, opening = (batch.column(c).to_numpy().astype(np.int64) for c in ("qty", "opening"))
            left = opening[starts]
            if place[0] != 1:
                starts, left = np.append(0, starts), np.append(rest, left)
            granted, left = fold(qty, starts, left)
            rest, last = int(left[-1]), int(place[-1])
            if refused:
                yield batch.filter(pa.array(~granted)).select(kept)
            else:
                ends = batch.take(pa.array(np.append(starts[1:], len(qty)) - 1)).select(kept)
                columns = [*ends.columns, pa.array([int(x) for x in left], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "left"])

    schema = T.StructType([queue.schema[name] for name in kept])
    if refused:
        return queue.mapInArrow(serve, schema)
    # a unit that lies in several batches comes once for each; the last one counts
    so_far = queue.mapInArrow(serve, schema.add("left", T.LongType()))
    return so_far.groupBy(*unit).agg(F.max_by("left", "place").alias("left"))


def _level(left: Column) -> Column:
    """Place of the highest set bit: ``2**level <= left < 2**(level + 1)``."""
    return F.length(F.bin(left)) - 1


def _summarise(placed: DataFrame, key: str, order: Sequence[str], levels: int) -> DataFrame:
    """Per block and level: the sum of quantities below ``2**level``, and the least
    quantity left over with which a request of ``2**level`` or more still fits.

    Nothing at a level reaches ``2**(level + 1)``, so both are cut off at twice that.
    """
    unit = [key, "block"]
    queue = _in_order(placed, unit, order)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the block that goes on in the next batch
        sums, least, last = [0] * levels, [None] * levels, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            starts = _starts(place, last)
            goes_on, last = place[0] != 1, int(place[-1])
            if goes_on:
                starts = np.append(0, starts)
            ends = np.append(starts[1:], len(place)) - 1
            qty = batch.column("qty").to_numpy().astype(np.int64)
            small, fits = [], []
            for level in range(levels):
                low, most = 1 << level, 1 << (level + 2)
                kind = np.int64 if level + len(qty).bit_length() < 60 else object
                q = qty.astype(kind)
                total = np.cumsum(np.where(qty < low, q, 0))
                before = np.where(starts > 0, total[starts - 1], 0)
                if goes_on:
                    before[0] -= sums[level]
                here = total - np.repeat(before, ends - starts + 1)
                middle = (qty >= low) & (qty < 2 * low)
                fit = np.minimum.reduceat(np.where(middle, np.minimum(q + here, most), most), starts)
                fit = [int(x) if x < most else None for x in fit]
                if goes_on and least[level] is not None:
                    fit[0] = least[level] if fit[0] is None else min(fit[0], least[level])
                small.append([min(int(x), most) for x in here[ends]])
                fits.append(fit)
                sums[level], least[level] = small[-1][-1], fit[-1]
            found = batch.take(pa.array(ends)).select([*unit, "place"])
            lists = [pa.array(list(zip(*x)), pa.list_(pa.int64())) for x in (small, fits)]
            yield pa.RecordBatch.from_arrays([*found.columns, *lists], names=[*unit, "place", "small", "fits"])

    schema = T.StructType([queue.schema[name] for name in (*unit, "place")])
    longs = T.ArrayType(T.LongType())
    so_far = queue.mapInArrow(summarise, schema.add("small", longs).add("fits", longs))
    return so_far.groupBy(*unit).agg(
        F.max_by("small", "place").alias("small"), F.max_by("fits", "place").alias("fits")
    )


def _refused_in_blocks(
    requests: DataFrame,
    large: DataFrame,
    key: str,
    order: Sequence[str],
    ident: str,
    blocks: int,
    levels: int,
) -> DataFrame:
    """The fold of a key over many tasks.

    While a key has ``left`` with ``2**n <= left < 2**(n+1)``, all its requests below
    ``2**n`` are granted, and the first granted one of ``2**n`` or more takes it below
    ``2**n``. So up to the block where it falls below ``2**n``, what is left before each
    block follows from the block summaries alone. Only that block is folded in detail,
    and the next round starts behind it, at a lower level: at most ``levels`` rounds.
    With what is left before every block known, all blocks are folded at once.

    A key inside one block has its whole quantity before it. Only keys that go on over the
    end of a block, at most two a block, are summarised and followed through the rounds.
    """
    placed = materialize(
        requests.repartitionByRange(blocks, key, *order).withColumn("block", F.spark_partition_id()),
        "request-blocks",
        partition_by="block",
    )
    ends = placed.groupBy("block").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias(key))
    spanning = materialize(
        ends.groupBy(key).count().filter("count > 1").select(key, F.lit(True).alias("_spans")),
        "spanning-keys",
    )
    spans = spanning.count()
    if not spans:
        return _served(placed, [key, "block"], "opening", order, ident)
    small = F.broadcast if spans <= BROADCAST_KEYS else (lambda df: df)
    followed = placed.drop("opening").join(small(spanning.select(key)), key, "left_semi")
    summary = materialize(_summarise(followed, key, order, levels), "block-summary")
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = large.join(small(spanning), key).select(
        key, F.lit(-1).alias("after"), F.col("opening").alias("left")
    )
    entries = []
    for _ in range(levels):
        level = _level(F.col("left"))
        ahead = (
            summary.join(state, key)
            .filter(F.col("block") > F.col("after"))
            .select(
                key,
                "block",
                "left",
                level.alias("level"),
                F.element_at("small", level + 1).alias("small"),
                F.element_at("fits", level + 1).alias("fits"),
            )
            .withColumn("entry", F.col("left") - zero_if_null(F.sum("small").over(before)))
        )
        floor = F.expr("shiftleft(1L, level)")
        falls = (F.col("entry") - F.col("small") < floor) | F.coalesce(
            F.col("fits") <= F.col("entry"), F.lit(False)
        )
        first_stop = F.min(F.when(falls, F.col("block"))).over(Window.partitionBy(key))
        reached = materialize(
            ahead.withColumn("stop", first_stop)
            .filter(F.col("stop").isNull() | (F.col("block") <= F.col("stop")))
            .select(key, "block", "entry", "stop"),
            "block-entries",
        )
        entries.append(reached.select(key, "block", "entry"))
        # Blocks are partitions of the written table: only the stops are read.
        stops = reached.filter(F.col("block") == F.col("stop")).drop("stop")
        stopped = placed.drop("opening").join(small(stops), [key, "block"])
        state = materialize(
            _served(stopped, [key, "block"], "entry", order)
            .select(key, F.col("block").alias("after"), "left")
            .filter(F.col("left") > 0),
            "block-state",
        )
        if state.isEmpty():
            break
    known = reduce(DataFrame.unionByName, entries)
    opened = (
        placed.join(small(known), [key, "block"], "left")
        .join(small(spanning), key, "left")
        .withColumn("entry", F.when(F.col("_spans"), zero_if_null(F.col("entry"))).otherwise(F.col("opening")))
        .drop("opening")
    )
    return _served(opened, [key, "block"], "entry", order, ident)
