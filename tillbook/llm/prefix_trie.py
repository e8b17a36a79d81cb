"""Prefix trie of conversations by ROLLUP over columns of turn ids.

A turn is an id: a digest of role and text, and the text's length. A conversation's turns
stand in ``WIDTH`` columns, and ROLLUP over these columns groups by every prefix at once;
``grouping_id`` tells its depth. A longer conversation goes on in further blocks of columns
whose rows carry the node that the block before ended at, so that blocks of all depths are
aggregated in one query. The node at a block's end comes from a scan by doubling: after n
joins a block's digest stands for the 2**n blocks up to it.

A second ROLLUP over the nodes sums subtrees within blocks; what lies in the blocks below is
added before it, again by doubling. No row holds more than a block, and no task holds a
conversation or the members of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import ROWS_PER_BUCKET, numbered
from tillbook.plans.worktables import materialize

#: Turns in a block of columns.
WIDTH = 8
#: Bytes of a digest; a turn's id has 4 more for the length of its text.
DIGEST = 16
ROOT = bytes(DIGEST)
#: Conversations lend their first turns to those of the next ids: 0 to 99, 100 to 199, ...
SHARED = 100
#: At most so many turns less one are lent.
DRAWS = 6
#: Ids joined into one text before they are hashed.
PIECE = 4096

TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def _digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * DIGEST))


def _none() -> Column:
    return F.lit(b"")


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id) of all turns; a null role or text counts as empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    chars = F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.concat(_digest(whole.cast("binary")), chars).alias("id"),
    )


def _chars(turn: Column) -> Column:
    """The length of the text that a turn id stands for."""
    return F.conv(F.hex(F.substring(turn, DIGEST + 1, 4)), 16, 10).cast("long")


def rebuilt(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id), and the rebuilt turns (conv_id, pos, id), pos from 1.

    Conversation c begins with the first h turns of c - c % 100, then come its own behind
    its first h; h is crc32(c) % 6. At most 100 conversations share such a beginning.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % DRAWS
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    placed = numbered(ids, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("id")], "pos")
    placed = materialize(placed.select("conv_id", "pos", "id"), "placed-turns")
    convs = placed.filter("pos = 1").select("conv_id", base.alias("base"), h.alias("h"))
    lent = placed.filter((F.col("conv_id") % SHARED == 0) & (F.col("pos") < DRAWS)).select(
        F.col("conv_id").alias("base"), "pos", "id"
    )
    first = convs.join(lent, "base").filter("pos <= h").select("conv_id", "pos", "id")
    has = lent.groupBy("base").agg(F.max("pos").alias("has"))
    own = (
        placed.withColumns({"h": h, "base": base})
        .filter("pos > h")
        .join(has, "base", "left")
        .withColumn("pos", F.col("pos") - F.col("h") + F.least("h", F.coalesce("has", F.lit(0))))
    )
    return convs.select("conv_id"), first.unionByName(own.select("conv_id", "pos", "id"))


def blocks_of(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, block, entry, t1 ... , last), a row a block, and the highest block.

    ``entry`` is the node before the block. In a full block the digest of the last column
    is that of the node it ends at, so that it is the entry of the block that follows.
    """
    pos = F.col("pos") - 1
    cut = (
        turns.groupBy("conv_id", F.floor(pos / WIDTH).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct((pos % WIDTH).alias("at"), "id"))).alias("turns"))
        .select("conv_id", "block", F.transform("turns", lambda x: x["id"]).alias("ids"))
    )
    cut = cut.withColumn(
        "sum", F.when(F.size("ids") == WIDTH, _digest(F.concat(*[F.get("ids", F.lit(i)) for i in range(WIDTH)])))
    )
    cut = materialize(cut, "blocks")
    highest = cut.agg(F.max("block")).first()[0] or 0
    ends = cut.filter("sum is not null").select("conv_id", "block", "sum")
    reach = 1
    while reach <= highest:
        behind = ends.select("conv_id", (F.col("block") + reach).alias("block"), F.col("sum").alias("before"))
        far = ends.filter(F.col("block") >= reach).join(behind, ["conv_id", "block"])
        joined = far.select("conv_id", "block", _digest(F.concat("before", "sum")).alias("sum"))
        ends = materialize(ends.filter(F.col("block") < reach).unionByName(joined), "block-ends")
        reach *= 2
    after = ends.select("conv_id", (F.col("block") + 1).alias("block"), F.col("sum").alias("entry"))
    more = cut.filter("block > 0").select("conv_id", (F.col("block") - 1).alias("block"), F.lit(True).alias("more"))
    turn = [F.get("ids", F.lit(i)) for i in range(WIDTH)]
    turn[-1] = F.concat("end", F.substring(turn[-1], DIGEST + 1, 4))
    rows = (
        cut.drop("sum")
        .join(ends.withColumnRenamed("sum", "end"), ["conv_id", "block"], "left")
        .join(after, ["conv_id", "block"], "left")
        .join(more, ["conv_id", "block"], "left")
        .select(
            "conv_id",
            "block",
            F.coalesce("entry", F.lit(ROOT)).alias("entry"),
            *[t.alias(name) for t, name in zip(turn, TURNS)],
            F.col("more").isNull().alias("last"),
        )
    )
    return materialize(rows, "block-rows"), highest


def _node(depth: Column) -> Column:
    """The node at ``depth`` of a block's row; at depth 0 it is the entry."""
    path = [F.when(depth >= i, F.col(t)).otherwise(_none()) for i, t in enumerate(TURNS, 1)]
    return (
        F.when(depth == 0, F.col("entry"))
        .when(depth == WIDTH, F.substring(F.col(TURNS[-1]), 1, DIGEST))
        .otherwise(_digest(F.concat("entry", *path[:-1])))
    )


def _rolled_up(rows: DataFrame, sums: str) -> DataFrame:
    """``sums`` for every prefix of one turn or more in every block, with ``depth`` in it."""
    columns = ", ".join(TURNS)
    rolled = rows.sparkSession.sql(
        f"""
        SELECT block, entry, {columns}, {sums}, {WIDTH} - bit_count(grouping_id()) AS depth
        FROM {{rows}} GROUP BY block, entry, ROLLUP ({columns})
        """,
        rows=rows,
    )
    # a prefix longer than its conversation ends in nulls
    filled = F.size(F.array_compact(F.array(*TURNS)))
    return rolled.filter((F.col("depth") > 0) & (filled == F.col("depth")))


def _below(sums: DataFrame, links: DataFrame, highest: int) -> DataFrame:
    """(node, leaves_below, saved_below): sums over all blocks that hang, however far, at a node.

    ``sums`` (entry, leaves, saved) of every block but the first; ``links`` (node, up) tells
    in which block a block's entry lies. After n rounds a block has what lies less than 2**n
    blocks under it.
    """
    up = F.when(F.col("up") != F.lit(ROOT), F.col("up")).alias("up")
    acc = sums.join(links.withColumnRenamed("node", "entry"), "entry").select("entry", "leaves", "saved", up)
    acc = materialize(acc, "hanging-blocks")
    reach = 1
    while reach <= highest:
        added = (
            acc.filter("up is not null")
            .groupBy(F.col("up").alias("entry"))
            .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        )
        jump = acc.select(F.col("entry").alias("up"), F.col("up").alias("next"))
        acc = acc.join(added, "entry", "left").join(jump, "up", "left").select(
            "entry",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            F.col("next").alias("up"),
        )
        acc = materialize(acc, "hanging-blocks")
        reach *= 2
    return acc.select(
        F.col("entry").alias("node"),
        F.col("leaves").alias("leaves_below"),
        F.col("saved").alias("saved_below"),
    )


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ends`` (node, conv_id): the SHA-256 of a node's ids in order.

    Rows are range-partitioned by node and id, so that a node with very many ids lies in
    many tasks, and joined there into texts of at most ``PIECE`` ids. Those of a node are
    then hashed one by one in order, by a task that holds one at a time.
    """
    spark = ends.sparkSession
    ends = materialize(ends, "ends")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-ends.count() // ROWS_PER_BUCKET))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            found = []
            for here, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (here != node or len(ids) == PIECE):
                    found.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = here
                ids.append(conv_id)
            yield pieces(found)
        yield pieces([(node, ids[0], ",".join(map(str, ids)))] if ids else [])

    def pieces(found: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
        columns = zip(*found) if found else ((), (), ())
        kinds = (pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "first", "ids"]
        )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, last = None, None, 0
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("node", "place", "ids")]
            for here, place, ids in zip(*columns):
                if place == 1:
                    if state:
                        found.append((node, state.hexdigest()))
                    node, state = here, hashlib.sha256(ids.encode())
                elif here != node or place != last + 1:
                    raise RuntimeError(f"piece {place} came after piece {last}")
                else:
                    state.update(f",{ids}".encode())
                last = place
            yield hashed(found)
        yield hashed([(node, state.hexdigest())] if state else [])

    def hashed(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
        nodes, sums = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], ["node", "ends_sha256"]
        )

    joined = (
        ends.repartitionByRange(parts, "node", "conv_id")
        .sortWithinPartitions("node", "conv_id")
        .mapInArrow(join, "node binary, first long, ids string")
    )
    # the window keeps a node's pieces together and in order, also under re-planning
    place = F.row_number().over(Window.partitionBy("node").orderBy("first")).alias("place")
    return joined.select("node", place, "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations, the root first of all prefixes.

    ``conversations`` has (conv_id, turn, role, text). Turns go by ``turn``, null first;
    turns of one number go by the digest of role and text, a fixed order; a repeated row is
    a turn of its own. A null role or text is empty; rows without conv_id belong to no
    conversation. Every conversation is rebuilt as :func:`rebuilt` says. A row per node:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Without conversations there is no root and no row. Further
    columns are not read.
    """
    convs, turns = rebuilt(materialize(turn_ids(conversations), "turn-ids"))
    rows, highest = blocks_of(turns)
    nodes = _rolled_up(rows, "min(conv_id) AS conv_id, count(*) AS n_convs")
    depth = F.col("depth")
    last_turn = F.element_at(F.array(*TURNS), depth.cast("int"))
    nodes = materialize(
        nodes.withColumns(
            {"node": _node(depth), "parent": _node(depth - 1), "chars": _chars(last_turn)}
        ).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")),
        "nodes",
    )
    children = materialize(
        nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "children"
    )
    counted = nodes.join(children, "node", "left").withColumns(
        {
            "leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
            "n_children": F.coalesce("n_children", F.lit(0)),
        }
    )
    counted = own = materialize(counted, "counted-nodes")
    if highest:
        later = counted.filter("block > 0").groupBy("entry").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        links = counted.filter(depth == WIDTH).select("node", F.col("entry").alias("up"))
        counted = counted.join(_below(later, links, highest), "node", "left").withColumns(
            {
                "leaves": F.col("leaves") + F.coalesce("leaves_below", F.lit(0)),
                "saved": F.col("saved") + F.coalesce("saved_below", F.lit(0)),
            }
        )
        counted = materialize(counted, "counted-nodes")
    subtrees = _rolled_up(counted, "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens").select(
        _node(depth).alias("node"), "n_leaves", "saved_tokens"
    )

    turnless = convs.join(rows.filter("block = 0"), "conv_id", "left_anti")
    root = F.lit(ROOT).alias("node")
    ends = rows.filter("last").select(_node(F.size(F.array_compact(F.array(*TURNS)))).alias("node"), "conv_id")
    hashes = ends_hashed(ends.unionByName(turnless.select(root, "conv_id")))

    no = F.lit(0).cast("long")
    parts = convs.select("conv_id", (no + 1).alias("n_convs"), no.alias("n_children"), no.alias("leaves"), no.alias("saved"))
    in_all = own.select(
        F.lit(None).cast("long").alias("conv_id"),
        no.alias("n_convs"),
        F.when((F.col("block") == 0) & (depth == 1), 1).otherwise(0).cast("long").alias("n_children"),
        "leaves",
        "saved",
    )
    root_row = (
        parts.unionByName(in_all)
        .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in parts.columns[1:]])
        .filter("n_convs > 0")
        .select(
            root,
            F.lit(None).cast("binary").alias("parent"),
            "conv_id",
            no.alias("depth"),
            "n_convs",
            "n_children",
            F.greatest("leaves", F.lit(1)).alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
        )
    )
    whole = counted.join(subtrees, "node").select(
        "node",
        "parent",
        "conv_id",
        (F.col("block") * WIDTH + depth).cast("long").alias("depth"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
    )
    above = nodes.select("node", "conv_id").unionByName(root_row.select("node", "conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        whole.unionByName(root_row)
        .join(hashes, "node", "left")
        .join(above.toDF("parent", "parent_conv_id"), "parent", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )
