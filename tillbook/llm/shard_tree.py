"""Sharding by a weighted hash tree of regions, racks and shards.

A row descends from the root: at each level every child draws -ln(u)/weight with u from
a hash of the child's name and the row's key, and the smallest draw wins. A child wins in
proportion to its weight. Raising one child's weight only lowers its own draws, so rows
move only into its subtree; siblings below an unchanged node keep theirs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import text_of, with_positions

#: Bytes a row takes besides its text.
ROW_BYTES = 16
CHILDREN = "array<array<struct<name string, weight double, number int>>>"


@dataclass(frozen=True)
class Node:
    """A region, a rack or, with ``shard`` set, a shard. Weights of inner nodes are sums."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def regular_tree(regions: int, racks: int, shards: int) -> Node:
    """A root of equal regions of equal racks of equal shards, numbered from 0."""
    number = iter(range(regions * racks * shards))
    return Node(
        "root",
        tuple(
            Node(
                f"g{g}",
                tuple(
                    Node(f"g{g}r{r}", tuple(Node(f"s{(s := next(number))}", shard=s) for _ in range(shards)))
                    for r in range(racks)
                ),
            )
            for g in range(regions)
        ),
    )


def grown(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region and rack of its own: only it gains rows."""
    number = 1 + max(leaf.shard for leaf in leaves(root))
    leaf = Node(f"s{number}", shard=number, own_weight=weight)
    region = Node(f"g-{number}", (Node(f"g-{number}r", (leaf,)),))
    return replace(root, children=(*root.children, region))


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def _draw(name: Column, weight: Column, key: Column) -> Column:
    """48 bits of a digest as u in (0, 1), as an exponential draw of that weight."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", name, key)), 1, 12), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**48))) / weight


def assign(df: DataFrame, root: Node, key: Column, out: str) -> DataFrame:
    """Add ``out``: the shard that ``key`` (text) descends to. All leaves lie at one depth."""
    level, df = [root], df.withColumn("_at", F.lit(0))
    while level[0].children:
        number = iter(range(len(leaves(root))))
        nodes = json.dumps(
            [[{"name": c.name, "weight": c.weight, "number": next(number)} for c in n.children] for n in level]
        )
        children = F.from_json(F.lit(nodes), CHILDREN)[F.col("_at")]
        draws = F.transform(
            children,
            lambda c: F.struct(_draw(c["name"], c["weight"], key).alias("draw"), c["number"].alias("number")),
        )
        df = df.withColumn("_at", F.array_min(draws)["number"])
        level = [c for n in level for c in n.children]
    shards = F.array(*[F.lit(n.shard) for n in level])
    return df.withColumn(out, F.element_at(shards, F.col("_at") + 1).cast("int")).drop("_at")


def shard_documents(docs: DataFrame, root: Node) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot, grown_shard.

    The shard depends on doc_id and the tree alone: equal texts spread like any others,
    and repeated rows of one doc_id share a shard. A null doc_id counts as one more key.
    A null text has no bytes. ``slot`` numbers the rows of a shard from 0 without gaps;
    repeated rows take theirs in any order. An empty table gives no rows.
    """
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    body = F.encode(text_of(docs), "UTF-8")

    def placed(df: DataFrame) -> DataFrame:
        return assign(df, root, F.col("_key"), "shard")

    rows = docs.select(
        "doc_id",
        key.alias("_key"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    sizes = placed(docs.select("doc_id", key.alias("_key")))
    out = with_positions(placed(rows), "shard", ["doc_id"], "slot", sizes=sizes)
    out = assign(out, grown(root), F.col("_key"), "grown_shard")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
