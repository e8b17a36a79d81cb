"""Near-duplicate documents by SuperMinHash signatures, banding, verification, union-find.

A document's set holds its distinct 5-word shingles. SuperMinHash gives each element a
random permutation of the signature's places with ranks that rise along it (place j of
the permutation gets rank j plus a fraction), so places are filled evenly and a document
is done as soon as no later rank can lower any of its values. Documents that agree in a
band are candidates; every link is confirmed on the full sets. A large group of candidates is
first held against pivots, one comparison a document; what that connects is not compared
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.components import connected_components
from tillbook.plans.worktables import materialize

WORDS = 5
#: Similarity in percent from which two documents are linked.
PERCENT = 75
#: A pair at the threshold shares no band of 24 times 4 values with probability 1e-4.
BANDS, ROWS = 24, 4
PLACES = BANDS * ROWS
#: Shingles that are signed at once, and that one block of a group of candidates holds.
SIGNED_AT_ONCE = 200_000
BLOCK_SHINGLES = 100_000
#: Rows that are compared with one copy of their pivot's set.
ROWS_PER_COPY = 500

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle.

    Words are runs without ASCII white space, with A-Z in lower case. No words: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * _ODD + hashed[k : k + len(out)] + _GOLDEN)
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash values of each set, one row of PLACES each; an empty set gets infinity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    signed = np.full(len(sets) * PLACES, np.inf)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = None  # of each element still in play: its permutation, drawn as far as needed
    for level in range(PLACES):
        drawn = _mix(elements + np.uint64((level + 1) * int(_GOLDEN) % 2**64))
        rank = level + (drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53
        span = np.uint64(PLACES - level)
        at = level + (((_mix(drawn ^ _ODD) >> np.uint64(32)) * span) >> np.uint64(32)).astype(np.intp)
        if level == 0:
            place = at
        else:
            rows = np.arange(len(elements))
            place = order[rows, at]
            order[rows, at] = order[:, level]
        np.minimum.at(signed, doc * PLACES + place, rank)
        open_docs = signed.reshape(-1, PLACES).max(axis=1) > level + 1
        on = open_docs[doc]
        if not on.any():
            break
        if level == 0:
            order = np.tile(np.arange(PLACES, dtype=np.uint8), (int(on.sum()), 1))
            order[np.arange(len(order)), at[on]] = 0
        else:
            order = order[on]
        elements, doc = elements[on], doc[on]
    return signed.reshape(-1, PLACES)


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row; keys of different bands differ."""
    values = np.ascontiguousarray(signed).view(np.uint64).reshape(len(signed), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, values.shape[:2])
    for r in range(ROWS):
        keys = _mix(keys * _ODD + values[:, :, r])
    return keys.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start, held, sets = 0, 0, []
        for i, text in enumerate(texts):
            sets.append(shingles(text.as_py()))
            held += len(sets[-1])
            if held < SIGNED_AT_ONCE and i + 1 < len(texts):
                continue
            bands = band_keys(signatures(sets))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            offsets = np.arange(0, bands.size + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(offsets, bands.ravel()),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )
            start, held, sets = i + 1, 0, []


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            sets = [shingles(t.as_py()) for t in batch.column(1).slice(at, 500)]
            sizes = np.array([0, *map(len, sets)], np.int32).cumsum(dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(sizes, np.concatenate(sets).view(np.int64)),
                ],
                names=["digest", "hashes"],
            )


def linked_in_block(
    trees: list[int], sets: list[np.ndarray], bands: list[np.ndarray | None], firsts: int
) -> list[tuple[int, int]]:
    """Links between the trees of a block, as many as connect what links connect.

    Each set belongs to a tree; sets of one tree need no link. The ``firsts`` sets in
    front are compared with all behind them, the others not with each other. Sets with
    ``bands`` are candidates only when they agree in one. Overlaps come from an inverted
    index of the block: for each set the owners of its shingles are counted.
    """
    root = {x: x for x in trees}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    sizes = np.array([len(s) for s in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_place = owners[np.argsort(place, kind="stable")]
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    ends = np.cumsum(sizes)
    apart, links = len(root), []
    for i in range(firsts):
        if apart == 1:
            break
        mine = place[ends[i] - sizes[i] : ends[i]]
        mine = mine[count[mine] > 1]
        lengths = count[mine]
        if not len(mine):
            continue
        first = np.repeat(start[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        shared = np.bincount(by_place[first + np.arange(len(first))], minlength=len(sets))
        near = 100 * shared >= PERCENT * (sizes[i] + sizes - shared)
        near[: i + 1] = False
        for j in np.flatnonzero(near):
            a, b = find(trees[i]), find(trees[j])
            if a != b and (bands[i] is None or (bands[i] == bands[j]).any()):
                root[max(a, b)] = min(a, b)
                apart -= 1
                links.append((trees[i], trees[j]))
    return links


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, i, j, behind, tree, hashes, bands): a block pair's together, ``behind`` last."""
    block, firsts, trees, sets, bands = None, 0, [], [], []

    def links() -> pa.RecordBatch:
        found = linked_in_block(trees, sets, bands, firsts)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        behind, of = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for i, key in enumerate(keys):
            if key != block:
                if len(trees) > 1:
                    yield links()
                block, firsts, trees, sets, bands = key, 0, [], [], []
            firsts += not behind[i]
            trees.append(of[i])
            sets.append(batch.column(5)[i].values.to_numpy())
            band = batch.column(6)[i]
            bands.append(band.values.to_numpy() if band.is_valid else None)
    if len(trees) > 1:
        yield links()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when they agree in a band and 100 * intersection >= 75 * union of
    their shingle sets; component_id is the smallest doc_id reachable over links. Null and
    empty texts, and those of white space alone, have no shingles and link with nothing.
    Repeated rows of a doc_id each give a row; where their texts differ each goes by its
    own. A row without doc_id links with nothing, has no component and is kept. An empty
    table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    signed = materialize(
        docs.mapInArrow(
            _sign, "doc_id long, n_shingles long, digest binary, bands array<long>"
        ),
        "signed",
    )
    # equal sets: one node each
    classes = materialize(
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    members = _bucket_members(classes)
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = materialize(
        texts.mapInArrow(_hashes, "digest binary, hashes array<long>")
        .dropDuplicates(["digest"])
        .join(wanted.select("digest", "node", "n", "bands"), "digest")
        .drop("digest"),
        "sets",
    )
    labels = connected_components(_links(members, sets))
    linked = materialize(
        classes.select("node", "rep").join(labels, "node").select("node", "component", "rep"), "linked"
    )
    smallest = linked.groupBy("component").agg(F.min("rep").alias("smallest"))
    of_class = (
        classes.select("digest", "node", "rep")
        .join(linked.join(smallest, "component").select("node", "smallest"), "node", "left")
        .select("digest", F.coalesce("smallest", "rep").alias("component"))
    )
    found = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(
        F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")
    ).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Rows that share a doc_id go together, when none of them is kept.
    """
    of_id = near_duplicates(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept"))
    dropped = of_id.filter("not _kept")
    return docs.join(dropped, docs["doc_id"] == dropped["_id"], "left_anti")


def _bucket_members(classes: DataFrame) -> DataFrame:
    """(band, node, n, pivot): the nodes of each band key that several share; ``pivot`` is the smallest."""
    keys = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = (
        keys.groupBy("band")
        .agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
        .filter("pivot <> last")
        .select("band", "pivot")
    )
    return materialize(keys.join(shared, "band"), "members")


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): confirmed links that connect all candidates which links connect.

    Candidates that hang together over shared bands form a group. A group that fits a
    block is compared in one task. The documents of a larger one are compared with a pivot
    each; then, bucket by bucket, those that this left apart are compared with all others.
    """
    hang = connected_components(
        members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    )
    placed = materialize(
        members.select("node", "n").distinct().join(hang, "node"), "placed"
    )
    sizes = materialize(placed.groupBy("component").agg(F.sum("n").alias("size")), "sizes")
    small = sizes.filter(F.col("size") <= BLOCK_SHINGLES)
    whole = placed.join(small, "component").select(
        F.col("component").alias("group"),
        F.lit(0).alias("i"),
        F.lit(0).alias("j"),
        F.lit(False).alias("behind"),
        F.col("node").alias("tree"),
        "node",
    )
    links = materialize(_compared(whole.join(sets.select("node", "hashes", "bands"), "node")), "links")
    large = sizes.filter(F.col("size") > BLOCK_SHINGLES)
    if large.isEmpty():
        return links
    nodes = placed.join(large, "component").select("node")
    in_buckets = materialize(members.join(nodes, "node"), "large")
    to_pivots = materialize(_pivot_links(in_buckets, sets.select("node", "n", "hashes")), "pivots")
    rest = _apart(in_buckets, connected_components(to_pivots))
    no_bands = F.lit(None).cast("array<long>").alias("bands")  # a bucket shares one
    left = materialize(_compared(rest.join(sets.select("node", "hashes", no_bands), "node")), "links")
    return links.unionByName(to_pivots).unionByName(left)


def _compared(rows: DataFrame) -> DataFrame:
    """Links of rows (group, i, j, behind, tree, hashes, bands), a block pair in one task."""
    return (
        rows.select("group", "i", "j", "behind", "tree", "hashes", "bands")
        .repartition("group", "i", "j")
        .sortWithinPartitions("group", "i", "j", "behind")
        .mapInArrow(_link_blocks, "a long, b long")
    )


def _pivot_links(in_buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of nodes with the smallest node they share a bucket with.

    The pivot's set is copied once for every so many nodes, so that a pivot of very many
    is no task of its own.
    """
    pairs = in_buckets.groupBy("node").agg(F.min("pivot").alias("pivot")).filter("node <> pivot")
    copies = F.ceil(F.count("*") / ROWS_PER_COPY).alias("copies")
    dealt = materialize(pairs.join(pairs.groupBy("pivot").agg(copies), "pivot"), "pairs")
    pivots = dealt.select("pivot", "copies").distinct().join(
        sets.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("hashes").alias("others")),
        "pivot",
    )
    pivots = pivots.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    both = F.size(F.array_intersect("hashes", "others"))
    return (
        dealt.withColumn("copy", F.pmod(F.xxhash64("node"), "copies"))
        .join(sets, "node")
        .join(pivots.drop("copies"), ["pivot", "copy"])
        .filter(100 * both >= PERCENT * (F.col("n") + F.col("m") - both))
        .select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    )


def _apart(in_buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(group, i, j, behind, tree, node): blocks of the buckets that hold several trees.

    Nodes of a bucket's largest tree need no comparison with each other: they are dealt to
    blocks behind, the others to blocks in front, and every pair of blocks is laid out
    that has one in front.
    """
    tree = F.coalesce("component", "node").alias("tree")
    rows = materialize(
        in_buckets.join(labels, "node", "left").select(F.col("band").alias("group"), "node", "n", tree),
        "trees",
    )
    by_tree = rows.groupBy("group", "tree").agg(F.sum("n").alias("size"))
    largest = F.max(F.struct("size", "tree")).alias("largest")

    def blocks(size: Column) -> Column:
        return F.ceil(size / BLOCK_SHINGLES).cast("int")

    # written, so that Spark may split the rows of a hot bucket in the join
    mixed = materialize(
        by_tree.groupBy("group")
        .agg(largest, F.sum("size").alias("total"), F.count("*").alias("trees"))
        .filter("trees > 1")
        .select(
            "group",
            F.col("largest.tree").alias("largest"),
            blocks(F.col("total") - F.col("largest.size")).alias("front"),
            blocks(F.col("largest.size")).alias("back"),
        ),
        "mixed",
    )
    behind = (F.col("tree") == F.col("largest")).alias("behind")
    dealt = rows.join(mixed, "group").select("group", "node", "tree", "front", "back", behind)
    draw = F.xxhash64("node", F.lit(2))
    mine = F.when(F.col("behind"), F.col("front") + F.pmod(draw, "back")).otherwise(F.pmod(draw, "front"))
    others = F.when(F.col("behind"), F.col("front")).otherwise(F.col("front") + F.col("back"))
    return dealt.withColumn("mine", mine.cast("int")).select(
        "group",
        "behind",
        "tree",
        "node",
        F.explode(F.sequence(F.lit(0), others - 1)).alias("other"),
        "mine",
    ).select(
        "group",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        "behind",
        "tree",
        "node",
    )
