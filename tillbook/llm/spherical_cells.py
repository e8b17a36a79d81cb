"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

Centroids are fitted on a bounded sample. Each vector is at home in the nearest cell and
visits every cell whose border it is so close to that a partner may live beyond: two unit
vectors with cosine c are at most sqrt(2 - 2c) apart, so at least one of a linked pair
lies within half of that of the border between their cells. The vectors at home in a cell
are compared with all that are in it, which finds all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.components import connected_components
from tillbook.plans.worktables import materialize

LEAST_COSINE = 0.9
#: Vectors the centroids are fitted on at most; all are assigned and compared.
SAMPLE_ROWS = 20_000
VECTORS_PER_CELL, MOST_CELLS, ROUNDS = 2_000, 64, 8
#: Numbers in the vectors on one side of a block product, and in the part held at a time.
BLOCK_VALUES, PRODUCT_VALUES = 1 << 22, 1 << 22



def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of ``sample`` (rows of length 1)."""
    rng = np.random.default_rng(11)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        home = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    return centroids


def cells_of(units: np.ndarray, centroids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and which cells it is in (home and visits) as booleans."""
    near = units @ centroids.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))[home]
    behind = near[np.arange(len(units)), home][:, None] - near
    inside = behind <= apart * (np.sqrt(2 - 2 * least) / 2) + 1e-9
    return home, inside


def _unit(batch_vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the vectors, and the rows as arrays of doubles of length 1."""
    rows = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in batch_vectors]
    units = []
    for v in rows:
        v = v / np.abs(v).max()
        units.append(v / np.sqrt(v @ v))
    return np.array([len(v) for v in rows], np.int64), units


def _assign(known, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = known.value
        for batch in batches:
            dims, units = _unit(batch.column(2))
            home, inside = np.zeros(len(dims), np.int32), [None] * len(dims)
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                if dim in centroids:
                    at, among = cells_of(np.array([units[i] for i in of]), centroids[dim], least)
                else:  # no vector of this length was in the sample: one cell
                    at, among = np.zeros(len(of), np.int32), np.ones((len(of), 1), bool)
                for i, h, a in zip(of, at, among, strict=True):
                    home[i], inside[i] = h, np.flatnonzero(a).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(dims.astype(np.int32)),
                    pa.array(home),
                    pa.array(inside, pa.list_(pa.int32())),
                    pa.array([_packed(v) for v in batch.column(2)], pa.binary()),
                ],
                names=["rep", "copies", "dim", "home", "inside", "packed"],
            )

    return run


def _packed(vector: pa.Scalar) -> bytes:
    """The bytes of the vector's numbers, of four bytes each if none loses by it."""
    wide = vector.values.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        narrow = wide.astype(np.float32)
    return (narrow if (narrow == wide).all() else wide).tobytes()


def _unpacked(packed: list[bytes], dim: int) -> np.ndarray:
    """The vectors as rows of length 1."""
    rows = np.empty((len(packed), dim))
    for k, v in enumerate(packed):
        rows[k] = np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


class Trees:
    """Union-find over the rows at home in a block."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return int(k)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def _near(homes: np.ndarray, guests: np.ndarray, rough: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``guests``, row of ``homes``) with a cosine of at least ``least``.

    Products of four-byte numbers leave out what is surely below; doubles decide the rest.
    """
    slack = 1e-5 + 2e-7 * homes.shape[1]
    close = guests.astype(np.float32) @ rough.T >= least - slack
    if close.mean() > 0.05:
        return np.nonzero(guests @ homes.T >= least)
    g, h = np.nonzero(close)
    sure = np.einsum("ij,ij->i", guests[g], homes[h]) >= least
    return g[sure], h[sure]


def linked(home: dict, guest: dict, cell: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``home`` and ``guest`` that have links: rep, copies linked, a row joined with it.

    A link counts for the row at home here. It counts for the guest as well unless the two
    also meet with the guest at home: in this cell, or in the guest's, which the other
    visits. The rows named as joined hold together what links of this block connect.
    """
    n, m = len(home["rep"]), len(guest["rep"])
    trees, anchor = Trees(n), np.full(m, -1)
    links, for_guest = np.zeros(n), np.zeros(m)
    rough = home["unit"].astype(np.float32)
    step = max(1, PRODUCT_VALUES // n)
    for start in range(0, m, step):
        g, h = _near(home["unit"], guest["unit"][start : start + step], rough, least)
        g += start
        other = guest["rep"][g] != home["rep"][h]
        g, h = g[other], h[other]
        if not len(g):
            continue
        np.add.at(links, h, guest["copies"][g])
        at = guest["home"][g]
        here_alone = (at != cell) & ~home["inside"][h, at]
        np.add.at(for_guest, g[here_alone], home["copies"][h[here_alone]])
        for pair in np.unique(g * n + trees.roots()[h]):
            of, tree = divmod(int(pair), n)
            if anchor[of] >= 0:
                trees.join(int(anchor[of]), tree)
            anchor[of] = tree
    roots = trees.roots()
    of_home = np.flatnonzero(links > 0)
    of_guest = np.flatnonzero(anchor >= 0)
    return (
        np.concatenate((home["rep"][of_home], guest["rep"][of_guest])),
        np.concatenate((links[of_home], for_guest[of_guest])).astype(np.int64),
        home["rep"][np.concatenate((roots[of_home], roots[anchor[of_guest]]))],
    )


def _compare(least: float, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block pair arrive together, maybe over several batches."""
        held, key = [], None

        def side(rows: pa.Table, dim: int) -> dict:
            among = np.zeros((rows.num_rows, cells), bool)
            for k, of in enumerate(rows.column("inside").to_pylist()):
                among[k, of or []] = True
            return {
                "rep": rows.column("rep").to_numpy(),
                "copies": rows.column("copies").to_numpy(),
                "home": rows.column("home").to_numpy(),
                "inside": among,
                "unit": _unpacked(rows.column("packed").to_pylist(), dim),
            }

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            guests = rows.column("guest").combine_chunks()
            home, guest = rows.filter(pc.invert(guests)), rows.filter(guests)
            dim, cell = key[0], key[1]
            found = linked(side(home, dim), side(guest, dim), cell, least) if home.num_rows else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in found], names=["rep", "links", "low"]
            )

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("dim", "cell", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if key is not None and tuple(keys[low]) != key:
                    yield done()
                    held = []
                key = tuple(keys[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield done()

    return run


def near_duplicates(
    vectors: DataFrame, least: float = LEAST_COSINE, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors are linked when their cosine in double precision reaches ``least``; those of
    different lengths never. A vector that is null, empty or zero, or holds a null or
    non-finite component, links with nothing. Equal vectors are compared once and counted
    as often as they come; a row without vec_id counts for nothing, has no component and
    is kept. Repeated rows each give a row and link with each other; rows of one vec_id
    with different vectors go each by its own. An empty table gives no rows. Labels and
    other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    plain = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    keyed = rows.withColumn("h1", F.xxhash64(plain)).withColumn("h2", F.xxhash64(F.lit(1), plain))
    classes = materialize(
        keyed.filter("fine")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies"), F.first("v").alias("v"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "vectors",
    )
    total = classes.count()
    share = min(1.0, sample_rows / max(1, total))
    dealt = F.pmod(F.xxhash64("h1", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)
    # the sample is bounded by the parameter
    dims, units = _unit(classes.filter(dealt).select("v").toArrow().column(0).combine_chunks())
    cells = int(np.clip(-(-total // VECTORS_PER_CELL), 1, MOST_CELLS))
    centroids = {
        int(d): fit_cells(np.array([u for u, x in zip(units, dims, strict=True) if x == d]), cells)
        for d in np.unique(dims)
    }
    known = spark.sparkContext.broadcast(centroids)
    assigned = materialize(
        classes.select("rep", "copies", "v").mapInArrow(
            _assign(known, least),
            "rep long, copies long, dim int, home int, inside array<int>, packed binary",
        ),
        "assigned",
    )
    rows_per_block = F.greatest(F.lit(BLOCK_VALUES) / F.col("dim"), F.lit(1))
    blocks = F.ceil(F.count("*") / F.first(rows_per_block)).cast("int")
    homes = assigned.groupBy("dim", F.col("home").alias("cell")).agg(blocks.alias("home_blocks"))
    present = assigned.withColumn("cell", F.explode("inside")).groupBy("dim", "cell")
    sizes = homes.join(present.agg(blocks.alias("guest_blocks")), ["dim", "cell"])

    def dealt_to(number: int, over: str) -> Column:
        return F.pmod(F.xxhash64("rep", F.lit(number)), F.col(over)).cast("int")

    def each(over: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(over) - 1))

    kept = ["dim", "cell", "i", "j", "guest", "rep", "copies", "home", "inside", "packed"]
    at_home = (
        assigned.withColumns({"cell": F.col("home"), "guest": F.lit(False)})
        .join(sizes, ["dim", "cell"])
        .withColumn("i", dealt_to(6, "home_blocks"))
        .withColumn("j", each("guest_blocks"))
    )
    as_guest = (
        assigned.withColumns({"cell": F.explode("inside"), "guest": F.lit(True)})
        .join(sizes, ["dim", "cell"])
        .withColumn("inside", F.lit(None).cast("array<int>"))
        .withColumn("j", dealt_to(7, "guest_blocks"))
        .withColumn("i", each("home_blocks"))
    )
    found = materialize(
        at_home.select(kept)
        .unionByName(as_guest.select(kept))
        .repartition("dim", "cell", "i", "j")
        .sortWithinPartitions("dim", "cell", "i", "j")
        .mapInArrow(_compare(least, cells), "rep long, links long, low long"),
        "found",
    )
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    # classes are told apart by number, since ids may repeat; components are named at the end
    placed = materialize(
        classes.select("rep", "smallest").join(labels.withColumnRenamed("node", "rep"), "rep"), "placed"
    )
    names = placed.groupBy("component").agg(F.min("smallest").alias("name"))
    of_class = (
        classes.select("h1", "h2", "rep", "smallest", "copies")
        .join(degrees, "rep", "left")
        .join(placed.join(names, "component").select("rep", "name"), "rep", "left")
        .select(
            "h1",
            "h2",
            F.lit(True).alias("fine"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("name", "smallest").alias("component_id"),
        )
    )
    out = keyed.select("vec_id", "h1", "h2", "fine").join(of_class, ["h1", "h2", "fine"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
