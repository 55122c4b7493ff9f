"""Exact near-duplicate join of vectors: pivots cut each label into cells, the triangle inequality sets who is copied where.

Vectors of length one have cosine c exactly if their distance is sqrt(2 - 2 c), so the join is a range join of radius
RADIUS. A vector lives in the cell of its nearest pivot. A neighbour within the radius of a vector of cell p is nearer
to p than to its own pivot by no more than the hyperplane bound allows, so only such vectors are copied into cell p.
Within a cell the distances to its pivot bound the distance of two vectors from below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.llm.common import binary, blobs, rows, ship_package, shuffle_partitions, stored
from dunlake.llm.graph import components

MIN_COSINE = 0.93
#: Vectors that a cell should have; a label gets that many fewer pivots than vectors, MAX_PIVOTS at most.
CELL_VECTORS = 2048
#: Pivots of all labels are in every task, so their number is bounded; larger cells are cut into blocks.
MAX_PIVOTS = 1024
#: Vectors of a cell whose neighbours one task looks for.
BLOCK_VECTORS = 4096
#: Slack of the bounds against rounding; the threshold itself has none.
SLACK = 1e-6


_UNITS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("unit", pa.binary())])


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length one; scaled first, so that squares neither overflow nor vanish."""
    for batch in batches:
        dims, units = [], []
        for vector in batch.column("embedding"):
            values = vector.values.to_numpy(zero_copy_only=False) + 0.0
            values = values / np.abs(values).max()
            dims.append(len(values))
            units.append(binary(values / np.sqrt(values @ values) + 0.0))
        yield rows(_UNITS, [batch.column("vec_id"), batch.column("label"), dims, blobs(units)])


class Pivots:
    """Unit vectors by (label, number of components), sorted by id."""

    def __init__(self, found: list[tuple[int, int, bytes]]):
        by: dict[tuple[int, int], list[np.ndarray]] = {}
        for label, dims, unit in found:
            by.setdefault((label, dims), []).append(np.frombuffer(unit, np.float64))
        self.units = {key: np.array(units) for key, units in by.items()}
        self.apart = {key: np.sqrt(np.maximum(2 - 2 * (u @ u.T), 0)) for key, u in self.units.items()}


_CELLS = pa.schema(
    [("label", pa.int64()), ("dims", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("class_id", pa.int64()), ("weight", pa.int64()), ("to_pivot", pa.float64()), ("unit", pa.binary())]
)
_CELLS_DDL = "label long, dims int, cell int, home boolean, class_id long, weight long, to_pivot double, unit binary"


def _placed(pivots: Pivots, radius: float):
    """Each vector at home in the cell of its nearest pivot, and copied into the cells that its neighbours may live in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), batch.column("dims").to_numpy()
            for label, size in sorted(set(zip(labels.tolist(), dims.tolist(), strict=True))):
                at = np.flatnonzero((labels == label) & (dims == size))
                here = batch.take(pa.array(at))
                units = np.frombuffer(b"".join(here.column("unit").to_pylist()), np.float64).reshape(-1, size)
                centres, apart = pivots.units[label, size], pivots.apart[label, size]
                for low in range(0, len(at), 1024):
                    block = units[low : low + 1024]
                    square = np.maximum(2 - 2 * (block @ centres.T), 0)
                    home = square.argmin(axis=1)
                    nearest = square[np.arange(len(block)), home]
                    # distance to the plane between the two pivots, a lower bound of the distance to any vector of that cell
                    gap = apart[home]
                    bound = np.where(gap > SLACK, (square - nearest[:, None]) / np.maximum(2 * gap, SLACK), 0.0)
                    who, cell = np.nonzero((bound <= radius + SLACK) | (np.arange(len(centres)) == home[:, None]))
                    taken = here.slice(low, len(block)).take(pa.array(who))
                    columns = [taken.column("label"), taken.column("dims"), cell.astype(np.int32), cell == home[who], taken.column("class_id"), taken.column("weight"), np.sqrt(square[who, cell]), taken.column("unit")]
                    yield rows(_CELLS, columns)

    return run


_FOUND = pa.schema([("class_id", pa.int64()), ("n_links", pa.int64()), ("other_id", pa.int64())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of the asking vectors of each block: the number of vectors linked, and links for the graph.

    Rows come sorted by (label, dims, cell, block), asking vectors first, then by the distance to the pivot. Asking
    vectors are held, the others pass by; of links only a forest over the asking vectors and one link of each vector that
    passes by are kept.
    """
    key, block = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("label", "dims", "cell", "block")]
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[1:] |= asks[1:] != asks[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(int(c[a]) for c in columns)
            if now != key:
                if block is not None:
                    yield block.result()
                key, block = now, _Block()
            for low in range(a, b, 4096):
                part = batch.slice(low, min(4096, b - low))
                if asks[a]:
                    block.hold(part)
                else:
                    yield from block.compare(part)
    if block is not None:
        yield block.result()


class _Block:
    """Asking vectors of a block, in order of their distance to the pivot."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.ready = False

    @staticmethod
    def columns(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        units = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(-1, part.column("dims")[0].as_py())
        return units, part.column("class_id").to_numpy(), part.column("weight").to_numpy(), part.column("to_pivot").to_numpy()

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(self.columns(part))

    def start(self) -> None:
        if self.ready:
            return
        self.ready = True
        self.units, self.ids, self.weight, self.near = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.links = np.zeros(len(self.ids), np.int64)
        self.forest = np.arange(len(self.ids))
        for low in range(0, len(self.ids), 512):
            hit = self.units[low : low + 512] @ self.units.T >= MIN_COSINE
            rows_ = np.arange(low, low + len(hit))
            hit[np.arange(len(hit)), rows_] = False
            self.links[rows_] += hit @ self.weight
            i, j = np.nonzero(hit)
            _join(self.forest, i + low, j)
        self.links += self.weight - 1  # exact copies

    def compare(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.start()
        units, ids, weight, near = self.columns(part)
        radius = np.sqrt(2 - 2 * MIN_COSINE) + SLACK
        low, high = np.searchsorted(self.near, near.min() - radius), np.searchsorted(self.near, near.max() + radius, "right")
        for at in range(int(low), int(high), 512):
            end = min(at + 512, int(high))
            hit = units @ self.units[at:end].T >= MIN_COSINE
            self.links[at:end] += weight @ hit
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            # neighbours of one vector are in one tree
            first = np.concatenate(([0], np.flatnonzero(i[1:] != i[:-1]) + 1))
            leader = np.repeat(j[first], np.diff(np.append(first, len(i))))
            _join(self.forest, j + at, leader + at)
            yield rows(_FOUND, [ids[i[first]], np.zeros(len(first), np.int64), self.ids[j[first] + at]])

    def result(self) -> pa.RecordBatch:
        if not self.parts:
            return rows(_FOUND, [[], [], []])
        self.start()
        return rows(_FOUND, [self.ids, self.links, self.ids[_tops(self.forest)]])


def _tops(forest: np.ndarray) -> np.ndarray:
    top = forest
    while True:
        above = top[top]
        if (above == top).all():
            return top
        top = above


def _join(forest: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of linked vectors; links inside one tree cost nothing."""
    while len(a):
        forest[:] = _tops(forest)
        ra, rb = forest[a], forest[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            np.minimum.at(forest, np.maximum(ra, rb), np.minimum(ra, rb))


def _pivots(classes: DataFrame) -> list[tuple[int, int, bytes]]:
    """Vectors with the smallest hashes, by label and number of components: at least one each, MAX_PIVOTS or so in all."""
    spark = classes.sparkSession
    sizes = {(r[0], r[1]): r[2] for r in classes.groupBy("label", "dims").count().collect()}
    wanted = {k: max(1, n // CELL_VECTORS) for k, n in sizes.items()}
    share = min(1.0, MAX_PIVOTS / max(1, sum(wanted.values())))
    wanted = {k: max(1, int(n * share)) for k, n in wanted.items()}
    if not wanted:
        return []
    counts = spark.createDataFrame([(*k, n, sizes[k]) for k, n in wanted.items()], "label long, dims int, pivots long, vectors long")
    draw = F.pmod("class_id", F.lit(1 << 40))
    # A share of the hash range that holds about twice the pivots wanted; the smallest of them are taken.
    sample = classes.join(F.broadcast(counts), ["label", "dims"]).where(draw / float(1 << 40) <= (F.col("pivots") * 2 + 20) / F.col("vectors"))
    by: dict[tuple[int, int], list] = {}
    for row in sample.select("label", "dims", draw.alias("draw"), "class_id", "unit").collect():
        by.setdefault((row["label"], row["dims"]), []).append((row["draw"], row["class_id"], bytes(row["unit"])))
    found = [(*k, unit) for k, drawn in by.items() for _, _, unit in sorted(drawn)[: wanted[k]]]
    for label, dims in set(wanted) - set(by):  # no vector fell into the share: any one serves
        found.append((label, dims, bytes(classes.where((F.col("label") == label) & (F.col("dims") == dims)).first()["unit"])))
    return found


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Near-duplicates by cosine >= 0.93 within a label: (vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    ``vectors`` has vec_id, embedding and label. Vectors link only at equal labels that are not null and with equally many
    components. Null, empty or zero vectors, and those with null or non-finite components, link with nothing: n_links 0
    and the own id as component_id. n_links counts other rows linked directly, component_id is the smallest vec_id
    reachable, kept marks vec_id = component_id. Rows with equal vec_id are judged one by one; a row without vec_id links
    with nothing and has null component and kept. Cosines are dot products of unit vectors in double precision. Other
    columns don't matter.

    Equal vectors are one vector with a weight. Pivots are vectors with the smallest hashes, about one to CELL_VECTORS
    vectors and MAX_PIVOTS in all. A cell is joined in blocks of its home vectors, past which the cell's other vectors are
    read, so a large cell is work for many tasks; no pair is written, only counts, and a link a vector and block.
    """
    spark = vectors.sparkSession
    ship_package(vectors)
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    fit = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)"
    units = given.where(fit).mapInArrow(_unit_rows, "vec_id long, label long, dims int, unit binary")
    units = stored(units.withColumn("class_id", F.xxhash64("label", "dims", "unit")), "unit-vectors")
    classes = units.groupBy("class_id", "label", "dims", "unit").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first_id"))
    classes = stored(classes, "vector-classes")
    placed = stored(
        classes.select("label", "dims", "class_id", "weight", "unit").mapInArrow(_placed(Pivots(_pivots(classes)), float(np.sqrt(2 - 2 * MIN_COSINE))), _CELLS_DDL),
        "vector-cells",
    )
    keys = ["label", "dims", "cell"]
    homes = placed.groupBy(*keys).agg(F.sum(F.col("home").cast("long")).alias("homes")).where("homes > 0")
    homes = homes.select(*keys, F.ceil(F.col("homes") / BLOCK_VECTORS).cast("int").alias("blocks"))
    # One row a cell; there are MAX_PIVOTS and a cell for each label at most.
    dealt = placed.join(F.broadcast(homes), keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("asks", F.col("home") & (F.col("block") == F.pmod("class_id", "blocks").cast("int")))
    keys.append("block")
    ordered = dealt.select(*keys, "asks", "class_id", "weight", "to_pivot", "unit").repartition(shuffle_partitions(spark), *keys)
    ordered = ordered.sortWithinPartitions(*keys, F.desc("asks"), "to_pivot")
    found = stored(ordered.mapInArrow(_joined, "class_id long, n_links long, other_id long"), "vector-links")
    links = found.groupBy("class_id").agg(F.sum("n_links").alias("n_links"))
    trees = components(found.select(F.col("class_id").alias("a"), F.col("other_id").alias("b"))).withColumnRenamed("id", "class_id")
    treed = classes.select("class_id", "first_id").join(trees, "class_id", "left").withColumn("tree", F.coalesce("component_id", "class_id")).drop("component_id")
    smallest = treed.groupBy("tree").agg(F.min("first_id").alias("component_id"))
    judged = treed.join(smallest, "tree").join(links, "class_id").select("class_id", "n_links", "component_id")
    linked = units.join(judged, "class_id").select("vec_id", "n_links", "component_id")
    alone = given.where(f"not coalesce({fit}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
