"""Approximate nearest neighbours by inner product with a forest of hash-prefix trees.

The largest inner product becomes the smallest angle: a row gets one more component, so that all rows have the length of
the longest one, and a query gets a zero. Each tree gives a vector a long string of bits, the sides of random planes that
it lies on, so vectors at a small angle share long prefixes. A tree is its strings in sorted order, cut into cells at
fixed strings and, where a cell is large, into blocks; rows that share a prefix are neighbours in each block's array.

A query descends in all trees to its longest prefix matches and ascends in all of them at once, until enough rows share
its prefix in some tree. Where it stops is read off a bounded sample of rows, which has the same strings; how much is
enough is the least that finds RECALL of the true neighbours of a bounded sample of queries, which are compared with
all rows. Then each query asks the blocks that its prefixes reach, and gets the nearest rows of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunlake.llm.common import binary, blobs, rows, ship_package, shuffle_partitions, stored

NEIGHBOURS = 20
QUERY_STEP = 20
TREES = 12
#: Length of a tree's strings.
BITS = 48
#: Rows whose strings say where queries stop and where cells are cut; all of a smaller table.
SAMPLE_VECTORS = 16_384
#: Queries compared with all rows, to find out how far to ascend.
SAMPLE_QUERIES = 128
#: Share of true neighbours that the search must find for the sampled queries; above 0.9, as samples err.
RECALL = 0.95
#: Rows of a cell, and cells of a tree at most; larger cells are cut into blocks of that many rows.
CELL_VECTORS = 8192
MAX_CELLS = 1024
SEED = 20240502


class Planes:
    """Random planes of all trees, and the length of the longest row."""

    def __init__(self, dims: int, longest: float, trees: int):
        self.dims, self.longest, self.trees = dims, longest, trees
        planes = np.random.Generator(np.random.PCG64(SEED)).normal(size=(dims + 1, trees * BITS))
        self.planes, self.last = planes[:dims], planes[dims]
        self.weights = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)

    def strings(self, vectors: np.ndarray, rows_: bool) -> np.ndarray:
        """The string of each vector in each tree as a number of BITS bits, the first plane in the highest one."""
        scaled = vectors / self.longest if self.longest else vectors
        side = scaled @ self.planes
        if rows_:
            side += np.sqrt(np.maximum(1.0 - (scaled * scaled).sum(axis=1), 0.0))[:, None] * self.last
        bits = (side >= 0).reshape(len(vectors), self.trees, BITS)
        return (bits * self.weights).sum(axis=2, dtype=np.uint64).astype(np.int64)


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


class Fit:
    """What samples say: where cells are cut, and at which prefix length a query stops."""

    def __init__(self, planes: Planes, sample: np.ndarray, n_vectors: int):
        self.planes, self.n = planes, n_vectors
        strings = planes.strings(sample, True)
        self.sorted = [np.sort(strings[:, t]) for t in range(planes.trees)]
        cells = min(MAX_CELLS, max(1, -(-n_vectors // CELL_VECTORS)))
        # Strings at which cells begin; equal ones are one cell.
        at = np.arange(1, cells) * len(sample) // cells
        self.cuts = [np.unique(s[at]) for s in self.sorted]
        self.wanted, self.deeper = 1, 0

    def counts(self, strings: np.ndarray) -> np.ndarray:
        """For each query and prefix length, 0 to BITS, the sampled rows that share it, over all trees."""
        out = np.zeros((len(strings), BITS + 1), np.int64)
        for t, ordered in enumerate(self.sorted):
            for length in range(BITS + 1):
                low, high = self.reach(strings[:, t], length)
                found = np.searchsorted(ordered, high, "right") - np.searchsorted(ordered, low)
                out[:, length] += found
                if not found.any():
                    break
        return out

    @staticmethod
    def reach(strings: np.ndarray, length: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last string with the same prefix."""
        rest = np.int64(BITS) - length
        low = strings >> rest << rest
        return low, low + (np.int64(1) << rest) - 1

    def stops(self, counts: np.ndarray, wanted: int, deeper: int) -> np.ndarray:
        """Longest prefix that ``wanted`` sampled rows share, then ``deeper`` bits more; 0 takes all rows."""
        enough = counts >= wanted
        longest = BITS - enough[:, ::-1].argmax(axis=1)
        return np.where(enough.any(axis=1), np.minimum(longest + deeper, BITS), 0)

    def levels(self, strings: np.ndarray) -> np.ndarray:
        return self.stops(self.counts(strings), self.wanted, self.deeper)

    def learn(self, queries: np.ndarray, near: list[np.ndarray]) -> None:
        """Choose the least ascent that reaches RECALL of the true neighbours of sampled queries."""
        total = sum(map(len, near))
        if not total:
            return
        strings = self.planes.strings(queries, False)
        counts = self.counts(strings)
        shared = [shared_bits(self.planes.strings(v, True), s).max(axis=1) if len(v) else np.zeros(0, np.int64) for v, s in zip(near, strings, strict=True)]
        # below the sample's resolution by whole bits, above it by half steps of its counts
        ladder = [(1, d) for d in range(BITS, 0, -1)] + [(int(2 ** (k / 2)), 0) for k in range(2 * (len(self.sorted[0]) * len(self.sorted)).bit_length() + 2)]
        for self.wanted, self.deeper in ladder:
            stops = self.stops(counts, self.wanted, self.deeper)
            if sum(int((s >= stop).sum()) for s, stop in zip(shared, stops, strict=True)) >= RECALL * total:
                return


def _matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones padded by zeros."""
    out = np.zeros((len(column), dims))
    for i, raw in enumerate(column.to_pylist()):
        values = np.frombuffer(raw, kind)
        out[i, : len(values)] = values
    return out


_PACKED = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("norm", pa.float64()), ("dims", pa.int32())])


def _packed(kind: str):
    """Vectors as bytes; negative zeros become zeros, so that equal vectors have equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False) + 0.0
            parts = [values[a:b].astype(kind) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            norms = [float(np.linalg.norm(p.astype(np.float64))) for p in parts]
            yield rows(_PACKED, [batch.column("vec_id"), blobs([binary(p) for p in parts]), norms, np.diff(bounds).astype(np.int32)])

    return run


def _best(queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], size: int) -> Iterator[tuple[int, int, float, int, bool]]:
    """The nearest rows of each query among distinct vectors: (query, id, score, place of the vector, equal to the query).

    At least the ``size`` best by score, then smaller id, are among them; a vector's ids are its smallest ones in order.
    """
    first = np.array([i[0] for i in ids])
    for low in range(0, len(queries), 256):
        block = queries[low : low + 256]
        rough = block @ vectors.T
        keep = min(size, len(vectors))
        for q, scores in enumerate(rough):
            cut = np.partition(scores, len(scores) - keep)[len(scores) - keep]
            # products of matrices round otherwise than sums of one row; near the cut all rows are looked at
            at = np.flatnonzero(scores >= cut - 1e-12 * np.abs(scores).max())
            exact = (vectors[at] * block[q]).sum(axis=1)
            for k in np.lexsort((first[at], -exact))[:size].tolist():
                same = bool((vectors[at[k]] == block[q]).all())
                for i in ids[at[k]]:
                    yield low + q, i, float(exact[k]), int(at[k]), same


_TRUE = pa.schema([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()), ("vector", pa.binary())])


def _compared(queries: np.ndarray, kind: str, dims: int, size: int):
    """Nearest rows of each batch for the sampled queries, without those equal to a query, which any search finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("vector").to_pylist()
            found = _best(queries, _matrix(batch.column("vector"), kind, dims), batch.column("ids").to_pylist(), size + 1)
            found = [f for f in found if not f[4]]
            yield rows(_TRUE, [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found], blobs([raw[f[3]] for f in found])])

    return run


_PLACED = pa.schema([("tree", pa.int32()), ("cell", pa.int32()), ("string", pa.int64()), ("draw", pa.int64()), ("ids", pa.list_(pa.int64())), ("vector", pa.binary())])
_PLACED_DDL = "tree int, cell int, string long, draw long, ids array<long>, vector binary"
_CELLS = pa.schema([("tree", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])


def _cells_of(fit: Fit, strings: np.ndarray, t: int) -> np.ndarray:
    return np.searchsorted(fit.cuts[t], strings[:, t], "right")


def _counted(fit: Fit, kind: str):
    """Rows of each cell, once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = fit.planes.strings(_matrix(batch.column("vector"), kind, fit.planes.dims), True)
            for t in range(fit.planes.trees):
                cells, n = np.unique(_cells_of(fit, strings, t), return_counts=True)
                yield rows(_CELLS, [np.full(len(cells), t, np.int32), cells.astype(np.int32), n])

    return run


def _placed(fit: Fit, kind: str):
    """Every row at its place in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                here = batch.slice(low, 4096)
                strings = fit.planes.strings(_matrix(here.column("vector"), kind, fit.planes.dims), True)
                for t in range(fit.planes.trees):
                    cells = _cells_of(fit, strings, t).astype(np.int32)
                    yield rows(_PLACED, [np.full(len(cells), t, np.int32), cells, strings[:, t], here.column("draw"), here.column("ids"), here.column("vector")])

    return run


_ASKED = pa.schema([("tree", pa.int32()), ("cell", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("query", pa.binary()), ("vector", pa.binary())])
_ASKED_DDL = "tree int, cell int, low long, high long, query binary, vector binary"


def _asked(fit: Fit, kind: str):
    """Every query at the cells that its prefixes reach; one that takes all rows asks one tree only.

    ``climb`` is how many bits higher than fitted a query stops.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low_row in range(0, batch.num_rows, 1024):
                here = batch.slice(low_row, 1024)
                strings = fit.planes.strings(_matrix(here.column("vector"), kind, fit.planes.dims), False)
                stops = np.maximum(fit.levels(strings) - here.column("climb").to_numpy(), 0)
                for t in range(fit.planes.trees):
                    asks = np.flatnonzero((stops > 0) | (t == 0))
                    low, high = Fit.reach(strings[asks, t], stops[asks])
                    first, last = np.searchsorted(fit.cuts[t], low, "right"), np.searchsorted(fit.cuts[t], high, "right")
                    n = last - first + 1
                    who = np.repeat(np.arange(len(asks)), n)
                    cells = (np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())).astype(np.int32)
                    taken = here.take(pa.array(asks[who]))
                    yield rows(_ASKED, [np.full(len(who), t, np.int32), cells, low[who], high[who], taken.column("query"), taken.column("vector")])

    return run


_FOUND = pa.schema([("query", pa.binary()), ("vec_id", pa.int64()), ("draw", pa.int64()), ("score", pa.float64()), ("same", pa.bool_())])


def _searched(kind: str, dims: int, size: int):
    """Nearest rows of each block for the queries that reach it.

    Rows come sorted by block, first the block's rows by their string, which are held, then its queries by their prefix;
    queries of one prefix see the same part of the sorted array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, strings, vectors, ids, draws, parts = None, None, None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in ("tree", "cell", "block")]
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            lows, highs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("string", "high"))
            change = np.ones(batch.num_rows, bool)
            change[1:] = asks[1:] != asks[:-1]
            for c in names:
                change[1:] |= c[1:] != c[:-1]
            change[1:] |= asks[1:] & ((lows[1:] != lows[:-1]) | (highs[1:] != highs[:-1]))
            edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(int(c[a]) for c in names)
                if now != key:
                    key, parts, vectors = now, [], None
                here = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append((lows[a:b], _matrix(here.column("vector"), kind, dims), here.column("ids").to_pylist(), here.column("draw").to_pylist()))
                    continue
                if vectors is None:
                    strings = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                    vectors = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, dims))
                    ids, draws = [i for p in parts for i in p[2]], [d for p in parts for d in p[3]]
                    parts = []
                first, last = np.searchsorted(strings, lows[a]), np.searchsorted(strings, highs[a], "right")
                if first < last:
                    names_ = here.column("query").to_pylist()
                    found = list(_best(_matrix(here.column("vector"), kind, dims), vectors[first:last], ids[first:last], size))
                    yield rows(_FOUND, [[names_[f[0]] for f in found], [f[1] for f in found], [draws[first + f[3]] for f in found], [f[2] for f in found], [f[4] for f in found]])

    return run


def _smallest_ids(whole: DataFrame, size: int) -> DataFrame:
    """Distinct vectors with their smallest ids: more than a query can return of one vector, itself included, are of no use."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = whole.select("vec_id", "vector").distinct().withColumn("place", place).where(F.col("place") <= size)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("draw", F.xxhash64("vector"))


def _search(queries: DataFrame, index: DataFrame, fit: Fit, blocks: DataFrame, kind: str, size: int) -> DataFrame:
    """The ``size`` nearest rows found for each of (query, vector, climb), by score, then smaller id."""
    spark = queries.sparkSession
    # One row a cell, TREES * MAX_CELLS at most.
    rows_ = index.mapInArrow(_placed(fit, kind), _PLACED_DDL).join(F.broadcast(blocks), ["tree", "cell"])
    rows_ = rows_.withColumn("block", F.pmod("draw", "blocks").cast("int"))
    asks = queries.mapInArrow(_asked(fit, kind), _ASKED_DDL).join(F.broadcast(blocks), ["tree", "cell"])
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    none, keys = F.lit(None), ["tree", "cell", "block"]
    both = rows_.select(*keys, F.lit(False).alias("asks"), "string", F.lit(0).cast("long").alias("high"), none.cast("binary").alias("query"), "draw", "ids", "vector").unionByName(
        asks.select(*keys, F.lit(True).alias("asks"), F.col("low").alias("string"), "high", "query", none.cast("long").alias("draw"), none.cast("array<long>").alias("ids"), "vector")
    )
    both = both.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "asks", "string", "high")
    found = both.mapInArrow(_searched(kind, fit.planes.dims, size), "query binary, vec_id long, draw long, score double, same boolean")
    once = found.groupBy("query", "vec_id", "draw").agg(F.max("score").alias("score"), F.max("same").alias("same"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "draw")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def _fitted(index: DataFrame, queries: DataFrame, kind: str, dims: int, longest: float, n: int, size: int) -> Fit:
    """Planes, cells and the ascent, from SAMPLE_VECTORS rows and SAMPLE_QUERIES queries, drawn by hash."""
    drawn = index.select("vector").orderBy("draw", "vector").limit(SAMPLE_VECTORS).toArrow().column("vector").combine_chunks()
    fit = Fit(Planes(dims, longest, TREES), _matrix(drawn, kind, dims), n)
    asked = queries.select("vector").orderBy("query").limit(SAMPLE_QUERIES).toArrow().column("vector").combine_chunks()
    if not len(asked):
        return fit
    sampled = _matrix(asked, kind, dims)
    true = index.select("ids", "vector").mapInArrow(_compared(sampled, kind, dims, size), "query int, vec_id long, score double, vector binary")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    true = true.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("query", "vector").toArrow()
    of, near = true.column("query").to_numpy(), _matrix(true.column("vector").combine_chunks(), kind, dims)
    fit.learn(sampled, [near[of == q] for q in range(len(sampled))])
    return fit


def nearest_neighbours(vectors: DataFrame, is_query: Column | None = None, size: int = NEIGHBOURS) -> DataFrame:
    """The nearest rows by inner product of each query: (query_id, rank, vec_id, score), ``size`` for each, nearest first.

    ``vectors`` has vec_id and embedding; queries are the rows that ``is_query`` holds for, by default those whose vec_id
    is divisible by QUERY_STEP. Candidates are all rows but the query's own. Scores are sums in double
    precision over the given components, a shorter vector counting as padded by zeros; ties go to the smaller vec_id.
    Rows whose id or vector is null, or whose vector is empty, zero or holds null or non-finite components, take no part.
    Repeated rows of an id with an equal vector are one; one id with different vectors is as many rows, each of which
    asks and is found. Other columns don't matter, an empty table gives no rows. A query gets fewer than ``size`` rows
    only if there are no more.

    The search is approximate: its recall is fitted on SAMPLE_QUERIES queries (see RECALL) and every row is indexed. Of an
    equal vector only as many ids as a query can return go into the trees, and equal queries ask once, so copies are no
    load. Queries that found too few rows ask again with shorter prefixes, at last with all rows.
    """
    spark = vectors.sparkSession
    ship_package(vectors)
    # floats keep their size; their products are taken in doubles
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    asks = F.coalesce(is_query if is_query is not None else F.col("vec_id") % QUERY_STEP == 0, F.lit(False))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), asks.alias("asks"))
    fit_rows = "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)"
    packed = _packed(kind)
    whole, asked = (
        stored(part.select("vec_id", "embedding").mapInArrow(packed, "vec_id long, vector binary, norm double, dims int"), name)
        for part, name in ((given.where(fit_rows), "ann-vectors"), (given.where(fit_rows).where("asks"), "ann-queries"))
    )
    # one more than asked for, as a query's own row is among them
    most = size + 1
    index = stored(_smallest_ids(whole, most), "ann-index")
    longest, dims = whole.agg(F.max("norm"), F.max("dims")).first()
    n, n_rows = index.agg(F.count("*"), F.sum(F.size("ids"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named = asked.select(F.col("vec_id").alias("query_id"), F.unhex(F.sha2("vector", 256)).alias("query"), "vector")
    queries = named.select("query", "vector").distinct()
    fit = _fitted(index, queries, kind, dims, longest, n, size)
    blocks = index.mapInArrow(_counted(fit, kind), "tree int, cell int, n long").groupBy("tree", "cell").agg(F.ceil(F.sum("n") / CELL_VECTORS).cast("int").alias("blocks"))
    blocks = stored(blocks, "ann-cells")
    climb, done = 0 if n_rows > most else BITS, None
    while True:
        found = stored(_search(queries.withColumn("climb", F.lit(climb)), index, fit, blocks, kind, most), "ann-found")
        enough = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        last = climb >= BITS
        if not last:
            queries = stored(queries.join(enough, "query", "left_anti").select("query", "vector"), "ann-short")
            last = queries.isEmpty()
            found = found.join(enough.select("query"), "query", "left_semi")
        done = found if done is None else done.unionByName(found)
        if last:
            break
        climb = BITS if climb else BITS // 4
    lists = done.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: ~(f["same"] & (f["vec_id"] == F.col("query_id")))), 1, size)
    answers = named.select("query_id", "query").distinct().join(lists, "query").select("query_id", F.posexplode(others).alias("at", "f"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
