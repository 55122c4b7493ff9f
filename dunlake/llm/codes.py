"""Vector compression by product codes: each part of a vector becomes the index of its nearest codebook entry.

Assignment is exact and memoised by a grid: the part's coarse cell is hashed, and for each cell the entries that can be
nearest to a point of it are kept. An entry is left out if its least distance to the cell's box is greater than another
one's greatest distance, so no point of the box can have it as its nearest. Only the entries kept are evaluated for a part.

All numbers are integers, so sums and distances don't depend on the order of rows, tasks or machines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.llm.common import binary, blobs, rows, ship_package, stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors on which the side of the cells is chosen for the least work; any side gives the same codes.
FIT_VECTORS = 1024
#: Cells kept by a worker for each part; its memory starts anew beyond it.
CACHE_CELLS = 32_768
#: Vectors that a task codes at once.
BLOCK_VECTORS = 2048
#: Up to this size all sums are exact in doubles; vectors with larger components are compared with Python's integers.
LARGEST = 1 << 20
#: Vectors with a component from here on stay without a code, as sums of many would leave 38 digits.
TOO_LARGE = 1 << 62
#: Parts of one cell that are evaluated together, by one product of matrices.
TOGETHER = 16
#: Equal labels are summed once and joined in so many parts, as one label may hold a third of the rows.
LABEL_PARTS = 32


_QUANTISED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("large", pa.bool_()), ("vector", pa.binary())])


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as integers floor(SCALE * x): little-endian 32-bit ones, or decimal text if a component is large."""
    for batch in batches:
        column = batch.column("embedding")
        bounds = column.offsets.to_numpy()
        values = np.floor(column.values.to_numpy(zero_copy_only=False) * np.float64(SCALE))
        parts, large, dims = [], [], np.diff(bounds).astype(np.int32)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            vector = values[a:b]
            big = bool((np.abs(vector) > LARGEST).any())
            large.append(big)
            if big and (np.abs(vector) >= TOO_LARGE).any():
                dims[i] = -1
            parts.append(",".join(str(int(x)) for x in vector).encode() if big else binary(vector.astype("<i4")))
        yield rows(_QUANTISED, [batch.column("vec_id"), batch.column("label"), dims, large, blobs(parts)])


def _matrix(vectors: list[bytes], large: list[bool], dims: int) -> np.ndarray:
    """Vectors as rows of a matrix; of Python's integers if one of them is large."""
    if not any(large):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), dims).astype(np.int64)
    out = np.empty((len(vectors), dims), object)
    for i, (vector, big) in enumerate(zip(vectors, large, strict=True)):
        out[i] = [int(x) for x in vector.split(b",")] if big else np.frombuffer(vector, "<i4").tolist()
    return out


def part_bounds(dims: int) -> list[int]:
    """Where the parts begin and end; the first parts are one longer where the length is no multiple."""
    each, more = divmod(dims, PARTS)
    return [k * each + min(k, more) for k in range(PARTS + 1)]


class Cells:
    """Codebook of one part, and for each grid cell met so far the entries that can be nearest to a point in it."""

    def __init__(self, book: np.ndarray, grid: tuple[int, int]):
        self.book, (self.origin, self.side) = book, grid
        self.square = (book * book).sum(axis=1).astype(np.float64)
        self.number: dict[bytes, int] = {}
        self.kept: list[np.ndarray] = []

    def candidates(self, corner: np.ndarray) -> list[np.ndarray]:
        """Entries not dominated across the box of each cell, given the cells' lowest corners."""
        out = []
        step = max(1, (1 << 19) // max(1, self.book.size))
        for low in range(0, len(corner), step):
            box = corner[low : low + step, None, :]
            below, above = box - self.book, self.book - (box + self.side - 1)
            nearest = np.maximum(np.maximum(below, above), 0)
            farthest = np.maximum(np.abs(below), np.abs(above))
            least, most = (nearest * nearest).sum(axis=2), (farthest * farthest).sum(axis=2)
            mask = least <= most.min(axis=1)[:, None]
            out += [np.flatnonzero(row).astype(np.int16) for row in mask]
        return out

    def lists(self, parts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int]:
        """Cell of each part as a number in the lists of candidates, and how many cells were new."""
        cells = (parts - self.origin) // self.side
        coded = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        distinct, first, cell = np.unique(coded, return_index=True, return_inverse=True)
        names = [c.tobytes() for c in distinct]
        if len(self.kept) + len(names) > CACHE_CELLS:
            self.number, self.kept = {}, []
        new = [i for i, name in enumerate(names) if name not in self.number]
        if new:
            for i, kept in zip(new, self.candidates(cells[first[new]] * self.side + self.origin), strict=True):
                self.number[names[i]] = len(self.kept)
                self.kept.append(kept)
        return cell, [self.kept[self.number[name]] for name in names], len(new)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, of equally near ones the lowest, and its squared distance."""
        n = len(parts)
        index = np.zeros(n, np.int64)
        if not n or not parts.shape[1]:
            return index, np.zeros(n, np.int64)
        cell, lists, _ = self.lists(parts)
        members = np.bincount(cell, minlength=len(lists))
        order = np.argsort(cell, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(members)))
        for c in np.flatnonzero(members >= TOGETHER).tolist():
            rows_, kept = order[bounds[c] : bounds[c + 1]], lists[c]
            # the square of the part itself is the same for all entries
            score = self.square[kept] - 2 * (parts[rows_].astype(np.float64) @ self.book[kept].T.astype(np.float64))
            index[rows_] = kept[score.argmin(axis=1)]
        few = order[np.repeat(members < TOGETHER, members)]
        if len(few):
            sizes = np.array([len(x) for x in lists])
            step = max(1, (1 << 21) // (int(sizes.max()) * parts.shape[1]))
            starts, flat = np.concatenate(([0], np.cumsum(sizes)))[:-1], np.concatenate(lists).astype(np.int64)
            for low in range(0, len(few), step):
                rows_ = few[low : low + step]
                count = sizes[cell[rows_]]
                begin = np.cumsum(count) - count
                entry = flat[np.repeat(starts[cell[rows_]] - begin, count) + np.arange(count.sum())]
                apart = np.repeat(parts[rows_], count, axis=0) - self.book[entry]
                # index in the low bits: the least is the nearest, of equal ones the lowest index
                index[rows_] = np.minimum.reduceat((apart * apart).sum(axis=1) * ENTRIES + entry, begin) % ENTRIES
        return index, ((parts - self.book[index]) ** 2).sum(axis=1)


# Rough costs of a box and of an entry evaluated alone or together with others, and of a cell's own product.
_BOX, _ALONE, _JOINT, _PRODUCT = 6.0, 3.0, 0.2, 60.0


def fit_grid(book: np.ndarray, parts: np.ndarray) -> tuple[int, int]:
    """Origin and side of the cells with the least work on a sample, from one cell for all to one for each integer."""
    if not parts.size:
        return 0, 1
    origin = int(parts.min())
    side = 1 << int(parts.max() - origin + 1).bit_length()
    best = None
    while side >= 1:
        cell, lists, new = Cells(book, (origin, side)).lists(parts)
        sizes, members = np.array([len(x) for x in lists]), np.bincount(cell)
        joint = members >= TOGETHER
        work = _BOX * new * len(book) + (_JOINT * sizes * members + _PRODUCT)[joint].sum() + (_ALONE * sizes * members)[~joint].sum()
        if best is None or work < best[0]:
            best = (work, side)
        side //= 2
    return origin, best[1]


def _nearest_exact(book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with Python's integers, for components beyond LARGEST; no cells, as boxes would overflow too."""
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), object)
    for i, part in enumerate(parts):
        apart = ((book - part) ** 2).sum(axis=1) if len(part) else np.zeros(len(book), object)
        index[i] = min(range(len(apart)), key=lambda k: (apart[k], k))
        error[i] = apart[index[i]]
    return index, error


class Codebooks:
    """Entries of all parts, as integers; a part with a large entry is compared with Python's integers."""

    def __init__(self, books: list[np.ndarray], grids: list[tuple[int, int]], dims: int):
        self.books, self.grids, self.dims = books, grids, dims
        self.bounds = part_bounds(dims)
        self.exact = [book.dtype == object and bool((abs(book) > LARGEST).any()) for book in books]

    def assign(self, cells: list[Cells | None], matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part its number, its vectors, their entries and squared distances."""
        for k in range(PARTS):
            part = np.ascontiguousarray(matrix[:, self.bounds[k] : self.bounds[k + 1]])
            if cells[k] is None or part.dtype == object:
                index, error = _nearest_exact(self.books[k].astype(object), part.astype(object))
            else:
                index, error = cells[k].nearest(part)
            yield k, part, index, error

    def cells(self) -> list[Cells | None]:
        return [None if e else Cells(b.astype(np.int64), g) for b, g, e in zip(self.books, self.grids, self.exact, strict=True)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows and their vectors, those with large components apart."""
    large = batch.column("large").to_numpy(zero_copy_only=False)
    for kind in (False, True):
        chosen = batch.filter(pa.array(large == kind)) if large.any() else batch
        if not kind or large.any():
            for low in range(0, chosen.num_rows, BLOCK_VECTORS):
                here = chosen.slice(low, BLOCK_VECTORS)
                yield here, _matrix(here.column("vector").to_pylist(), [kind] * here.num_rows, dims)


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("total", pa.decimal128(38, 0))])


def _sums(books: Codebooks):
    """Sums of the parts assigned to each entry, one row for each component, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = books.cells()
        totals: list[np.ndarray] = [np.zeros(book.shape, np.int64) for book in books.books]
        counts = [np.zeros(len(book), np.int64) for book in books.books]
        for batch in batches:
            for _, matrix in _blocks(batch, books.dims):
                for k, part, index, _ in books.assign(cells, matrix):
                    if part.dtype == object:
                        totals[k] = totals[k].astype(object)
                    np.add.at(totals[k], index, part)
                    counts[k] += np.bincount(index, minlength=len(counts[k]))
        for k in range(PARTS):
            used = np.flatnonzero(counts[k])
            width = totals[k].shape[1]
            if len(used) and width:
                flat = [int(x) for x in totals[k][used].ravel()]
                columns = [np.full(len(flat), k, np.int32), np.repeat(used, width).astype(np.int32), np.repeat(counts[k][used], width), np.tile(np.arange(width, dtype=np.int32), len(used)), flat]
                yield rows(_SUMS, columns)

    return run


_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = books.cells()
        for batch in batches:
            for here, matrix in _blocks(batch, books.dims):
                codes, errors = np.zeros((len(matrix), PARTS), np.uint8), [0] * len(matrix)
                for k, _, index, error in books.assign(cells, matrix):
                    codes[:, k] = index
                    errors = [a + b for a, b in zip(errors, error.tolist(), strict=True)]
                text = codes.tobytes().hex()
                errors = [e if e < 1 << 63 else None for e in errors]
                yield rows(_CODED, [here.column("vec_id"), here.column("label"), [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], errors])

    return run


def _trained(fit: DataFrame, start: list, dims: int, rounds: int) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and averaging; a round sends one row a component of an entry to the driver."""
    first = np.concatenate([_matrix([bytes(r["vector"])], [r["large"]], dims).astype(object) for r in start])
    bounds = part_bounds(dims)
    books = [np.array(first[:, bounds[k] : bounds[k + 1]]) for k in range(PARTS)]
    drawn = fit.where("not large").select("vector").orderBy(F.xxhash64("vector"), "vec_id").limit(FIT_VECTORS).collect()
    sample = _matrix([bytes(r[0]) for r in drawn], [], dims)
    grids = [(0, 1)] * PARTS
    for k in range(PARTS):
        if not Codebooks(books, grids, dims).exact[k]:
            grids[k] = fit_grid(books[k].astype(np.int64), np.ascontiguousarray(sample[:, bounds[k] : bounds[k + 1]]))
    for _ in range(rounds):
        now = Codebooks(books, grids, dims)
        sums = fit.mapInArrow(_sums(now), "part int, entry int, n long, at int, total decimal(38,0)")
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [np.array(book) for book in books]
        for r in sums.collect():
            books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return Codebooks(books, grids, dims)


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Product codes of vectors: (vec_id, code, error, label_error, codebooks_sha256), one row for each vector kept.

    ``vectors`` has vec_id, embedding and label; other columns don't matter. Vectors that are null or hold null or
    non-finite components are left out. A component x becomes floor(1024 * x); a vector is cut into four consecutive
    parts. Each part's codebook begins as that part of the 256 vectors with the smallest ids (all, if there are fewer; of
    equal ids the smaller vector) and is averaged ``rounds`` times over all vectors, with floors; entries without vectors
    stay. ``code`` has two hex digits a part, ``error`` the squared distance to the coded vector; ``label_error`` is its
    sum over equal labels, null labels together. Rows with repeated ids are coded one by one, a null id comes last among
    the ids. A vector with another number of components than that with the smallest id, or with a component of 2^62 or more
    after scaling, can't be coded: it has null code and error. Errors and sums that no long can hold are null. An empty
    table gives no rows.

    The integers are stored once. A round sends 1024 entries to the tasks and gets a sum for each; the side of the cells
    is chosen on FIT_VECTORS vectors and does not change results, as any grid gives the same codes.
    """
    ship_package(vectors)
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    fit = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    whole = stored(given.where(fit).mapInArrow(_quantised, "vec_id long, label long, dims int, large boolean, vector binary"), "integer-vectors")
    by_id = (F.col("vec_id").asc_nulls_last(), F.col("vector"))
    lead = whole.where("dims >= 0").orderBy(*by_id).select("dims").first()
    dims = lead["dims"] if lead else 0
    alike = whole.where(F.col("dims") == dims)
    start = alike.orderBy(*by_id).select("vector", "large").limit(ENTRIES).collect()
    empty = "vec_id long, label long, code string, error long"
    digest = F.lit(None).cast("string")
    if start:
        books = _trained(alike, start, dims, rounds)
        digest = F.lit(books.sha256())
        coded = alike.select("vec_id", "label", "large", "vector").mapInArrow(_coded(books), empty)
    else:
        coded = vectors.sparkSession.createDataFrame([], empty)
    odd = whole.where(F.col("dims") != dims).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stored(coded.unionByName(odd), "codes")
    beyond = F.max(F.col("code").isNotNull() & F.col("error").isNull())
    sums = coded.groupBy("label").agg(F.when(~beyond, F.sum(F.col("error").cast("decimal(38,0)"))).alias("total"))
    sums = sums.select("label", F.expr("try_cast(total as long)").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(LABEL_PARTS - 1))).alias("deal"))
    dealt = coded.withColumn("deal", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_PARTS)).cast("int"))
    sums = sums.withColumnsRenamed({"label": "sum_label", "deal": "sum_deal"})
    joined = dealt.join(sums, dealt["label"].eqNullSafe(sums["sum_label"]) & (dealt["deal"] == sums["sum_deal"]))
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
