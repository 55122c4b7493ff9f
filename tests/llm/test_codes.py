"""Vector codes against plain Python integers: every entry compared with every part."""

import hashlib
import math
import random

import numpy as np
import pytest

from dunlake.llm import codes
from dunlake.llm.codes import Cells, compress, fit_grid, part_bounds

# Names that the operator uses itself must do no harm.
SCHEMA = "vec_id long, embedding array<double>, label long, dims string, large int, error string, deal int"


def plain(rows):
    """The contract, literally; vectors of another length than the first one's have no code."""
    kept = [(i, [math.floor(codes.SCALE * x) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    dims = len(by_id[0][1])
    alike, cut = [r for r in by_id if len(r[1]) == dims], part_bounds(dims)
    pieces = [[v[cut[k] : cut[k + 1]] for _, v, _ in alike] for k in range(4)]
    books = [[list(p) for p in part[:256]] for part in pieces]

    def nearest(k, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), j) for j, entry in enumerate(books[k]))

    for _ in range(4):
        for k in range(4):
            of = {}
            for part in pieces[k]:
                of.setdefault(nearest(k, part)[1], []).append(part)
            for j, members in of.items():
                books[k][j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, sums = [], {}
    for i, v, la in kept:
        code = error = None
        if len(v) == dims:
            found = [nearest(k, v[cut[k] : cut[k + 1]]) for k in range(4)]
            code, error = "".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found)
            sums[la] = sums.get(la, 0) + error
        out.append((i, code, error, la))
    return sorted(((i, c, e, sums.get(la), digest) for i, c, e, la in out), key=str)


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, la, "x", 1, "e", 3) for i, v, la in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(rng, n, dims, spread):
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) * spread for _ in range(dims)]
        if rows and rng.random() < 0.3:
            v = list(rng.choice(rows)[1] or v)
        rows.append((i * 3, v, rng.choice([None, 1, 2])))
    return rows


@pytest.mark.parametrize("dims, spread", [(8, 0.01), (6, 0.2), (3, 0.02)])
def test_equals_plain_integers(spark, rng, dims, spread):
    rows = vectors(rng, 400, dims, spread)
    rows += [(5000, None, 1), (5001, [float("nan")] * dims, 1), (5002, [None] * dims, 2), (5003, [float("-inf")] * dims, 2), (5004, [0.5] * (dims + 1), 1)]
    rng.shuffle(rows)
    assert coded(spark, rows) == plain(rows)


def test_few_vectors_repeated_and_null_ids(spark):
    rows = [(1, [0.5, -0.25, 1.0, 2.0], None)] * 3 + [(None, [3.0, 4.0, 5.0, 6.0], 7), (2, [-1.0, 0.0, -0.0, 1.0], None)]
    got = coded(spark, rows)
    assert got == plain(rows) and len(got) == 5
    assert {r[2] for r in got} == {0}


def test_large_components_are_exact(spark):
    rows = [(i, [10.0**9 * i if i % 2 else 10.0**4 * i, -1.5, 2.0 * i, 7.0], i % 2) for i in range(300)] + [(900, [1e300, 0.0, 0.0, 0.0], 1)]
    got = coded(spark, rows)
    long = lambda x: x if x is not None and x < 1 << 63 else None
    expected = sorted(((i, c, long(e), long(s), d) for i, c, e, s, d in plain(rows[:-1])), key=str)
    assert any(r[2] is None for r in expected) and any(r[2] for r in expected)
    assert [r for r in got if r[0] != 900] == expected
    assert [r[:3] for r in got if r[0] == 900] == [(900, None, None)]


def test_empty_tables(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1), (2, [None], 2)]) == []


def test_grid_of_any_side_gives_the_nearest():
    rng = np.random.default_rng(5)
    for dims, spread in ((1, 3), (4, 6), (9, 200)):
        parts = np.floor(rng.normal(size=(700, dims)) * spread).astype(np.int64)
        book = parts[:256].copy()
        apart = ((parts[:, None] - book) ** 2).sum(axis=2)
        for grid in [fit_grid(book, parts), (0, 1), (-3, 7), (int(parts.min()), 1 << 14)]:
            index, error = Cells(book, grid).nearest(parts)
            assert (index == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()


def test_cells_leave_out_dominated_entries_and_are_kept(monkeypatch):
    book = np.array([[0, 0], [10, 10], [1000, 1000], [-1000, 5]], np.int64)
    cells = Cells(book, (0, 16))
    parts = np.array([[3, 4], [9, 12], [990, 1001], [3, 4]], np.int64)
    cell, lists, new = cells.lists(parts)
    assert [lists[c].tolist() for c in cell] == [[0, 1], [0, 1], [2], [0, 1]] and new == 2
    assert cells.lists(parts)[2] == 0
    monkeypatch.setattr(codes, "CACHE_CELLS", 2)
    assert cells.nearest(np.array([[-900, 0], [3, 4]], np.int64))[0].tolist() == [3, 0]


def test_plain_version_of_a_known_case():
    rng = random.Random(1)
    rows = [(i, [rng.random()], 1) for i in range(3)]
    assert all(r[2] == 0 for r in plain(rows))
