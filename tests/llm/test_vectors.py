"""Vector join against all pairs, with cells and blocks small enough to be cut."""

import numpy as np
import pytest

from dunlake.llm import vectors
from dunlake.llm.vectors import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, unit string"


def table(seed, n=400):
    rng = np.random.default_rng(seed)
    centres, rows = rng.normal(size=(12, 8)), []
    for i in range(n):
        vector = rng.normal(size=8) if rng.random() < 0.5 else centres[rng.integers(12)] + rng.normal(size=8) * 0.15
        vector = [float(np.float32(x)) for x in vector]
        if rows and rng.random() < 0.15:
            vector = rows[rng.integers(len(rows))][1]
        odd = rng.random()
        if odd < 0.06:
            vector = [None, [0.0] * 8, [float("nan")] * 8, [1.0, float("inf")], [1.0, None, 2.0], []][int(odd * 100)]
        elif odd < 0.08 and vector:
            vector = vector[:5]
        rows.append((i, vector, None if rng.random() < 0.03 else int(rng.integers(3)), "x"))
    return rows


def brute_force(rows):
    units = {}
    for i, vector, label, _ in rows:
        if vector and label is not None and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            values = np.array(vector, np.float64)
            units[i] = (label, values / np.linalg.norm(values))
    parent, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (la, a) in units.items():
        for j, (lb, b) in units.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= 0.93:
                links[i] += 1
                links[j] += 1
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return {i: (links[i], top(i), top(i) == i) for i in parent}


@pytest.mark.parametrize("cell, block, pivots", [(20, 16, 4096), (50, 4096, 3), (2048, 30, 4096)])
def test_equals_all_pairs(spark, monkeypatch, cell, block, pivots):
    monkeypatch.setattr(vectors, "CELL_VECTORS", cell)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", block)
    monkeypatch.setattr(vectors, "MAX_PIVOTS", pivots)
    rows = table(cell)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == brute_force(rows)


def test_repeated_rows_null_ids_and_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1, "x") for i in range(50)] + [(7, [1.0, 2.0, 3.0], 1, "x"), (None, [1.0, 2.0, 3.0], 1, "x"), (99, [2.0, 4.0, 6.0], 2, "x")]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert (None, 0, None, None) in got and (99, 0, 99, True) in got
    assert sum(1 for r in got if r[1:3] == (50, 0)) == 51 and len(got) == 53


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
