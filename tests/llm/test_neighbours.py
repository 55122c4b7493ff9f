"""Nearest neighbours: recall against all rows, exact scores and order, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunlake.llm import neighbours
from dunlake.llm.neighbours import Fit, Planes, nearest_neighbours, shared_bits

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, cell int, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", 2, "i") for i, v in rows], SCHEMA).repartition(4)


def usable(rows):
    """Distinct (id, vector) that take part, as doubles of the same length."""
    good = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = max((len(v) for _, v in good), default=0)
    return sorted((i, v + (0.0,) * (width - len(v))) for i, v in good)


def true_neighbours(rows, step=20, size=20):
    good, out = usable(rows), {}
    ids, matrix = np.array([i for i, _ in good]), np.array([v for _, v in good])
    for k, (i, _) in enumerate(good):
        if i % step == 0:
            scores = (matrix * matrix[k]).sum(axis=1)
            out[i] = [(int(ids[j]), float(scores[j])) for j in np.lexsort((ids, -scores)) if j != k][:size]
    return out


def search(spark, rows):
    found = {}
    for r in nearest_neighbours(frame(spark, rows)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def clustered(seed, n, dims, norms=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    rows = centres[rng.integers(30, size=n)] + rng.normal(size=(n, dims)) * 0.4
    if norms:
        rows *= rng.lognormal(size=(n, 1))
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("norms", [False, True])
def test_recall_scores_and_order(spark, monkeypatch, norms):
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 300)
    monkeypatch.setattr(neighbours, "SAMPLE_VECTORS", 500)
    rows = clustered(1, 3000, 24, norms)
    got, want = search(spark, rows), true_neighbours(rows)
    assert got.keys() == want.keys() and all(len(f) == 20 for f in got.values())
    vectors = dict(usable(rows))
    for query, found in got.items():
        assert [s for _, s in found] == [float((np.array(vectors[i]) * np.array(vectors[query])).sum()) for i, _ in found]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_less_than_all_rows_are_compared(spark):
    rows = clustered(2, 2000, 24)
    matrix = np.array([v for _, v in rows])
    fit = Fit(Planes(24, float(np.linalg.norm(matrix, axis=1).max()), 12), matrix, len(matrix))
    fit.learn(matrix[:40], [matrix[np.argsort(-(matrix @ q))[1:21]] for q in matrix[:40]])
    strings = fit.planes.strings(matrix, True)
    asked = fit.planes.strings(matrix[:40], False)
    stops = fit.levels(asked)
    seen = [(shared_bits(strings, a).max(axis=1) >= s).mean() for a, s in zip(asked, stops, strict=True)]
    assert np.mean(seen) < 0.5


def test_a_vector_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 100)
    rows = clustered(3, 600, 16)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    got, want = search(spark, rows), true_neighbours(rows)
    assert got.keys() == want.keys()
    for query in want:
        if query % 3 == 0:  # copies, smallest ids first, without itself
            assert got[query] == want[query]


def test_few_rows_give_all_of_them(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [-1.0, 0.5]), (40, [1.0, 0.0])]
    rows += [(60, None), (80, []), (100, [0.0, -0.0]), (120, [1.0, None]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [2.0])]
    got, want = search(spark, rows), true_neighbours(rows)
    assert got == want and got.keys() == {0, 20, 40}
    assert [i for i, _ in got[0]] == [7, 3, 40, 20, 3]


def test_empty_tables_and_no_queries(spark):
    assert nearest_neighbours(frame(spark, [])).collect() == []
    assert nearest_neighbours(frame(spark, [(1, None)])).collect() == []
    assert nearest_neighbours(frame(spark, [(1, [1.0]), (2, [2.0])])).collect() == []


def test_chosen_queries_and_doubles(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest_neighbours(df, F.col("vec_id") == 2, 2).orderBy("rank").collect()]
    assert got == [(2, 1, 5, 11.0), (2, 2, 4, 9.0)]


def test_prefixes():
    a = np.array([0b1011 << 44, 0, (1 << 48) - 1])
    assert shared_bits(a, np.array([0b1010 << 44, 0, 0])).tolist() == [3, 48, 0]
    low, high = Fit.reach(a, np.array([4, 0, 48]))
    assert (low[0], high[0]) == (0b1011 << 44, (0b1011 << 44) + (1 << 44) - 1)
    assert (low[1], high[1]) == (0, (1 << 48) - 1) and low[2] == high[2] == a[2]
