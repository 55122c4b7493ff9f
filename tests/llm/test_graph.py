"""Components against union-find."""

from dunlake.llm import graph
from dunlake.llm.graph import components


def brute_force(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    return {x: top(x) for x in parent}


def check(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    rows = components(df).collect()
    assert {r.id: r.component_id for r in rows} == brute_force(edges) and len(rows) == len(brute_force(edges))


def test_components(spark, rng):
    check(spark, [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3), (4, None)])
    check(spark, [(i, i + 1) for i in range(0, 60)] + [(-5, 1000 + i) for i in range(300)])
    check(spark, [])


def test_stars_end_the_rounds(spark, monkeypatch):
    """One round turns this path into a star; no further round is spent on finding that nothing changes."""
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name, store=graph.stored: written.append(name) or store(df, name))
    check(spark, [(1, 2), (2, 3), (7, 8), (7, 9), (7, 9)])
    assert written == ["edges", "edges", "nodes"]
