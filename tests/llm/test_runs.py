"""Periodic runs against all distances, and the trees against plain comparisons."""

import random
import zlib

import numpy as np
import pytest

from dunlake.llm import common, runs
from dunlake.llm.queries import QUERIES
from dunlake.llm.runs import Extensions, SuffixTree, periodic_runs, runs_of, with_planted_runs


def plain_runs(words, shortest=12):
    """All maximal stretches of each distance, without those inside a stretch of a smaller one."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                found.add((i, j - i + q, q))
            i = max(j, i + 1)
    inner = {r for r in found for o in found if o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1]}
    return sorted(found - inner, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_extensions_of_random_sequences():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.randrange(1, rng.choice([2, 3, 5])) for _ in range(rng.randint(1, 40))] + [0]
        tree = SuffixTree(words)
        leaves, shared = tree.tour()
        assert leaves.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        opposite, _ = tree.tour(last_first=True)
        assert opposite.tolist() == sorted(range(len(words)), key=lambda i: [-w if w else -99 for w in words[i:]])
        a, b = np.nonzero(~np.eye(len(words), dtype=bool))
        for i, j, n in zip(a, b, Extensions(leaves, shared).common(a, b), strict=True):
            assert words[i : i + n] == words[j : j + n] and words[i + n : i + n + 1] != words[j + n : j + n + 1]


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_equal_all_distances(shortest):
    rng = random.Random(shortest)
    for _ in range(400):
        n = rng.randint(0, 70)
        words = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        numbers = np.unique(words, return_inverse=True)[1] if n else np.zeros(0, np.int64)
        assert [tuple(r) for r in runs_of(numbers, shortest).tolist()] == plain_runs(words, shortest)


def texts(rng, n=150):
    out = []
    for _ in range(n):
        words = [rng.choice(["a", "b", "É", "a-b", "日本"][: rng.randint(1, 5)]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            words += [f"u{rng.randrange(90)}" for _ in range(rng.randint(0, 12))] + rng.choices(["x", "y", "z"], k=rng.randint(1, 6)) * rng.randint(1, 9)
        out.append(rng.choice([" ", "\n", " \t\v\f\r "]).join(words))
    return out


def check(spark, given):
    # columns with the names that the operator makes must do no harm
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in given], "doc_id long, text string, runs string, n_words int, h int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=str)
    want = []
    for i, text in given:
        words = [w.decode() for w in (text or "").encode().split()]
        found = plain_runs(words)
        want.append((i, len(words), found, collapsed(words, found)))
    assert got == sorted(want, key=str)


def test_operator_equals_plain_python(spark, rng):
    given = list(enumerate(texts(rng)))
    given += [(900, None), (901, ""), (902, " \n\t "), (None, "a b " * 9), (3, "same"), (3, "same"), (4, "q " * 12), (5, "q " * 11), (6, "no-break space " * 13)]
    check(spark, given)


def test_slices_and_a_text_beyond_one(spark, rng, monkeypatch):
    monkeypatch.setattr(common.slices, "__defaults__", (64,))
    monkeypatch.setattr(runs, "slices", lambda batch: common.slices(batch, 64))
    given = list(enumerate(texts(rng, 40)))
    check(spark, given + [(99, " ".join(f"w{i % 300}" for i in range(1000)))])


def test_repeats_across_texts_are_no_runs(spark):
    check(spark, [(i, "one two three four five six seven eight") for i in range(20)])


def test_empty_table(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_planted_texts(spark, rng):
    given = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 80)))) for i in range(300)] + [(None, "a b"), (7000, None), (-3, "x y z " * 9)]
    got = {r.doc_id: r.text for r in with_planted_runs(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for i, text in given:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[i] == " ".join(words[a + (j - a) % p] if j >= a else w for j, w in enumerate(words))
        else:
            assert got[i] == text


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b " * 8), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert (rows[1].n_runs, rows[1].start, rows[1].length, rows[1].period, rows[1].exponent_milli) == (1, 0, 16, 2, 8000)
    assert tuple(rows[2])[1:6] == (0, None, None, None, None) and rows[2].runs_sha256 == rows[2].collapsed_sha256
