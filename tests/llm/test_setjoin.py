"""Jaccard join against all pairs of sets."""

import re

import numpy as np
import pytest

import corpus_pipeline
from dunlake.llm import setjoin
from dunlake.llm.setjoin import jaccard_components, one_per_group

SCHEMA = "doc_id long, text string, component_id string, bucket int"


def corpus(rng, n=160):
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(3)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.7:
            words = (rng.choice(docs)[1] or "").split(" ")
            for _ in range(rng.randrange(5)):
                place = rng.randrange(len(words) + 1)
                words[place : place + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 8, 30, 60, 100, 200]))]
        if rng.random() < 0.1:
            words[len(words) // 2 : len(words) // 2] = rng.choice(passages)
        text = rng.choice([" ", "\n", "\t "]).join(words)
        docs.append((i if i != 20 else None, None if rng.random() < 0.03 else text.upper() if rng.random() < 0.2 else text, "x", 1))
    return [*docs, docs[5], (6, docs[n // 2][1], "y", 2), (n, "", "z", None)]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(docs):
    sets = [(row[0], shingle_set(row[1])) for row in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return [(i, len(s), None if i is None else top(i)) for i, s in sets]


def plain(rows):
    return sorted(rows, key=lambda r: tuple(-1 if v is None else v for v in r))


def test_equals_all_pairs(spark, rng):
    docs = corpus(rng)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert plain(tuple(r) for r in jaccard_components(df).collect()) == plain(brute_force(docs))


def test_chain_of_near_copies_and_group_of_copies(spark):
    words = [f"t{i}" for i in range(100)]
    docs = [(i, " ".join(words[: 90 - i] + [f"n{k}" for k in range(i)]), "x", 1) for i in range(30)]
    docs += [(1000 + i, "one two three four five six", "x", 1) for i in range(200)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(7)
    assert plain(tuple(r) for r in jaccard_components(df).collect()) == plain(brute_force(docs))


def test_open_pairs_across_components(spark, rng):
    """Sets that link with each other but not with the smallest set of their lists."""
    shared = [f"s{i}" for i in range(40)]
    docs = []
    for i in range(60):
        own = [f"o{i // 3}x{k}" for k in range(60)]
        docs.append((i, " ".join(shared + own + [f"e{i}"]), "x", 1))
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    assert plain(tuple(r) for r in jaccard_components(df).collect()) == plain(brute_force(docs))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(df).collect() == []
    assert one_per_group(df).collect() == []


def test_one_per_group(spark, rng):
    docs = corpus(rng, 80)
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    kept = one_per_group(df)
    assert kept.columns == df.columns
    smallest = {c for i, _, c in brute_force(docs) if i is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(smallest)
    assert ids.count(None) == 1


@pytest.mark.parametrize("n, m", [(1, 1), (4, 3), (7, 9), (100, 75), (571, 440)])
def test_least_overlap_is_exact(n, m):
    least = int(setjoin.least_overlap(n, m))
    assert 100 * least >= 75 * (n + m - least)
    assert 100 * (least - 1) < 75 * (n + m - (least - 1))


def test_leader_of_another_text_of_an_id(spark):
    """The first set of an id is compared as leader and doesn't link; the other one does."""
    docs = []
    for case in range(40):
        words = [f"c{case}w{k}" for k in range(104)]
        extra = [f"c{case}e{k}" for k in range(24)]
        rest = [f"c{case}r{k}" for k in range(300)]
        docs += [(10 * case + 7, " ".join(words[:80] + extra), "x", 1), (10 * case + 7, " ".join(words[10:]), "x", 1)]
        docs += [(10 * case + 9, " ".join(words), "x", 1), (5000 + case, " ".join(extra + rest), "x", 1)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    assert plain(tuple(r) for r in jaccard_components(df).collect()) == plain(brute_force(docs))


def test_shingles_go_to_the_row_that_stands_for_itself():
    """Set 3 is a copy of 2 in the task whose rows arrive first, and stands for itself in another one."""
    ids, versions, sizes = np.array([3]), np.array([9]), np.array([4])
    metas = [batch for other in (2, 3) for batch in setjoin._meta_rows(ids, versions, sizes, np.array([other]), 1)]
    tokens, counts = np.arange(4, dtype=np.uint64), np.array([4])
    packed = setjoin._pack_ids(ids), setjoin._pack_versions(versions), setjoin._pack_counts(counts), np.full(4, 2, np.uint16).tobytes(), setjoin._short(tokens)
    found = setjoin.rows(setjoin._SHARED, [[0], [1], [0], *([c] for c in packed)])
    rows = [row for batch in setjoin._assembled(1)(iter([*metas, found])) for row in batch.to_pylist()]
    assert sorted((row["same_as"], row["tokens"] is not None) for row in rows) == [(2, False), (3, True)]


def test_stage_keeps_different_texts_of_an_id(spark):
    docs = [(1, "a b c d e f", "x", 1), (1, "p q r s t u", "x", 1), (1, "a b c d e f", "x", 1), (2, "p q r s t u", "x", 1), (3, None, "x", 1), (3, "v", "x", 1)]
    kept = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "a b c d e f"), (1, "p q r s t u"), (3, ""), (3, "v")]


def test_columns_named_like_those_of_the_work(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "a", 1, "r"), (2, text, "b", 2, "s"), (3, None, "c", 3, "t"), (None, text, "d", 4, "u")], "doc_id long, text string, dropped string, place int, row string")
    kept = one_per_group(df, every_text=True)
    assert kept.columns == df.columns
    assert sorted(r["dropped"] for r in kept.collect()) == ["a", "c", "d"]


def thue_morse(n, pair="ab"):
    """A text and its complement, which polynomials modulo 2^64 don't tell apart from 1 KB on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(pair[b] for b in bits), "".join(pair[1 - b] for b in bits)


def test_words_built_to_collide(spark):
    one, other = thue_morse(4096)
    docs = [(1, one, "x", 1), (2, other, "x", 1), (3, one.upper(), "x", 1), (4, f"a b c d {one}", "x", 1), (5, f"a b c d {other}", "x", 1)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert plain(tuple(r) for r in jaccard_components(df).collect()) == plain(brute_force(docs))


def test_hashes_of_ranges_depend_on_their_bytes_alone(rng):
    from dunlake.llm.hashing import text_hashes

    words = ["".join(rng.choice("aAbB") for _ in range(rng.choice([1, 2, 31, 32, 33, 64, 65, 200]))) for _ in range(300)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for lower in (False, True):
        hashes = text_hashes(data, starts, ends, lower)
        texts = [w.lower() if lower else w for w in words]
        assert len(set(zip(texts, hashes.tolist(), strict=True))) == len(set(texts)) == len(set(hashes.tolist()))
        alone = [text_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), lower)[0] for w in words]
        assert hashes.tolist() == alone


@pytest.mark.parametrize("few", [1, 3])
def test_long_lists_take_every_turn(spark, rng, monkeypatch, few):
    """With nearly every list a long one, later turns find the pairs that the first one leaves."""
    monkeypatch.setattr(setjoin, "FEW", few)
    docs = corpus(rng)
    got = jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert plain(got.collect()) == plain(brute_force(docs))


def test_short_lists_take_one_turn(spark, rng, monkeypatch):
    """Lists are sent a second time only for sets of long ones, and the comparison moves only sets of open pairs."""
    written = []
    monkeypatch.setattr(setjoin, "stored", lambda df, name, store=setjoin.stored: written.append((name, out := store(df, name))) or out)
    docs = corpus(rng, 60)
    got = jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert plain(got.collect()) == plain(brute_force(docs))
    assert [name for name, _ in written].count("open-pairs") == 1
    tables = dict(written)
    ends = {(r[a], r[b]) for r in tables["open-pairs"].collect() for a, b in ((0, 1), (2, 3))}
    assert {(r.id, r.version) for r in tables["open-sets"].collect()} == ends


def postings(n, able):
    """One list of n sets of one size, all in different components, of which the first ``able`` can reach the threshold."""
    ids, rests = np.arange(n), np.where(np.arange(n) < able, 100, 10)
    columns = (np.full(n, 5), ids, ids, np.full(n, 100), rests, ids, np.full(n, -1 << 62), np.zeros(n))
    packed = [[setjoin.binary(c.astype(k))] for c, k in zip(columns, setjoin._KINDS, strict=True)]
    return setjoin.rows(setjoin._POSTINGS, [[0], *packed])


def turns(batch):
    """Pairs and waiting sets of every turn."""
    out, low = [], 0
    for bits in setjoin.TURNS:
        high = (1 << 64 - bits) - 1
        found = [r for b in setjoin._open_pairs(low, high, setjoin.FEW)(iter([batch])) for r in b.to_pylist()]
        out.append(({(r["id"], r["other_id"]) for r in found if r["other_id"] is not None}, {r["id"] for r in found if r["other_id"] is None}))
        low = high + 1
    return out


def test_long_list_with_few_open_pairs_takes_one_turn():
    pairs, waiting = turns(postings(300, 40))[0]
    assert pairs == {(a, b) for b in range(40) for a in range(b)} and not waiting


def test_long_list_with_many_open_pairs_takes_every_turn():
    (one, waits), (two, waits_again), (three, none) = turns(postings(300, 300))
    assert one | two | three == {(a, b) for b in range(300) for a in range(b)} and len(one) + len(two) + len(three) == 300 * 299 // 2
    assert waits == waits_again == set(range(300)) and not none and 16 * len(one) < len(three) > 8 * len(two)


def test_long_sets_come_in_small_batches_and_links_in_few_files(spark, rng, monkeypatch, tmp_path):
    """A batch for a worker is bounded by its bytes, and links of few bytes are gathered from the tasks that found them."""
    folder, limit, written = str(tmp_path), 1 << 18, []

    def noting(kernel):
        def run(batches):
            def noted():
                for batch in batches:
                    if "other_tokens" in batch.schema.names:
                        with open(f"{folder}/bytes", "a") as f:
                            f.write(f"{batch.nbytes}\n")
                    yield batch

            yield from kernel(noted())

        return run

    monkeypatch.setattr(setjoin, "tidied", noting)
    monkeypatch.setattr(setjoin, "BATCH_BYTES", limit, raising=False)
    monkeypatch.setattr(setjoin, "stored", lambda df, name, store=setjoin.stored: written.append((name, out := store(df, name))) or out)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    docs = [(i, " ".join([*base[: i * 7], f"x{i}", *base[i * 7 :]]), "x", 1) for i in range(60)]
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        got = jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(5))
        assert [r.component_id for r in got.collect()] == [0] * 60
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    sizes = [int(line) for line in open(f"{folder}/bytes")]
    assert max(sizes) < 2 * limit
    assert len(dict(written)["leader-links"].inputFiles()) == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(limit)
