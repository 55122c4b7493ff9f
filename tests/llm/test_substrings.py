"""Span dedup against a set of all strings of 100 bytes."""

import hashlib

import numpy as np
import pytest

from dunlake.llm import substrings
from dunlake.llm.substrings import COVER, COVER_PERIOD, clean_spans, dedup_spans

SCHEMA = "doc_id long, text string, kept string, places int"


def corpus(rng, n=70):
    base = ["".join(rng.choice("abcdefghij é\n") for _ in range(rng.randrange(60, 700))) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(8)):
            if rng.random() < 0.7:
                text, at = rng.choice(base), rng.randrange(200)
                parts.append(text[at : at + rng.randrange(20, 300)])
            else:
                parts.append("".join(rng.choice("xyz é") for _ in range(rng.randrange(120))))
        text = "".join(parts)
        if rng.random() < 0.1:
            text = "ab" * rng.randrange(300)
        if docs and rng.random() < 0.1:
            text = docs[-1][1]
        docs.append((3 * i if i != 20 else None, text if rng.random() > 0.03 else None, "x", 1))
    return [*docs, docs[1], (10**6, "", "y", None)]


def brute_force(docs):
    seen, done, out = set(), set(), {}
    for doc_id, text, *_ in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        data = (text or "").encode()
        if (doc_id, data) in done:
            continue
        done.add((doc_id, data))
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in dedup_spans(df).collect()]


@pytest.mark.parametrize("block, piece", [(8 << 20, 1 << 22), (1500, 300)])
def test_equals_all_windows(spark, rng, monkeypatch, block, piece):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "PIECE_BYTES", piece)
    docs = corpus(rng)
    rows = found(spark.createDataFrame(docs, SCHEMA).repartition(5))
    expected = brute_force(docs)
    assert len(rows) == len(docs)
    assert [r for r in rows if r[0] is not None and r[1] != expected[r[0]]] == []
    assert sum(e[1] for e in expected.values()) > 5000


def test_many_contexts_of_one_gram(spark, rng):
    """One passage in different surroundings: ties of the sort that only some windows share."""
    passage = "".join(rng.choice("klmnop ") for _ in range(140))
    docs = []
    for i in range(40):
        before = "".join(rng.choice("ab") for _ in range(rng.randrange(80)))
        docs.append((i, before + passage[rng.randrange(20) :] + rng.choice("xyz") * rng.randrange(90), "x", 1))
    rows = dict(found(spark.createDataFrame(docs, SCHEMA).repartition(3)))
    assert rows == brute_force(docs)


def test_empty_table(spark):
    assert dedup_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clean_spans_keeps_columns_and_valid_text(spark):
    passage = "é" + " ".join(f"palabra{i}" for i in range(20)) + "é"
    docs = [(1, "uno " + passage, "a", 1), (2, "dos " + passage + " fin", "b", 2), (3, passage, "c", 3), (None, passage, "d", 4), (5, None, "e", 5)]
    df = spark.createDataFrame(docs, SCHEMA)
    kept = clean_spans(df)
    assert kept.columns == df.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {1, 2, None, 5}
    assert rows[1].text == "uno " + passage
    assert rows[2].text.startswith("dos") and rows[2].text.endswith("fin") and len(rows[2].text) < 20
    assert rows[None].text == passage and rows[5].text == ""


def test_cover_is_a_difference_cover():
    differences = {(a - b) % COVER_PERIOD for a in COVER for b in COVER}
    assert differences == set(range(COVER_PERIOD))
    a, b = np.meshgrid(np.arange(COVER_PERIOD), np.arange(COVER_PERIOD), indexing="ij")
    assert np.isin((a + substrings.SHIFTS) % COVER_PERIOD, COVER).all() and np.isin((b + substrings.SHIFTS) % COVER_PERIOD, COVER).all()
