"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from dunlake.llm import bpe
from dunlake.llm.bpe import tokenizer
from dunlake.llm.common import stored
from dunlake.llm.encoding import decode, encode
from dunlake.llm.packing import pack, plan
from dunlake.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, ids string, length int"
ODD = [None, "", " ", "a", "don't  you're I'll 'tis ''s x'sy  'll\n\n  end ", "<|endoftext|>a <|endoftext|>", "<|endoftext", "\t\n a b\u3000c", "a" * 700, " " * 70 + "x",
       "it's 've'd'sm re're", "数字１２³ⅷ émigré 🙂🙂 é", "0123456789" * 30, "=" * 200, "\x00\x01", "x\u0085y\u200bz"]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(vocabulary())


def random_texts(rng, n):
    bits = ["'", "s", "t", "re", "ve", " ", "  ", "\n", "\u00a0", "1", "²", "é", "#", "%%", "数", "🙂", "ll", "d", "m", "LL", "\u0301", "\r\n", "the", "ing"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]
    point = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])
    return texts + ["".join(chr(point()) for _ in range(40)) for _ in range(n // 4)]


def encoded(df):
    return {r.doc_id: r.ids for r in encode(df, vocabulary()).collect()}


def test_encode_and_decode(spark, rng, library):
    texts = ODD + random_texts(rng, 400)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    ids = {i: e.ids for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert encoded(df) == ids
    for row in decode(encode(df, vocabulary()), vocabulary()).collect():
        assert row.text == library.decode(ids[row.doc_id], skip_special_tokens=False) == (texts[row.doc_id] or "")
        assert row.n_tokens == len(ids[row.doc_id])
        assert row.ids_sha256 == hashlib.sha256(np.array(ids[row.doc_id], "<u4").tobytes()).hexdigest()


def test_decode_broken_bytes(spark, library, rng):
    lists = [[rng.randrange(50257) for _ in range(8)] for _ in range(60)]
    df = spark.createDataFrame([*enumerate(lists), (100, None), (101, [])], "doc_id long, ids array<int>")
    said = {r.doc_id: r.text for r in decode(df, vocabulary()).collect()}
    assert said.pop(100) == said.pop(101) == ""
    assert said == {i: library.decode(ids, skip_special_tokens=False) for i, ids in enumerate(lists)}


def test_pair_check_and_merges_agree_with_the_library(rng, library):
    coder = tokenizer(vocabulary())
    words = ["".join(rng.choice("abdeinorst ") for _ in range(rng.randrange(1, 40))).strip() or "x" for _ in range(800)]
    ids = coder.encode_words([w.encode() for w in words])
    merged = [coder.merge(w.encode()) for w in words]
    assert ids == merged
    greedy = sum(coder.greedy(w.encode()) != m for w, m in zip(words, merged, strict=True))
    assert 0 < greedy < len(words)  # some proposals fail and some hold


def test_words_of_all_sizes_stay_arrays(rng):
    """Ids of short, long and empty words, those whose proposals fail too, come one word after the other with their numbers."""
    coder = bpe.Tokenizer(vocabulary())
    assert coder.encode_words([]) == [] and coder.encode_words([b""]) == [[]]
    for alphabet in ("abdeinorst ", "e0\u00e9\u6570", "a"):
        words = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, rng.randrange(90)]))).encode() for _ in range(600)]
        merged = [coder.merge(w) for w in words]
        ids, counts = coder.encode_many(words)
        assert ids.tolist() == [i for m in merged for i in m] and counts.tolist() == [len(m) for m in merged]
        short = [w for w in words if 0 < len(w) <= bpe.SIDE_BY_SIDE_BYTES]
        ids, counts = coder.merge_many(short)
        assert ids.tolist() == [i for w in short for i in coder.merge(w)] and counts.tolist() == [len(coder.merge(w)) for w in short]


def test_cache_starts_anew(spark, rng, library, monkeypatch):
    coder = bpe.Tokenizer(vocabulary())
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    from dunlake.llm.common import Slice

    for _ in range(10):
        texts = [t.encode() for t in random_texts(rng, 8)]
        part = Slice(np.arange(len(texts)), np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
        ids, bounds = coder.encode(part)
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text.decode(), add_special_tokens=False).ids


def plain_best_fit(lengths, size):
    """Best fit, longest first, one piece after the other: the number of sequences."""
    spaces = []
    for length in sorted(lengths, reverse=True):
        fitting = [s for s in spaces if s >= length]
        if fitting:
            spaces.remove(min(fitting))
            spaces.append(min(fitting) - length)
        else:
            spaces.append(size - length)
    return len(spaces)


def test_plan_is_best_fit(rng):
    for size in (7, 50, 64):
        for _ in range(40):
            lengths = [rng.randrange(1, size + 1) if rng.random() < 0.7 else rng.choice([1, 2, size]) for _ in range(rng.randrange(0, 120))]
            histogram = {n: lengths.count(n) for n in set(lengths)}
            places, ranks = {}, {}
            for length, rank, count, first, offset in plan(histogram, size):
                for k in range(count):
                    places.setdefault(first + k, []).append((offset, length))
                    ranks.setdefault(length, []).append(rank + k)
            assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
            for slots in places.values():
                at = 0
                for offset, length in sorted(slots):
                    assert offset == at
                    at += length
                assert at <= size
            assert len(places) == plain_best_fit(lengths, size)


def test_plan_does_not_grow_with_counts(rng):
    histogram = {n: rng.randrange(1, 10) for n in range(1, 300)}
    sizes = [len(plan({n: c * times for n, c in histogram.items()}, 512)) for times in (10**3, 10**6, 10**9)]
    assert sizes[2] < 1.2 * sizes[1] < 1.5 * sizes[0] < 10_000


def test_pack(spark, rng, library):
    texts = ODD + random_texts(rng, 120) + [" ".join(f"w{rng.randrange(999)}" for _ in range(n)) for n in (300, 1500, 4000, 40)] + ["same text here"] * 300
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = pack(df, vocabulary()).collect()
    by_doc, sequences = {}, {}
    for row in found:
        by_doc.setdefault(row.doc_id, []).append(row)
        sequences.setdefault(row.sequence_id, []).append(row)
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        if doc_id == 7:
            pieces = pieces[::2]
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 2048)))
        assert all(r.length == 2048 for r in pieces[1:])
        at = 0
        for row in pieces:
            assert row.start == at
            at += row.length
            assert row.ids_crc32 == zlib.crc32(np.array(ids[row.start : at], "<u4").tobytes())
        assert at == len(ids)
    for slots in sequences.values():
        at = 0
        for row in sorted(slots, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= 2048
    assert len(sequences) == plain_best_fit([r.length for r in found], 2048)


@pytest.mark.parametrize("task_pieces", [1 << 15, 100])
def test_pack_writes_files_by_rows(spark, tmp_path, monkeypatch, task_pieces):
    """Neither input partitions nor shuffle partitions make a file each, and no piece is lost or moved twice."""
    monkeypatch.setattr("dunlake.llm.packing.TASK_PIECES", task_pieces, raising=False)
    monkeypatch.setattr("dunlake.session.work_folder", lambda _: str(tmp_path / "work"))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    df = spark.range(430).selectExpr("id AS doc_id", "repeat('ab c', cast(id % 50 AS int)) AS text").repartition(24)
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        pack(df, vocabulary()).write.parquet(str(tmp_path / "out"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    assert len([*tmp_path.glob("work/pieces-*/part-*")]) <= 3
    assert len([*tmp_path.glob("out/part-*")]) <= -(-430 // task_pieces)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in found) == list(range(430)) and {r.piece for r in found} == {0}
    assert len({r.sequence_id for r in found}) == plain_best_fit([r.length for r in found], 2048)
    assert len({(r.sequence_id, r.offset) for r in found}) == 430


def test_pack_gets_texts_in_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr("dunlake.llm.packing.stored", lambda df, name: seen.append(spark.conf.get(key, None)) or stored(df, name))
    df = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    assert [r.length for r in pack(df, vocabulary()).collect()] == [2]
    assert seen[0] is not None and int(seen[0]) <= 8 << 20 and spark.conf.get(key, None) is None


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert encode(df, vocabulary()).collect() == [] and pack(df, vocabulary()).collect() == []
