"""Counts of the quality rules against plain Python, and both judges on held-out labels."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from dunlake.llm import ngrams
from dunlake.llm.classifier import SEED, TEMPERATURE, keep_quality, kth_largest, resample, target_share
from dunlake.llm.common import table
from dunlake.llm.quality import THRESHOLD, quality_rules

SCHEMA = "doc_id long, text string, kept string, score int"
LABELS = "doc_id long, quality int, toxic int, text string"
FOLDER = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts(rng, n=150):
    bits = ["a", "bc", "é", "#x", "||", " ", "\n", "\t", "\x0b", "\x0c", "\r", "the cat sat ", "one two three four\n", "\u00a0", "\u2003x"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_counts(spark, rng):
    rows = [(i, t, "x", 1) for i, t in enumerate([None, "", " \n\n ", "x", "a\na\na", "a b c a b c", *texts(rng), "w " * 20000])] + [(None, "a a a a", "x", 1), (3, "x", "x", 1)]
    labels = spark.createDataFrame([(i, i % 2, 0, "t") for i in range(0, 60, 2)], LABELS)
    got = quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(4), labels).collect()
    expected = [(i, *counts(t)) for i, t, *_ in rows]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(expected, key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_empty_tables(spark, rng):
    docs = spark.createDataFrame([(1, "word " * 60, "x", 1), (2, " ".join(f"w{i}" for i in range(60)), "x", 1)], SCHEMA)
    none, no_labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert quality_rules(none, no_labels).collect() == [] and resample(none, no_labels).collect() == [] and keep_quality(none, no_labels).collect() == []
    assert {r.doc_id: (r.score, r.kept) for r in quality_rules(docs, no_labels).collect()} == {1: (0.0, False), 2: (0.0, True)}
    assert [r.kept for r in resample(docs, no_labels).collect()] == [True, True]


def held_out(spark):
    labels = table(spark, FOLDER, "labels").toPandas()
    return labels, labels.sample(frac=0.5, random_state=1)


@pytest.mark.parametrize("judge", [quality_rules, resample])
def test_held_out_labels(spark, judge):
    """Fitted on half of the labels: clean documents of the other half stay, most junk goes."""
    labels, half = held_out(spark)
    docs = table(spark, FOLDER, "documents")
    drawn = {"k": round(0.86 * docs.count())} if judge is resample else {}
    kept = {r.doc_id: r for r in judge(docs, spark.createDataFrame(half), **drawn).collect()}
    rest = labels[~labels.doc_id.isin(half.doc_id)]
    if judge is quality_rules:
        rest = rest[[not kept[i].base_failed for i in rest.doc_id]]
    good = [kept[i].kept for i, q, t in zip(rest.doc_id, rest.quality, rest.toxic, strict=True) if q == 1 and t == 0]
    junk = [kept[i].kept for i, q in zip(rest.doc_id, rest.quality, strict=True) if q == 0]
    assert np.mean(good) >= 0.97 and np.mean(junk) <= 0.3


def test_resample_takes_k_and_repeats_itself(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    first = {r.doc_id for r in resample(docs, labels, k=100).where("kept").collect()}
    again = {r.doc_id for r in resample(docs.repartition(5), labels, k=100).where("kept").collect()}
    other = {r.doc_id for r in resample(docs, labels, k=100, seed=5).where("kept").collect()}
    assert len(first) == 100 and first == again != other


def test_keep_quality_equals_resample(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in resample(docs, labels).where("kept").collect()}


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e9), 0.0, 1.0, 1.0 + 2**-52]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for k in (1, 2, 17, 250, 499, 500, 600):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, 500) - 1]
    assert kth_largest(df, "v", 0) is None


def ngrams_of(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [(w,) for w in words] + list(zip(words, words[1:]))


def mean_log_ratios(docs, trusted):
    """Mean log ratio of the n-grams of each text, over n-grams themselves instead of buckets; null without words."""
    target, raw = Counter(), Counter()
    for doc_id, text in docs:
        raw.update(ngrams_of(text))
        if doc_id in trusted:
            target.update(ngrams_of(text))
    share = sum(target.values()) / sum(raw.values())
    ratio = {g: math.log((target[g] + ngrams.PRIOR) / (n * share + ngrams.PRIOR)) for g, n in raw.items()}
    return [sum(ratio[g] for g in grams) / len(grams) if (grams := ngrams_of(text)) else None for _, text in docs]


def gumbel(doc_id):
    """Noise of an id: 64-bit xxHash of the id, then of the seed, as a number between 0 and 1."""
    first = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    number = xxhash.xxh64_intdigest(struct.pack("<i", SEED), first)
    return -math.log(-math.log(((number >> 11) + 0.5) / (1 << 53)))


def scored_corpus(rng):
    """Texts of few different n-grams, so that hardly any share a bucket; nulls, empty and repeated rows, ties."""
    good, bad = [f"good{i}" for i in range(6)], [f"Bad{i}" for i in range(6)]
    docs = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randrange(1, 120)))) for i in range(120)]
    docs += [docs[4], docs[4], (None, docs[7][1]), (None, None), (200, None), (201, ""), (202, " \n"), (203, docs[5][1]), (204, docs[5][1])]
    labels = [(i, int(i % 3 > 0), int(i % 10 == 0), "t") for i in range(0, 60)] + [(3, 1, 0, "t"), (None, 1, 0, "t"), (5, None, None, "t")]
    trusted = {i for i in range(60) if i % 3 and i % 10 and i != 5} | {5}
    return docs, labels, trusted


def test_scores_and_draw_against_brute_force(spark, rng):
    docs, labels, trusted = scored_corpus(rng)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(4)
    labelled = spark.createDataFrame(labels, LABELS)
    assert set(ngrams.trusted_ids(labelled).tolist()) == trusted
    means = mean_log_ratios(docs, trusted)
    order = lambda r: tuple((v is not None, v or 0) for v in r)

    got = sorted(((r.doc_id, r.score, r.kept) for r in quality_rules(df, labelled).collect()), key=order)
    expected = sorted(((d[0], m or 0.0, not counts(d[1])[5] and (m or 0.0) >= THRESHOLD) for d, m in zip(docs, means, strict=True)), key=order)
    assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in expected]
    assert [r[1] for r in got] == pytest.approx([r[1] for r in expected], abs=1e-9)

    keys = [None if m is None else m / TEMPERATURE + gumbel(d[0]) for d, m in zip(docs, means, strict=True)]
    for k in (None, 1, 17, len(docs)):
        n = round(len(docs) * target_share(labelled)) if k is None else k
        weighted = sorted((key for key in keys if key is not None), reverse=True)
        least = weighted[min(n, len(weighted)) - 1]
        rows = sorted(((r.doc_id, r.gumbel_key, r.kept) for r in resample(df, labelled, k).collect()), key=order)
        whole = sorted(((d[0], key, key is not None and key >= least) for d, key in zip(docs, keys, strict=True)), key=order)
        assert [(r[0], r[2]) for r in rows] == [(r[0], r[2]) for r in whole]
        assert [r[1] or 0 for r in rows] == pytest.approx([r[1] or 0 for r in whole], abs=1e-6)


def test_every_trusted_document_counts(spark, rng):
    """More trusted documents than the 20,000 that once bounded the target model."""
    good, bad = [f"good{i}" for i in range(6)], [f"bad{i}" for i in range(6)]
    docs = [(i, " ".join(rng.choice(good if i % 8 else bad) for _ in range(3))) for i in range(26_000)]
    docs += [docs[1], (None, "good1 bad1"), (30_000, None)]
    labels = [(i, int(i % 8 > 0), 0, "t") for i in range(26_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    got = {r.doc_id: r.score for r in quality_rules(df, spark.createDataFrame(labels, LABELS)).collect()}
    means = mean_log_ratios(docs, {i for i, quality, *_ in labels if quality})
    assert len(got) == len(docs) - 1
    for (doc_id, _), mean in zip(docs, means, strict=True):
        assert got[doc_id] == pytest.approx(mean or 0.0, abs=1e-9)
