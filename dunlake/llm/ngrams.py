"""Hashed n-gram multinomials of trusted texts and of the whole corpus, and the log ratio of the two."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.llm.common import Slice, rows, slices, texts, tidied
from dunlake.llm.hashing import gram_hashes, word_hashes

#: Buckets of words and word pairs. The model is one number a bucket, so its size is fixed.
BUCKET_BITS = 16
#: Pseudo-count of each bucket: rarely seen buckets say little, so small corpora are judged leniently.
PRIOR = 8.0

_COUNT_SCHEMA = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])


def features(part: Slice, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all lower-cased words and word pairs of a slice, and the text number of each."""
    words, first = word_hashes(part, lower=True)
    owner = np.repeat(np.arange(len(part)), np.diff(first))
    pairs = gram_hashes(words, 2)
    inside = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    values = np.concatenate((words, pairs[inside])) >> np.uint64(64 - bits)
    return values.astype(np.int64), np.concatenate((owner, owner[:-1][inside] if len(owner) else owner))


def trusted(labels: DataFrame) -> DataFrame:
    """All trusted documents (quality 1, not toxic in any row), one row an id: (id, trusted), where trusted is true."""
    good = (
        labels.groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("quality = 1 and toxic = 0 and id is not null")
    )
    return good.select("id", F.lit(True).alias("trusted"))


def trusted_ids(labels: DataFrame) -> np.ndarray:
    """The ids of ``trusted`` in order, to look at small label tables; the models join the table itself."""
    return np.sort(np.array([r[0] for r in trusted(labels).select("id").collect()], np.int64))


def log_ratio(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """Log ratio of each bucket's target count to the count that the raw model expects.

    Raw counts cover all documents, target counts all trusted ones. Ids and texts meet in a shuffle, whatever their number:
    a broadcast of the ids would grow with the labels. The ids are hashed there, so that no texts are sorted. Each task adds
    up its own counts, so at most one row a bucket and task is shuffled after that; what comes to the driver is one row a
    bucket.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            flags = batch.column("trusted").to_numpy(zero_copy_only=False)
            done = 0
            for part in slices(batch):
                bucket, owner = features(part, bits)
                raw += np.bincount(bucket, minlength=size)
                chosen = flags[done : done + len(part)]
                done += len(part)
                if chosen.any():
                    target += np.bincount(bucket[chosen[owner]], minlength=size)
        seen = np.flatnonzero(raw)
        yield rows(_COUNT_SCHEMA, [seen.astype(np.int32), target[seen], raw[seen]])

    flagged = texts(docs).join(trusted(labels).hint("shuffle_hash"), "id", "left")
    flagged = flagged.select("id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counted = flagged.mapInArrow(tidied(count), "bucket int, target long, raw long")
    found = counted.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()
    target, raw = np.zeros(size), np.zeros(size)
    for row in found:
        target[row[0]], raw[row[0]] = row[1], row[2]
    if not target.sum():
        return np.zeros(size)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def mean_ratios(part: Slice, ratios: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio of each text's features, zero without any, and the number of features."""
    bucket, owner = features(part, bits)
    n = np.bincount(owner, minlength=len(part))
    return np.bincount(owner, ratios[bucket], minlength=len(part)) / np.maximum(n, 1), n
