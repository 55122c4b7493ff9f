"""Quality classifier: importance resampling by hashed n-gram models of target and raw text, with Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlake.llm.common import rows, slices, stored, texts, tidied
from dunlake.llm.ngrams import log_ratio, mean_ratios

#: Log weights are mean log ratios divided by this; the Gumbel noise has scale 1.
TEMPERATURE = 0.01
SEED = 17
#: Keys are counted in so many steps of a range, and the step that holds the k-th is counted again.
STEPS = 4096

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64())])


def log_weights(docs: DataFrame, ratios: np.ndarray, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, log_weight), one row per row of ``docs``; null where a text has no words."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch):
                mean, n = mean_ratios(part, ratios)
                ids = batch.column("id").slice(done, len(part))
                done += len(part)
                yield rows(_SCHEMA, [ids, pa.array(mean / temperature, pa.float64(), mask=n == 0)])

    return texts(docs).mapInArrow(tidied(weigh), "doc_id long, log_weight double")


def with_gumbel_key(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """Add gumbel_key: log weight plus Gumbel noise that only depends on the id and the seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, by counting values in ever narrower ranges; ties are not broken.

    The driver holds one count a step. The range shrinks by the number of steps each time, so a few passes over the
    stored column give the exact value.
    """
    if k < 1:
        return None
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0:
        return None
    if k >= n:
        return low
    value, left = F.col(column), k
    while low < high:
        width = (high - low) / STEPS
        if low + width <= low or high - width >= high:
            break
        step = F.least(F.floor((value - low) / width), F.lit(STEPS - 1)).cast("int")
        counts = keys.where((value >= low) & (value <= high)).groupBy(step.alias("step")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(counts.collect(), key=lambda r: -r["step"]):
            if left <= row["n"]:
                low, high = row["low"], row["high"]
                break
            left -= row["n"]
    if low == high:
        return low
    # Only neighbouring floating-point numbers are left: a handful of distinct values.
    for row in keys.where((value >= low) & (value <= high)).groupBy(column).count().orderBy(F.desc(column)).collect():
        if left <= row["count"]:
            return row[column]
        left -= row["count"]
    return low


def target_share(labels: DataFrame) -> float:
    """Share of labelled documents with quality 1, plus two standard errors; 1 without labels."""
    per_doc = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n, good = per_doc.agg(F.count("*"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    if not n:
        return 1.0
    share = good / n
    return min(1.0, share + 2 * (share * (1 - share) / n) ** 0.5)


def least_key(keyed: DataFrame, labels: DataFrame, k: int | None = None) -> float | None:
    """Smallest key of the draw of k rows, by default the number of rows times ``target_share``; null for an empty draw."""
    return kth_largest(keyed, "gumbel_key", round(keyed.count() * target_share(labels)) if k is None else k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Draw k documents without replacement, each with odds by its importance weight: (doc_id, log_weight, gumbel_key, kept).

    The weight of a document is the ratio of two hashed n-gram models, fitted on trusted documents and on all documents,
    as the mean over its n-grams divided by ``temperature``. Adding Gumbel noise and taking the k largest keys is such a
    draw. ``k`` is by default the number of documents times the share of quality 1 among labels (``target_share``).
    Returns one row per row of ``docs``. A text without words has no weight and is never kept. Rows with equal ids and
    texts have equal keys; of equal keys at the last place all are kept. Null ids share one noise value; without trusted
    documents every weight is equal. Other columns don't matter.
    """
    keyed = stored(with_gumbel_key(log_weights(docs, log_ratio(docs, labels), temperature), seed), "gumbel-keys")
    least = least_key(keyed, labels, k)
    kept = F.lit(False) if least is None else F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False))
    return keyed.withColumn("kept", kept)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``resample`` keeps, with all their columns.

    The draw fixes the smallest key that is kept; a second pass over the texts then keeps rows by it, without a shuffle.
    """
    ratios = log_ratio(docs, labels)
    least = least_key(stored(with_gumbel_key(log_weights(docs, ratios)), "gumbel-keys"), labels)
    if least is None:
        return docs.limit(0)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("doc_id", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch):
                mean, n = mean_ratios(part, ratios)
                row, ids = (batch.column(c).slice(done, len(part)) for c in ("row", "id"))
                done += len(part)
                weights = pa.array(mean / TEMPERATURE, pa.float64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([row, ids, weights], names=["row", "doc_id", "log_weight"])

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_gumbel_key(whole.mapInArrow(tidied(weigh), schema)).where(F.col("gumbel_key") >= F.lit(least)).select("row.*")
