"""Quality rules: counts of each text, and the length-normalised log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dunlake.llm.common import Slice, rows, slices, texts, tidied
from dunlake.llm.hashing import IS_SPACE, gram_hashes, text_hashes, word_bounds
from dunlake.llm.ngrams import log_ratio, mean_ratios

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is kept if the mean log ratio of its n-grams is at least this.
THRESHOLD = -0.1

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]
)
_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, score double, kept boolean"
)


def _between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each value, whether its text has it more than once; 2 at the second and later places, 1 at the first."""
    order = np.lexsort((values, owner))
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(values), np.int8)
    out[order] = np.where(same[:-1], 2, same[1:].astype(np.int8))
    return out


def text_counts(part: Slice) -> dict[str, np.ndarray]:
    """The five counts of each text of a slice."""
    data, offsets = part.data, part.offsets
    starts, ends, first = word_bounds(part)
    n_words = np.diff(first)
    inner = ~IS_SPACE[data]
    # lines with a word, equal to an earlier one of the text
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    text_of = np.searchsorted(offsets, line_starts, "right") - 1
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)]
    line_ends = np.minimum(next_break, offsets[text_of + 1])
    filled = np.concatenate(([0], np.cumsum(inner)))
    wordy = filled[line_ends] > filled[line_starts]
    line_starts, line_ends, text_of = line_starts[wordy], line_ends[wordy], text_of[wordy]
    repeated = _repeats(text_hashes(data, line_starts, line_ends), text_of) == 2
    # words in windows of three that are found twice or more in the text
    words = text_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(part)), n_words)
    covered = np.zeros(len(words) + 2, bool)
    windows = gram_hashes(words, 3)
    if len(windows):
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        hit = whole[_repeats(windows[whole], owner[whole]) > 0]
        for k in range(3):
            covered[hit + k] = True
    return {
        "n_words": n_words,
        "word_chars": _between(inner & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _between(IS_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(text_of[repeated], minlength=len(part)),
        "n_repeat_words": np.bincount(owner[covered[: len(words)]], minlength=len(part)),
    }


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every document of (doc_id, text): counts, base_failed, score and kept, one row per row of ``docs``.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows of three. score: mean log ratio
    of hashed words and word pairs between trusted documents (labels with quality 1 and not toxic) and the whole corpus;
    kept: not base_failed and score >= ``threshold``. Null or empty text has no words and fails; without any trusted
    document all scores are zero; null ids, repeated rows and other columns are taken as they are. No row depends on
    others except through the two models.
    """
    ratios = log_ratio(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null_ids = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            done = 0
            for part in slices(batch):
                counts = text_counts(part)
                score, _ = mean_ratios(part, ratios)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                ids = batch.column("id").slice(done, len(part)) if not null_ids.all() else pa.array(part.ids, pa.int64())
                done += len(part)
                yield rows(_SCHEMA, [ids, *counts.values(), failed, score, ~failed & (score >= threshold)])

    return texts(docs).mapInArrow(tidied(judge), _DDL)
