"""Line dedup by winnowing: window minima over hashed runs of lines are fingerprints; matches are extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlake.llm.common import Slice, binary, blobs, rows, ship_package, slices, stored, tidied
from dunlake.llm.hashing import IS_SPACE, gram_hashes, text_hashes, word_bounds

#: Lines in a fingerprint, and fingerprints in a window. A fingerprint is as long as the shortest run that counts, so its first
#: occurrence is a match by itself, and every repeated run is found whatever else its first lines begin with elsewhere.
GRAM_LINES = 3
WINDOW = 1
#: A run of fewer lines counts from so many words on.
LONG_WORDS = 50


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(id, version, text): rows with equal ids are told apart by a hash of their text; null text is empty."""
    ship_package(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def line_bounds(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines with a word of each text, and the text number of each line."""
    data, offsets = part.data, part.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    starts = starts[starts < len(data)]
    owner = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[owner + 1])
    filled = np.concatenate(([0], np.cumsum(~IS_SPACE[data])))
    wordy = filled[ends] > filled[starts]
    return starts[wordy], ends[wordy], owner[wordy]


_LINES = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("lines", pa.binary()), ("words", pa.binary())])


def _line_hashes(long_words: int):
    """Hash of each line of a text, and its number of words, cut at ``long_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch):
                starts, ends, owner = line_bounds(part)
                hashes = text_hashes(part.data, starts, ends)
                first, _, _ = word_bounds(part)
                words = np.minimum(np.searchsorted(first, ends) - np.searchsorted(first, starts), long_words).astype(np.uint16)
                at = np.searchsorted(owner, np.arange(len(part) + 1))
                versions = batch.column("version").slice(done, len(part))
                done += len(part)
                packed = (blobs([binary(c[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]) for c in (hashes, words))
                yield rows(_LINES, [part.ids, versions, *packed])

    return run


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the minima of all windows, the leftmost of equal ones; a shorter array has no window."""
    n = len(grams) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    best, place = grams[:n].copy(), np.arange(n)
    for k in range(1, window):
        less = grams[k : k + n] < best
        best[less] = grams[k : k + n][less]
        place[less] = np.flatnonzero(less) + k
    return np.unique(place)


def fingerprints(lines: np.ndarray, words: np.ndarray, gram_lines: int, window: int, long_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes, places and lines of the fingerprints: runs of ``gram_lines`` lines, and shorter ones of ``long_words`` words or more.

    A run is left out if both runs of one line less inside it are long: where it repeats, so do they, and they cover it.
    """
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(words.astype(np.int64))))
    covered = np.zeros(len(lines), bool)
    for size in range(1, gram_lines + 1):
        grams = gram_hashes(lines, size)
        if size < gram_lines:
            long = total[size:] - total[:-size] >= long_words
            at = np.flatnonzero(long & ~covered)
        else:
            at = winnow(grams, window)
            at = at[~covered[at]]
        yield grams[at].view(np.int64), at, size
        if size < gram_lines:
            covered = long[:-1] & long[1:]


_PRINTS = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
_PRINTS_DDL = "gram long, id long, version long, at int, size int"


def _fingerprints(gram_lines: int, window: int, long_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [], [], [], []
            for i, (lines, words) in enumerate(zip(batch.column("lines"), batch.column("words"), strict=True)):
                lines, words = np.frombuffer(lines.as_buffer(), np.uint64), np.frombuffer(words.as_buffer(), np.uint16)
                for grams, at, size in fingerprints(lines, words, gram_lines, window, long_words):
                    if len(at):
                        for column, value in zip(found, (grams, at, np.full(len(at), size), np.full(len(at), i)), strict=True):
                            column.append(value)
            grams, at, sizes, owner = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
            owner = pa.array(owner)
            yield rows(_PRINTS, [grams, batch.column("id").take(owner), batch.column("version").take(owner), at.astype(np.int32), sizes.astype(np.int32)])

    return run


def extend(lines: np.ndarray, source: np.ndarray, places: list[tuple[int, int]], gram_lines: int, least: int) -> list[tuple[int, int]]:
    """Runs of ``lines`` to delete: each match of a fingerprint, extended both ways, of ``least`` lines or more.

    Fingerprints inside a run that is already deleted are passed over. Within one text a run may overlap its source, as it
    is later than the source at every place.
    """
    runs: list[tuple[int, int]] = []
    for at, source_at in sorted(places):
        if runs and at >= runs[-1][0] and at + gram_lines <= runs[-1][1]:
            continue
        most = min(len(lines) - at, len(source) - source_at)
        right = _agree(lines[at : at + most], source[source_at : source_at + most])
        most = min(at, source_at)
        left = _agree(lines[at - most : at][::-1], source[source_at - most : source_at][::-1])
        if left + right >= least:
            runs.append((at - left, at + right))
    return runs


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, looked at in growing steps."""
    done, step = 0, 16
    while done < len(a):
        differ = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = min(done + step, len(a)), step * 4
    return done


_RUNS = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _extended(gram_lines: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], []
            columns = (batch.column(c) for c in ("id", "version", "at", "source_at", "size", "lines", "source_lines"))
            for id_, version, at, source_at, sizes, lines, source in zip(*columns, strict=True):
                lines, source = np.frombuffer(lines.as_buffer(), np.uint64), np.frombuffer(source.as_buffer(), np.uint64)
                places = {}
                for size, *place in zip(sizes.as_py(), at.as_py(), source_at.as_py(), strict=True):
                    places.setdefault(size, []).append(tuple(place))
                runs = [run for size, of in places.items() for run in extend(lines, source, of, size, least if size == gram_lines else size)]
                if runs:
                    for column, value in zip(out, (id_.as_py(), version.as_py(), [a for a, _ in runs], [b for _, b in runs]), strict=True):
                        column.append(value)
            yield rows(_RUNS, list(out))

    return run


def repeated_runs(docs: DataFrame, gram_lines: int = GRAM_LINES, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """Later repeated runs of lines: (id, version, starts, ends), numbered among the lines with a word, one row per text.

    Fingerprints are hashes of ``gram_lines`` consecutive lines that are the smallest of ``window`` neighbours, and of fewer
    lines with ``long_words`` words or more. Each one is compared with its first occurrence (smallest id, version and place),
    and the match is extended both ways while lines are equal. It counts from ``long_words`` words of a fingerprint on, else
    from ``gram_lines + window - 1`` lines on. With a window of one every repeated run is found; a
    wider one misses runs whose fingerprints occur first in a shorter match. Rows without id neither give nor lose lines.

    Only line hashes are shuffled. First occurrences are pre-aggregated; a fingerprint of very many texts is joined with
    one row, which skew handling splits.
    """
    hashed = keyed_texts(docs.where("doc_id is not null")).mapInArrow(tidied(_line_hashes(long_words)), "id long, version long, lines binary, words binary")
    lines = stored(hashed.dropDuplicates(["id", "version"]), "line-hashes")
    prints = stored(lines.mapInArrow(tidied(_fingerprints(gram_lines, window, long_words)), _PRINTS_DDL), "line-fingerprints")
    first = F.min(F.struct("id", "version", "at")).alias("source")
    firsts = prints.groupBy("gram").agg(F.count("*").alias("n"), first).where("n > 1").select(
        "gram", F.col("source.id").alias("source_id"), F.col("source.version").alias("source_version"), F.col("source.at").alias("source_at")
    )
    matches = prints.join(firsts, "gram").where("id != source_id or version != source_version or at != source_at")
    pairs = matches.groupBy("id", "version", "source_id", "source_version").agg(
        F.collect_list(F.struct("at", "source_at", "size")).alias("places")
    )
    lines = lines.drop("words")
    source = lines.select(F.col("id").alias("source_id"), F.col("version").alias("source_version"), F.col("lines").alias("source_lines"))
    sided = pairs.join(lines, ["id", "version"]).join(source, ["source_id", "source_version"])
    runs = sided.select(
        "id", "version", F.col("places.at").alias("at"), F.col("places.source_at").alias("source_at"), F.col("places.size").alias("size"), "lines", "source_lines"
    ).mapInArrow(tidied(_extended(gram_lines, gram_lines + window - 1)), "id long, version long, starts array<int>, ends array<int>")
    return runs.groupBy("id", "version").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def without_lines(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """Text without the runs, its lines with a word, those removed, and the maximal removed runs.

    Blank lines between two removed lines of one run go with them.
    """
    lines = text.split("\n")
    wordy = [i for i, line in enumerate(lines) if line.strip(" \t\v\f\r")]
    gone, removed, spans = set(), 0, 0
    last = -1
    for start, end in sorted(runs):
        if start > last:
            spans += 1
        removed += max(0, end - max(start, last))
        gone.update(range(wordy[start], wordy[end - 1] + 1))
        last = max(last, end)
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(wordy), removed, spans


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("row", "text", "n_lines", "n_removed", "n_spans")
    for batch in batches:
        said, wordy, removed, spans = [], [], [], []
        for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends"), strict=True):
            runs = list(zip(starts.as_py(), ends.as_py(), strict=True)) if starts.is_valid else []
            clean, *counts = without_lines(text.as_py() or "", runs)
            said.append(clean if text.is_valid else None)
            for column, value in zip((wordy, removed, spans), counts, strict=True):
                column.append(value)
        counts = [pa.array(c, pa.int64()) for c in (wordy, removed, spans)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(said, pa.string()), *counts], names=names)


def _with_clean_text(docs: DataFrame, gram_lines: int, window: int) -> DataFrame:
    """(row, text, n_lines, n_removed, n_spans): row holds the other columns of ``docs``."""
    runs = repeated_runs(docs, gram_lines, window)
    version = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    others = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    given = docs.select(others, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), version.alias("version"))
    joined = given.join(runs, ["id", "version"], "left").select("row", "text", "starts", "ends")
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("text", T.StringType())])
    for name in ("n_lines", "n_removed", "n_spans"):
        schema = schema.add(name, T.LongType())
    return joined.mapInArrow(tidied(_cleaned), schema)


def dedup_lines(docs: DataFrame, gram_lines: int = GRAM_LINES, window: int = WINDOW) -> DataFrame:
    """``docs`` with (doc_id, text) without later repeated runs of lines: (doc_id, text, n_lines, n_removed, n_spans).

    A run is deleted where ``repeated_runs`` finds it: three lines with a word or more, or fewer with LONG_WORDS words or
    more, equal to lines that begin earlier (smaller id, or the same text further up). One row per row of ``docs``; rows of equal id and text are one text.
    Null text stays null and has no lines, rows without id stay as they are; other columns don't matter.
    """
    return _with_clean_text(docs, gram_lines, window).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "n_lines", "n_removed", "n_spans")


def clean_lines(docs: DataFrame, gram_lines: int = GRAM_LINES, window: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns and cleaned texts; n_chars follows the text. Texts that lost all their lines go."""
    clean = _with_clean_text(docs, gram_lines, window).where("n_removed = 0 or n_removed < n_lines")
    return with_new_text(docs, clean)


def with_new_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Columns of ``docs`` in their order, from (row, text); n_chars is the length of the new text."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return changed.select([(new.get(c, F.col("row")[c])).alias(c) for c in docs.columns])
