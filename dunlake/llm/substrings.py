"""Suffix dedup of byte spans: suffixes are put into buckets, and each bucket is sorted by itself.

A text's suffixes of interest are its windows of SPAN bytes. The bucket of a window is the smallest hashed gram of
GRAM bytes in it, so equal windows share bucket and offset from the gram, and neighbouring windows mostly share a gram.
Grams found once in the corpus need no sorting. For the others the bytes around the gram (its context) go to the bucket,
equal contexts only once. A bucket's windows are sorted by their first 32 bytes; long ties are resolved by ranks of a
difference-cover sample: of any two windows some place within COVER_PERIOD bytes is in the sample for both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunlake.llm.common import Slice, binary, blobs, byte_column, cut, rows, shuffle_partitions, slices, stored, tidied
from dunlake.llm.hashing import BASE_INVERSE, BYTE_VALUES, mix, powers, prefix_sums
from dunlake.llm.lines import keyed_texts, with_new_text

SPAN = 100
GRAM = 32
#: Cover of all differences modulo COVER_PERIOD: a perfect difference set.
COVER_PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
#: Bytes of contexts that a task compares or packs at once.
BLOCK_BYTES = 8 << 20
#: Windows of a text that are numbered at once; places in a slice must fit 24 bits.
PIECE_BYTES = 1 << 22
_LOW = np.uint64((1 << 24) - 1)


def _shift_table() -> np.ndarray:
    """For residues (a, b): the smallest d with a + d and b + d both in the cover."""
    cover = set(COVER)
    table = np.zeros((COVER_PERIOD, COVER_PERIOD), np.int64)
    for a in range(COVER_PERIOD):
        for b in range(COVER_PERIOD):
            table[a, b] = next(d for d in range(COVER_PERIOD) if (a + d) % COVER_PERIOD in cover and (b + d) % COVER_PERIOD in cover)
    return table


SHIFTS = _shift_table()


def _pieces(part: Slice) -> Iterator[tuple[Slice, np.ndarray]]:
    """The slice itself, or a long text cut so that every window is in one piece; with each text's place in its document."""
    if len(part.data) <= PIECE_BYTES:
        yield part, np.zeros(len(part), np.int64)
        return
    for i in range(len(part)):
        low, high = int(part.offsets[i]), int(part.offsets[i + 1])
        for at in range(low, max(low + 1, high - SPAN + 1), PIECE_BYTES):
            end = min(high, at + PIECE_BYTES + SPAN - 1)
            yield Slice(part.ids[i : i + 1], part.data[at:end], np.array([0, end - at])), np.array([at - low])


def bucketed(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one gram: text number, first window, number of windows, place of the gram, hash of the gram."""
    data, n = part.data, len(part.data)
    empty = np.zeros(0, np.int64)
    if n < SPAN:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    sums = prefix_sums(BYTE_VALUES[data])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(BASE_INVERSE, n + 1)[: n - GRAM + 1])
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    least, width, reach = keys, 1, SPAN - GRAM + 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    place = (least & _LOW).astype(np.int64)
    sizes = np.maximum(np.diff(part.offsets) - SPAN + 1, 0)
    owner = np.repeat(np.arange(len(part)), sizes)
    if not len(owner):
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    window = np.repeat(part.offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))
    gram = place[window]
    edge = np.flatnonzero((gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])) + 1
    start = np.concatenate(([0], edge))
    count = np.diff(np.append(start, len(owner)))
    return owner[start], window[start], count, gram[start], grams[gram[start]]


# ---- grams found more than once -----------------------------------------------------------------------------------

_SEEN = pa.schema([("bucket", pa.int32()), ("sure", pa.bool_()), ("grams", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())])
_SEEN_DDL = "bucket int, sure boolean, grams binary, ids binary, places binary"


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % buckets


def _gram_lists(buckets: int):
    """A task's grams by bucket, each once; all occurrences of what it has more than once go on as sure."""

    def flush(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        grams, ids, places = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(grams, kind="stable")
        grams, ids, places = grams[order], ids[order], places[order]
        first = np.concatenate(([True], grams[1:] != grams[:-1]))
        again = ~first
        several = again.copy()
        several[:-1] |= again[1:]
        for sure, chosen in ((False, first), (True, several)):
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            bucket = _dealt(grams[at], buckets)
            by = np.argsort(bucket, kind="stable")
            keys, bounds = cut(by, bucket)
            at = at[by]
            lists = [[binary(x[at[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for x in (ids, places)]
            kept = [b"" if sure else binary(grams[at[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield rows(_SEEN, [keys.astype(np.int32), [sure] * len(keys), blobs(kept), blobs(lists[0]), blobs(lists[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for whole in slices(batch):
                for part, base in _pieces(whole):
                    owner, _, _, gram, hashes = bucketed(part)
                    if len(owner):
                        found.append((hashes, part.ids[owner], (gram - part.offsets[owner] + base[owner]).astype(np.uint32)))
                        size += len(owner)
            if size > BLOCK_BYTES // 4:
                yield from flush(found)
                found, size = [], 0
        if size:
            yield from flush(found)

    return run


_HINTS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("places", pa.binary())])


def _by_document(ids: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """Arrays dealt by a hash of the document."""
    part = (mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    keys, bounds = cut(by, part)
    for key, a, b in zip(keys.tolist(), bounds[:-1], bounds[1:], strict=True):
        yield key, [binary(c[by[a:b]]) for c in [ids, *columns]]


def _repeated_grams(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list[tuple]] = {}
        sure_ids, sure_places = [], []
        for batch in batches:
            for bucket, sure, grams, ids, places in zip(*batch.columns, strict=True):
                ids, places = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(places.as_buffer(), np.uint32)
                if sure.as_py():
                    sure_ids.append(ids)
                    sure_places.append(places)
                else:
                    lists.setdefault(bucket.as_py(), []).append((np.frombuffer(grams.as_buffer(), np.uint64), ids, places))
        for found in lists.values():
            grams, ids, places = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(grams, kind="stable")
            same = np.zeros(len(grams) + 1, bool)
            same[1:-1] = grams[order][1:] == grams[order][:-1]
            chosen = order[same[1:] | same[:-1]]
            sure_ids.append(ids[chosen])
            sure_places.append(places[chosen])
        if sure_ids:
            ids, places = np.concatenate(sure_ids), np.concatenate(sure_places)
            out = list(_by_document(ids, [places], buckets))
            if out:
                yield rows(_HINTS, [[k for k, _ in out], blobs([c[0] for _, c in out]), blobs([c[1] for _, c in out])])

    return run


_HINT = pa.schema([("id", pa.int64()), ("places", pa.binary())])


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, places = [], []
    for batch in batches:
        for _, i, p in zip(*batch.columns, strict=True):
            ids.append(np.frombuffer(i.as_buffer(), np.int64))
            places.append(np.frombuffer(p.as_buffer(), np.uint32))
    if not ids:
        return
    ids, places = np.concatenate(ids), np.concatenate(places)
    order = np.lexsort((places, ids))
    keys, bounds = cut(order, ids)
    places = places[order]
    for at in range(0, len(keys), 10_000):
        chosen = slice(at, at + 10_000)
        yield rows(_HINT, [keys[chosen], blobs([binary(places[a:b]) for a, b in zip(bounds[:-1][chosen], bounds[1:][chosen], strict=True)])])


# ---- contexts of repeated grams -----------------------------------------------------------------------------------

_CONTEXTS = pa.schema(
    [("bucket", pa.int32()), ("sure", pa.bool_())]
    + [(n, pa.binary()) for n in ("grams", "ids", "versions", "windows", "counts", "offsets", "bytes")]
)
_CONTEXTS_DDL = "bucket int, sure boolean, grams binary, ids binary, versions binary, windows binary, counts binary, offsets binary, bytes binary"
#: Columns of a run of windows besides its bytes: gram, id, version, first window in the document, number of windows, offset of the gram.
_KINDS = (np.uint64, np.int64, np.int64, np.int64, np.uint16, np.uint16)


def _chunks(sizes: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of pieces with about ``limit`` bytes, as arrays of places take eight times the bytes."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, stop
        at = stop


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of many pieces, one after the other."""
    out = np.empty(int(sizes.sum()), np.uint8)
    done = 0
    for a, b in _chunks(sizes):
        size = sizes[a:b]
        before = np.cumsum(size) - size
        part = data[np.repeat(starts[a:b] - before, size) + np.arange(int(size.sum()))]
        out[done : done + len(part)] = part
        done += len(part)
    return out


class Contexts:
    """Runs of windows with the bytes that they cover."""

    def __init__(self, columns: list[np.ndarray], data: np.ndarray):
        self.columns, self.data = columns, data
        self.sizes = columns[4].astype(np.int64) + SPAN - 1
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, at: np.ndarray) -> Contexts:
        return Contexts([c[at] for c in self.columns], _gather(self.data, self.starts[at], self.sizes[at]))

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), np.uint64)
        for a, b in _chunks(self.sizes):
            low = self.starts[a]
            sums = prefix_sums(BYTE_VALUES[self.data[low : self.starts[b]]])
            begin = self.starts[a:b] - low
            out[a:b] = (sums[self.starts[a + 1 : b + 1] - low] - sums[begin]) * powers(BASE_INVERSE, len(sums))[begin]
        return mix(out)

    def copies(self) -> tuple[np.ndarray, np.ndarray]:
        """The earliest run of each distinct context, and the other runs. Equal contexts have equal gram, count, offset and bytes."""
        grams, ids, versions, windows, counts, offsets = self.columns
        whole = self.hashes()
        shape = counts.astype(np.int64) << 16 | offsets
        order = np.lexsort((windows, versions, ids, whole, shape, grams))
        head = np.ones(len(order), bool)
        for c in (grams, shape, whole):
            head[1:] &= c[order][1:] == c[order][:-1]
        head[0] = False
        same = head  # equal to the one before by hash: compare the bytes with the first of the run
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        doubt = np.flatnonzero(same)
        if len(doubt):
            sizes = self.sizes[order[doubt]]
            wrong = np.zeros(len(doubt), bool)
            for low, high in _chunks(sizes):
                size = sizes[low:high]
                mine, other = (_gather(self.data, self.starts[x[doubt[low:high]]], size) for x in (order, order[first]))
                wrong[low:high] = np.add.reduceat(mine != other, np.cumsum(size) - size) > 0
            same[doubt[wrong]] = False  # a collision of hashes: its own context, compared in the sort
        # a repeated row is the first run itself and no copy of it
        lead = order[first]
        twin = same & (ids[order] == ids[lead]) & (versions[order] == versions[lead]) & (windows[order] == windows[lead])
        return order[~same], order[same & ~twin]


def _packed(found: Contexts, sure: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(found):
        return
    bucket = _dealt(found.columns[0], buckets)
    by = np.argsort(bucket, kind="stable")
    keys, bounds = cut(by, bucket)
    found = Contexts([c[by] for c in found.columns], np.zeros(0, np.uint8)) if sure else found.take(by)
    columns = [[binary(c[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for c in found.columns]
    data = [b"" if sure else binary(found.data[found.starts[a] : found.starts[b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    yield rows(_CONTEXTS, [keys.astype(np.int32), [sure] * len(keys), *map(blobs, columns), blobs(data)])


def _context_lists(buckets: int):
    def flush(found: list[Contexts]) -> Iterator[pa.RecordBatch]:
        joined = Contexts([np.concatenate(c) for c in zip(*(f.columns for f in found), strict=True)], np.concatenate([f.data for f in found]))
        first, copies = joined.copies()
        yield from _packed(joined.take(first), False, buckets)
        yield from _packed(joined.take(copies), True, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        found, size = [], 0
        for batch in batches:
            for id_, version, text, places in zip(*batch.columns, strict=True):
                data = np.frombuffer(opener.decompress(text.as_buffer()), np.uint8)
                wanted = np.frombuffer(places.as_buffer(), np.uint32)
                whole = Slice(np.array([id_.as_py()]), data, np.array([0, len(data)]))
                for part, base in _pieces(whole):
                    _, window, count, gram, hashes = bucketed(part)
                    hit = np.flatnonzero(np.isin(gram + base[0], wanted))
                    if not len(hit):
                        continue
                    n = len(hit)
                    columns = [hashes[hit], np.full(n, id_.as_py()), np.full(n, version.as_py()), window[hit] + base[0], count[hit], (gram - window)[hit]]
                    columns = [c.astype(k) for c, k in zip(columns, _KINDS, strict=True)]
                    sizes = count[hit] + SPAN - 1
                    found.append(Contexts(columns, _gather(part.data, window[hit], sizes)))
                    size += int(sizes.sum())
                    if size >= 2 * BLOCK_BYTES:
                        yield from flush(found)
                        found, size = [], 0
        if found:
            yield from flush(found)

    return run


def cover_ranks(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the byte strings of ``length`` at the given places, at every place of ``data`` (-1 elsewhere)."""
    ranks = np.full(len(data), -1, np.int64)
    if len(places):
        keys = [_word(data, places + k) for k in [*range(0, length - 7, 8), length - 8]]
        order = np.lexsort(keys[::-1])
        differ = np.zeros(len(order), bool)
        for key in keys:
            differ[1:] |= key[order][1:] != key[order][:-1]
        ranks[places[order]] = np.cumsum(differ)
    return ranks


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each place as one number in byte order."""
    words = np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data), strides=(1,))
    return words[at].astype(np.uint64)


def repeated_windows(found: Contexts) -> np.ndarray:
    """Windows of the contexts, in their order, that are equal to an earlier window (by id, version and place)."""
    grams, ids, versions, windows, counts, offsets = found.columns
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    owner = np.repeat(np.arange(len(found)), counts)
    step = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at = found.starts[:-1][owner] + step
    data = found.data
    # ranks of the cover sample, for strings that end where a window ends that begins up to a period earlier
    tail = SPAN - COVER_PERIOD + 1
    inside = np.zeros(len(data), bool)
    inside[np.arange(len(data)) <= np.repeat(found.starts[1:], found.sizes) - tail] = True
    sample = np.isin(np.arange(len(data)) % COVER_PERIOD, COVER) & inside
    ranks = cover_ranks(data, np.flatnonzero(sample), tail)
    # sort by first and last bytes; ids break ties, so the first of a tie is the earliest
    keys = [_word(data, at + k) for k in (0, 8, 16, 24, SPAN - 32, SPAN - 24, SPAN - 16, SPAN - 8)]
    order = np.lexsort((windows[owner] + step, versions[owner], ids[owner], *keys[::-1]))
    tie = np.zeros(total, bool)
    tie[1:] = True
    for key in keys:
        tie[1:] &= key[order][1:] == key[order][:-1]
    group = np.cumsum(~tie)
    repeated = np.zeros(total, bool)
    rest = order
    group_of = group
    while len(rest):
        head = np.ones(len(rest), bool)
        head[1:] = group_of[1:] != group_of[:-1]
        leader = rest[np.maximum.accumulate(np.where(head, np.arange(len(rest)), 0))]
        shift = SHIFTS[at[rest] % COVER_PERIOD, at[leader] % COVER_PERIOD]
        equal = ranks[at[rest] + shift] == ranks[at[leader] + shift]
        repeated[rest[equal & ~head]] = True
        left = ~equal
        rest, group_of = rest[left], group_of[left]
    return repeated


_RUNS = pa.schema([("part", pa.int32())] + [(n, pa.binary()) for n in ("ids", "versions", "starts", "ends")])


def _sorted_buckets(parts: int):
    """Removed byte ranges of each bucket, dealt by document."""

    def compare(found: Contexts) -> Iterator[tuple[np.ndarray, ...]]:
        first, copies = found.copies()
        yield _whole(found, copies)
        grams = found.columns[0][first]
        several = np.zeros(len(first), bool)
        several[1:] |= grams[1:] == grams[:-1]
        several[:-1] |= grams[1:] == grams[:-1]
        first = first[several]
        # one block of buckets at a time; a block holds whole buckets
        ends = np.cumsum(found.sizes[first])
        grams = found.columns[0][first]
        at = 0
        while at < len(first):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES // 4, "right"))
            stop = max(stop, at + 1)
            stop = at + int(np.searchsorted(grams[at:], grams[stop - 1], "right")) if stop < len(first) else len(first)
            block = found.take(first[at:stop])
            at = stop
            repeated = repeated_windows(block)
            counts = block.columns[4].astype(np.int64)
            owner = np.repeat(np.arange(len(block)), counts)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = np.flatnonzero(repeated)
            if len(hit):
                edge = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[hit][1:] != owner[hit][:-1])))
                head = hit[edge]
                last = hit[np.append(np.flatnonzero(edge)[1:], len(hit)) - 1]
                begin = block.columns[3][owner[head]]
                yield block.columns[1][owner[head]], block.columns[2][owner[head]], begin + step[head], begin + step[last] + SPAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list[Contexts]] = {}
        ranges: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for bucket, sure, *columns, data in zip(*batch.columns, strict=True):
                columns = [np.frombuffer(c.as_buffer(), k) for c, k in zip(columns, _KINDS, strict=True)]
                found = Contexts(columns, np.frombuffer(data.as_buffer(), np.uint8))
                if sure.as_py():
                    ranges.append(_whole(found, np.arange(len(found))))
                else:
                    lists.setdefault(bucket.as_py(), []).append(found)
        for bucket in list(lists):
            found = lists.pop(bucket)
            joined = Contexts([np.concatenate(c) for c in zip(*(f.columns for f in found), strict=True)], np.concatenate([f.data for f in found]))
            ranges.extend(compare(joined))
        if ranges:
            ids, versions, starts, ends = (np.concatenate(x) for x in zip(*ranges, strict=True))
            out = list(_by_document(ids, [versions, starts, ends], parts))
            if out:
                yield rows(_RUNS, [[k for k, _ in out], *(blobs([c[j] for _, c in out]) for j in range(4))])

    return run


def _whole(found: Contexts, at: np.ndarray) -> tuple[np.ndarray, ...]:
    _, ids, versions, windows, counts, _ = (c[at] for c in found.columns)
    return ids, versions, windows, windows + counts.astype(np.int64) + SPAN - 1


_SPANS = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of each document."""
    found = [[], [], [], []]
    for batch in batches:
        for _, *columns in zip(*batch.columns, strict=True):
            for all_, now in zip(found, columns, strict=True):
                all_.append(np.frombuffer(now.as_buffer(), np.int64))
    if not found[0]:
        return
    ids, versions, starts, ends = map(np.concatenate, found)
    order = np.lexsort((starts, versions, ids))
    ids, versions, starts, ends = (x[order] for x in (ids, versions, starts, ends))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])
    # places on one line, so that a running maximum never reaches from one document into the next
    document = np.cumsum(fresh) - 1
    width = int(ends.max()) + 2
    reach = np.maximum.accumulate(ends + document * width)
    head = np.ones(len(ids), bool)
    head[1:] = (starts + document * width)[1:] > reach[:-1]
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(ids)) - 1
    starts, ends, document = starts[at], reach[last] - document[at] * width, document[at]
    ids, versions = ids[at], versions[at]
    keys, bounds = cut(np.arange(len(at)), document)
    for i in range(0, len(keys), 10_000):
        low, high = bounds[:-1][i : i + 10_000], bounds[1:][i : i + 10_000]
        pairs = list(zip(low.tolist(), high.tolist(), strict=True))
        yield rows(_SPANS, [ids[low], versions[low], blobs([binary(starts[a:b]) for a, b in pairs]), blobs([binary(ends[a:b]) for a, b in pairs])])


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, offsets = byte_column(batch.column("text"))
        data = memoryview(np.ascontiguousarray(data))
        packed = [packer.compress(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        rest = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*rest, blobs(packed)], names=[*(c for c in batch.schema.names if c != "text"), "packed"])


def packed_texts(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(id, version, row, packed): compressed texts, for joins that have to shuffle them; row holds the columns to carry."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*[docs[c] for c in carry]).alias("row")] if carry else []
    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("version"), *row, text.alias("text"))
    schema = T.StructType([f for f in given.schema.fields if f.name != "text"]).add("packed", T.BinaryType())
    return given.mapInArrow(tidied(_pack_texts), schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Byte ranges of each text covered by a string of SPAN bytes that starts earlier too: (id, version, starts, ends).

    Earlier is a smaller doc_id, or an earlier place in the same document. starts and ends are packed 64-bit numbers of
    maximal runs. Rows without id take no part. Rows with the same id and text are one document.

    Shuffled are the grams (about 3 % of the places) once per task, compressed texts, and contexts of repeated grams once
    per task. A gram or context with any number of copies reaches its bucket at most once from each block of a task.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    known = docs.where("doc_id is not null")
    buckets = 16 * n
    grams = keyed_texts(known).select("id", "text").mapInArrow(tidied(_gram_lists(buckets)), _SEEN_DDL)
    hints = grams.repartition(n, "bucket").mapInArrow(tidied(_repeated_grams(4 * n)), "part int, ids binary, places binary")
    hints = stored(hints.repartition(n, "part").mapInArrow(tidied(_per_document), "id long, places binary"), "gram-places")
    texts = packed_texts(known).join(hints, "id").select("id", "version", "packed", "places")
    contexts = texts.mapInArrow(tidied(_context_lists(buckets)), _CONTEXTS_DDL)
    ranges = contexts.repartition(n, "bucket").mapInArrow(tidied(_sorted_buckets(4 * n)), "part int, ids binary, versions binary, starts binary, ends binary")
    return stored(ranges.repartition(n, "part").mapInArrow(tidied(_merged), "id long, version long, starts binary, ends binary"), "repeated-spans")


def _kept(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            left_, sizes, removed_, spans_, digests = [], [], [], [], []
            for packed, starts, ends in zip(batch.column("packed"), batch.column("starts"), batch.column("ends"), strict=True):
                text = opener.decompress(packed.as_buffer())
                removed = spans = 0
                kept = [text]
                if starts.is_valid:
                    low, high = (np.frombuffer(x.as_buffer(), np.int64) for x in (starts, ends))
                    spans, removed = len(low), int((high - low).sum())
                    kept = [text[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(text)], strict=True)]
                joined = b"".join(kept)
                left_.append("".join(k.decode("utf-8", "ignore") for k in kept) if as_text else joined)
                for column, value in zip((sizes, removed_, spans_, digests), (len(text), removed, spans, hashlib.sha256(joined).hexdigest()), strict=True):
                    column.append(value)
            counts = [pa.array(c, pa.int64()) for c in (sizes, removed_, spans_)]
            left = pa.array(left_, pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), left, *counts, pa.array(digests, pa.string())], names=["row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return run


def _without_spans(docs: DataFrame, carry: list[str], as_text: bool = False) -> DataFrame:
    spans = repeated_spans(docs)
    joined = packed_texts(docs, carry).join(spans, ["id", "version"], "left").select("row", "packed", "starts", "ends")
    schema = T.StructType([joined.schema["row"]]).add("kept", T.StringType() if as_text else T.BinaryType())
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, T.LongType())
    return joined.mapInArrow(tidied(_kept(as_text)), schema.add("kept_sha256", T.StringType()))


def dedup_spans(docs: DataFrame) -> DataFrame:
    """Remove repeated byte spans: (doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``.

    Texts are UTF-8 bytes, null is empty; every byte covered by a string of 100 bytes that starts earlier too goes,
    judged on the input. kept holds the remaining bytes, which may be no UTF-8 at a seam. Rows without id are kept whole.
    Rows with the same id and text are one document, so each has the same result; other columns don't matter.
    """
    return _without_spans(docs, ["doc_id"]).select(F.col("row.doc_id").cast("long").alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def clean_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns and the remaining text; n_chars follows it.

    Characters cut at a seam go as well, and so do documents that lost bytes and have no word left.
    """
    left = _without_spans(docs, [c for c in docs.columns if c != "text"], as_text=True).withColumnRenamed("kept", "text")
    return with_new_text(docs, left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))
