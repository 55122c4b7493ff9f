"""Exact Jaccard join of word shingle sets, with skipping of index blocks and of answers that related sets give.

Sets are compared by their shared shingles, in one global order, rarest first. A set is listed under its first shared
shingles only (prefix filter). A list is a run of blocks by set size and position: blocks whose bound on the overlap
can't reach the threshold are skipped. Links are only asked for as far as components need them: each set is compared
with one leader, the smallest set that some list pairs it with, and takes over the leader's component when they link;
what remains are pairs of a list in different components, of which those are skipped that the distances to a common
leader rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunlake.llm.common import binary, blobs, cut, rows, shuffle_partitions, slices, small_batches, stored, texts, tidied
from dunlake.llm.graph import components
from dunlake.llm.hashing import MULTIPLIERS, mix, shingles, word_hashes

SHINGLE_WORDS = 5
#: Threshold of the Jaccard similarity, in percent.
PERCENT = 75
#: Bytes of a shingle's number within its bucket. Buckets grow with the partitions, so numbers have 40 bits and more.
TOKEN_BYTES = 5
BLOCK_TOKENS = 1 << 21
#: Bytes of an Arrow batch. Rows of pairs hold the shingles of two sets, so a batch of Spark's 64 MB would be as much as a task needs.
BATCH_BYTES = 1 << 23
#: Open pairs are compared in turns by a hash of the pair: a share of 2^-8 first, then 2^-4, then all. In a large group of near
#: copies the first pairs join nearly all sets, so that few pairs are open in the later turns.
TURNS = (8, 4, 0)
#: Lists of at most so many sets give all their open pairs in the first turn, and so do longer lists with at most so many open
#: pairs for every two sets; later turns take the sets of all other lists only.
FEW = 32
#: Shingles of a bucket are sorted in so many shares, one after the other.
SHARES = 16


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest intersection of sets of these sizes that links them: 100 i >= PERCENT (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _short(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _long(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, TOKEN_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :TOKEN_BYTES] = raw
    return out.view("<u8").ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as a first one and steps of two bytes where they ascend in small steps, as they mostly do in a scan; else as they are."""
    steps = np.diff(ids)
    if len(ids) and len(steps) == np.count_nonzero((steps >= 0) & (steps < 65536)):
        return b"\1" + binary(ids[:1]) + binary(steps.astype(np.uint16))
    return b"\0" + binary(ids)


def _unpack_ids(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\0":
        return np.frombuffer(blob[1:], np.int64)
    first = np.frombuffer(blob[1:9], np.int64)
    return np.concatenate((first, first + np.cumsum(np.frombuffer(blob[9:], np.uint16).astype(np.int64))))


def _pack_counts(counts: np.ndarray) -> bytes:
    small = len(counts) == 0 or counts.max() < 65536
    return (b"\1" if small else b"\0") + binary(counts.astype(np.uint16 if small else np.uint32))


def _unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[1:], np.uint16 if blob[:1] == b"\1" else np.uint32)


def _pack_versions(versions: np.ndarray) -> bytes:
    return binary(versions.astype(np.uint32))


def _unpack_versions(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint32).astype(np.int64)


def distinct_sets(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text, the size of each set, and a hash of each set."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    sizes = np.bincount(owner, minlength=n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + MULTIPLIERS[5]))))
    ends = np.cumsum(sizes)
    return values, sizes, mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * MULTIPLIERS[6])


# ---- shared shingles of each set ----------------------------------------------------------------------------------

#: kind 0: sets (ids, versions, sizes, id and version of an equal set or the same); kind 1: shingles of one bucket by set.
_SETS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32())] + [(n, pa.binary()) for n in ("ids", "versions", "sizes", "other", "tokens")])
_SETS_DDL = "bucket int, kind int, ids binary, versions binary, sizes binary, other binary, tokens binary"


def _set_lists(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of: dict[int, int] = {}
        turn = 0
        for batch in batches:
            for part in slices(batch):
                words, first = word_hashes(part, lower=True)
                values, sizes, marks = distinct_sets(*shingles(words, first, SHINGLE_WORDS), len(part))
                # 32 bits tell sets of one id apart
                versions = (marks & np.uint64(0xFFFFFFFF)).astype(np.int64)
                # equal sets seen by this task go on as a link to the first one, which stands for them
                leaders = np.array([first_of.setdefault(m, i) for m, i in zip(marks.tolist(), part.ids.tolist(), strict=True)], np.int64)
                leaders = np.where(sizes > 0, leaders, part.ids)
                fresh = np.zeros(len(part), bool)
                fresh[np.unique(marks, return_index=True)[1]] = True
                fresh &= (leaders == part.ids) & (sizes > 0)
                turn += 1
                sent = [turn % buckets], [0], [_pack_ids(part.ids)], [_pack_versions(versions)], [binary(sizes.astype(np.int64))], [binary(leaders)], [b""]
                yield rows(_SETS, [pa.array(c, f.type) for c, f in zip(sent, _SETS, strict=True)])
                owner = np.repeat(np.arange(len(part)), sizes)
                chosen = fresh[owner]
                tokens, owner = values[chosen], owner[chosen]
                bucket = (tokens % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                keys, bounds = cut(order, bucket)
                short = tokens[order] // np.uint64(buckets)
                owner = owner[order]
                out = [], [], [], [], [], [], []
                for key, a, b in zip(keys.tolist(), bounds[:-1], bounds[1:], strict=True):
                    here = owner[a:b]
                    edge = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
                    sets = here[edge]
                    counts = np.diff(np.append(edge, len(here)))
                    values = (key, 1, _pack_ids(part.ids[sets]), _pack_versions(versions[sets]), _pack_counts(counts), b"", _short(short[a:b]))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                if keys.size:
                    yield rows(_SETS, [pa.array(c, f.type) for c, f in zip(out, _SETS, strict=True)])
            if len(first_of) > BLOCK_TOKENS:
                first_of = {}

    return run


#: kind 0 as before; kind 1: shared shingles of one bucket by set, with their numbers of sets.
_SHARED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32())] + [(n, pa.binary()) for n in ("ids", "versions", "sizes", "other", "tokens")])
_SHARED_DDL = "part int, kind int, bucket int, ids binary, versions binary, sizes binary, other binary, tokens binary"


def _parts(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _shared_tokens(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, kind, ids, versions, sizes, other, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, versions = _unpack_ids(ids), _unpack_versions(versions)
                if kind == 0:
                    yield from _meta_rows(ids, versions, np.frombuffer(sizes, np.int64), np.frombuffer(other, np.int64), parts)
                else:
                    lists.setdefault(bucket, []).append((ids, versions, _unpack_counts(sizes), tokens))
        for bucket in list(lists):
            found = lists.pop(bucket)
            ids, versions, counts = (np.concatenate([f[k] for f in found]) for k in range(3))
            tokens = _long(b"".join(f[3] for f in found))
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), counts)
            del found
            kept = [_several(tokens, owner, k) for k in range(SHARES)]
            tokens, owner, shared = (np.concatenate(c) for c in zip(*kept, strict=True))
            if not len(tokens):
                continue
            part = _parts(ids, parts)[owner]
            by = np.lexsort((owner, part))
            keys, bounds = cut(by, part)
            tokens, owner, shared = tokens[by], owner[by], shared[by]
            out = [], [], [], [], [], [], [], []
            for key, a, b in zip(keys.tolist(), bounds[:-1], bounds[1:], strict=True):
                here = owner[a:b]
                edge = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
                counts = np.diff(np.append(edge, len(here)))
                of = here[edge]
                values = (key, 1, bucket, _pack_ids(ids[of]), _pack_versions(versions[of]), _pack_counts(counts), binary(shared[a:b]), _short(tokens[a:b]))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield rows(_SHARED, [pa.array(c, f.type) for c, f in zip(out, _SHARED, strict=True)])

    return run


def _several(tokens: np.ndarray, owner: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one share of the shingle numbers: those of several sets, each with its set and the number of sets."""
    here = np.flatnonzero(tokens % np.uint64(SHARES) == share)
    here = here[np.argsort(tokens[here], kind="stable")]
    ordered = tokens[here]
    if not len(ordered):
        return ordered, owner[here], np.zeros(0, np.uint16)
    edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sets = np.diff(np.append(edge, len(ordered)))
    shared = np.repeat(sets, sets)
    chosen = np.flatnonzero(shared > 1)
    return ordered[chosen], owner[here[chosen]], np.minimum(shared[chosen], 65535).astype(np.uint16)


def _meta_rows(ids: np.ndarray, versions: np.ndarray, sizes: np.ndarray, other: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    part = _parts(ids, parts)
    by = np.argsort(part, kind="stable")
    keys, bounds = cut(by, part)
    spans = [by[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    packers = ((ids, _pack_ids), (versions, _pack_versions), (sizes, binary), (other, binary))
    columns = [[pack(c[s]) for s in spans] for c, pack in packers]
    yield rows(_SHARED, [keys, [0] * len(keys), [0] * len(keys), *map(blobs, columns), blobs([b""] * len(keys))])


_TABLE = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("same_as", pa.int64()), ("tokens", pa.binary())])
_TABLE_DDL = "id long, version long, n long, same_as long, tokens binary"
#: Bytes of a row of this table without its shingles.
ROW_BYTES = 40


def _assembled(buckets: int):
    """One row per set: its size, an equal set or itself, and its shared shingles in global order if they are enough for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta, found = [], []
        for batch in batches:
            for _, kind, bucket, ids, versions, sizes, other, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, versions = _unpack_ids(ids), _unpack_versions(versions)
                if kind == 0:
                    meta.append((ids, versions, np.frombuffer(sizes, np.int64), np.frombuffer(other, np.int64)))
                else:
                    counts = _unpack_counts(sizes)
                    full = _long(tokens) * np.uint64(buckets) + np.uint64(bucket)
                    found.append((np.repeat(ids, counts), np.repeat(versions, counts), np.frombuffer(other, np.uint16), full))
        if not meta:
            return
        ids, versions, sizes, same = (np.concatenate(c) for c in zip(*meta, strict=True))
        # of the rows of a set, one that stands for itself comes first and takes the shingles
        order = np.lexsort((same, same != ids, versions, ids))
        ids, versions, sizes, same = (c[order] for c in (ids, versions, sizes, same))
        packed: list[bytes | None] = [None] * len(ids)
        if found:
            t_ids, t_versions, shared, tokens = (np.concatenate(c) for c in zip(*found, strict=True))
            del found
            order = np.lexsort((tokens, shared, t_versions, t_ids))
            t_ids, t_versions, tokens = t_ids[order], t_versions[order], tokens[order]
            # a set that two tasks sent, for repeated rows, has every shingle twice
            fresh = np.ones(len(tokens), bool)
            fresh[1:] = (tokens[1:] != tokens[:-1]) | (t_ids[1:] != t_ids[:-1]) | (t_versions[1:] != t_versions[:-1])
            t_ids, t_versions, tokens = t_ids[fresh], t_versions[fresh], tokens[fresh]
            edge = np.flatnonzero(np.concatenate(([True], (t_ids[1:] != t_ids[:-1]) | (t_versions[1:] != t_versions[:-1]))))
            ends = np.append(edge[1:], len(t_ids))
            place = {key: i for i, key in reversed(list(enumerate(zip(ids.tolist(), versions.tolist(), strict=True))))}
            for a, b, i, v in zip(edge.tolist(), ends.tolist(), t_ids[edge].tolist(), t_versions[edge].tolist(), strict=True):
                at = place[i, v]
                if b - a >= -(-PERCENT * int(sizes[at]) // 100):
                    packed[at] = binary(tokens[a:b])
        total = np.cumsum([ROW_BYTES + len(p or b"") for p in packed])
        at = 0
        while at < len(ids):
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_BYTES, "right"))
            here = slice(at, max(end, at + 1))
            yield rows(_TABLE, [ids[here], versions[here], sizes[here], same[here], pa.array(packed[here], pa.binary())])
            at = here.stop

    return run


# ---- lists --------------------------------------------------------------------------------------------------------

_POSTINGS = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("tokens", "ids", "versions", "sizes", "rests", "labels", "leaders", "distances")])
_POSTINGS_DDL = "bucket int, tokens binary, ids binary, versions binary, sizes binary, rests binary, labels binary, leaders binary, distances binary"
_KINDS = (np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.int64, np.int64, np.float64)


def _postings(buckets: int):
    """Prefix shingles of each set by bucket, with the set's size and the shared shingles from there on."""

    def flush(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        bucket = (mix(columns[0]) % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        keys, bounds = cut(by, bucket)
        packed = [[binary(c[by[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for c in columns]
        yield rows(_POSTINGS, [keys, *map(blobs, packed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for id_, version, n, shared, tokens, label, leader, distance in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(tokens, np.uint64)
                k = shared + (-PERCENT * n // 100) + 1
                values = (tokens[:k], id_, version, n, shared - np.arange(k), label, leader, distance)
                found.append(tuple(np.broadcast_to(np.asarray(v), k).astype(t) for v, t in zip(values, _KINDS, strict=True)))
                size += k
                if size >= BLOCK_TOKENS // 4:
                    yield from flush(found)
                    found, size = [], 0
        if found:
            yield from flush(found)

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each bucket, sorted by shingle, then size, id and version."""
    lists: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for bucket, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lists.setdefault(bucket, []).append([np.frombuffer(c, k) for c, k in zip(columns, _KINDS, strict=True)])
    for bucket in list(lists):
        columns = [np.concatenate(c) for c in zip(*lists.pop(bucket), strict=True)]
        order = np.lexsort((columns[2], columns[1], columns[3], columns[0]))
        yield [c[order] for c in columns]


_PAIRS = pa.schema([(n, pa.int64()) for n in ("id", "version", "other_id", "other_version")])
_PAIRS_DDL = "id long, version long, other_id long, other_version long"


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set the smallest leader of its lists that the bounds don't rule out. A list's leader is its smallest set."""
    best: list[tuple[np.ndarray, ...]] = []
    for tokens, ids, versions, sizes, rests, *_ in _lists(batches):
        order = np.lexsort((versions, ids, tokens))
        head = np.concatenate(([True], tokens[order][1:] != tokens[order][:-1]))
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        need = least_overlap(sizes[order].astype(np.int64), sizes[lead].astype(np.int64))
        hit = ~head & (np.minimum(rests[order], rests[lead]) >= need)
        hit &= np.minimum(sizes[order], sizes[lead]) >= need
        a, b = order[hit], lead[hit]
        best.append(_least_other(ids[a], versions[a], ids[b], versions[b]))
    if best:
        a, av, b, bv = _least_other(*(np.concatenate(c) for c in zip(*best, strict=True)))
        yield rows(_PAIRS, [a, av, b, bv])


def _least_other(a: np.ndarray, av: np.ndarray, b: np.ndarray, bv: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((bv, b, av, a))
    a, av, b, bv = a[order], av[order], b[order], bv[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (av[1:] != av[:-1])
    return a[head], av[head], b[head], bv[head]


def _marks(ids: np.ndarray, versions: np.ndarray) -> np.ndarray:
    """Hash of each set's id and version; leaders are told apart by it, as an id may have several sets."""
    return mix(ids.astype(np.uint64) * MULTIPLIERS[7] + versions.astype(np.uint64))


def _open_pairs(low: int, high: int, few: int):
    """Pairs of a list that are in different components and that no bound rules out.

    A list of at most ``few`` sets gives all of them in the first turn, and none later. A longer list gives all that earlier
    turns left, if they are at most ``few`` for every two of its sets; else those with a hash from ``low`` up to ``high``,
    and before the last turn also its sets, without another one, for the next turn.
    """
    return lambda batches: _open_batches(batches, low, high, few)


def _open_batches(batches: Iterator[pa.RecordBatch], low: int, high: int, few: int) -> Iterator[pa.RecordBatch]:
    limit = 1 - PERCENT / 100 + 1e-9
    first, last = low == 0, high == (1 << 64) - 1
    low, high, top = np.uint64(low), np.uint64(high), np.uint64((1 << 64) - 1)
    for tokens, ids, versions, sizes, rests, labels, leaders, distances in _lists(batches):
        edge = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        ends = np.append(edge[1:], len(tokens))
        mixed = np.minimum.reduceat(labels, edge) != np.maximum.reduceat(labels, edge) if len(edge) else np.zeros(0, bool)
        taken = mixed if first else mixed & (ends - edge > few)
        marks = _marks(ids, versions)
        own = marks.view(np.int64)
        waits = np.zeros(len(tokens), bool)
        found, size = [], 0
        for start, end in zip(edge[taken].tolist(), ends[taken].tolist(), strict=True):
            n = sizes[start:end].astype(np.int64)
            # sizes ascend: the block of sets small enough to link with each one is a range
            stop = np.searchsorted(n, n * 100 // PERCENT, "right") + start
            # pairs of a long list are held until it ends, or has too many to give them all
            room = 0 if last or end - start <= few else min((end - start) * few // 2, BLOCK_TOKENS // 4)
            held, count, part = [], 0, last
            for i in range(start, end - 1):
                j = np.arange(i + 1, stop[i - start])
                j = j[labels[j] != labels[i]]
                if part and end - start > few:
                    j = j[_in_turn(marks, i, j, low, high)]
                need = least_overlap(n[j - start], n[i - start])
                j = j[np.minimum(rests[j], rests[i]) >= need]
                apart = (leaders[j] == leaders[i]) & (np.abs(distances[j] - distances[i]) > limit)
                j = j[~apart & ~((leaders[j] == own[i]) | (leaders[i] == own[j]))]
                if not part and not first:
                    j = j[_in_turn(marks, i, j, low, top)]
                if not len(j):
                    continue
                held.append((i, j))
                count += len(j)
                if not part and room and count > room:
                    part, waits[start:end] = True, True
                    held = [(a, b[_in_turn(marks, a, b, low, high)]) for a, b in held]
                if part or not room:
                    found += held
                    size += sum(len(b) for _, b in held)
                    held = []
                if size >= BLOCK_TOKENS // 4:
                    yield _distinct_pairs(_named(found, ids, versions))
                    found, size = [], 0
            found += held
            size += sum(len(b) for _, b in held)
        if size:
            yield _distinct_pairs(_named(found, ids, versions))
        if waits.any():
            yield _waiting(ids[waits], versions[waits])


def _in_turn(marks: np.ndarray, i: int, j: np.ndarray, low: np.uint64, high: np.uint64) -> np.ndarray:
    """Whether the pairs of i and each of j have a hash from ``low`` up to ``high``."""
    turn = mix(marks[j] + marks[i])
    return (turn >= low) & (turn <= high)


def _named(found: list[tuple[int, np.ndarray]], ids: np.ndarray, versions: np.ndarray) -> list[tuple]:
    return [(np.full(len(j), ids[i]), np.full(len(j), versions[i]), ids[j], versions[j]) for i, j in found]


def _waiting(ids: np.ndarray, versions: np.ndarray) -> pa.RecordBatch:
    """Different sets as rows without another one."""
    order = np.lexsort((versions, ids))
    ids, versions = ids[order], versions[order]
    head = np.ones(len(ids), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])
    none = pa.nulls(int(head.sum()), pa.int64())
    return rows(_PAIRS, [ids[head], versions[head], none, none])


def _distinct_pairs(found: list[tuple]) -> pa.RecordBatch:
    a, av, b, bv = (np.concatenate(c) for c in zip(*found, strict=True))
    swap = (a > b) | (a == b) & (av > bv)
    a, b, av, bv = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, bv, av), np.where(swap, av, bv)
    order = np.lexsort((bv, b, av, a))
    a, av, b, bv = a[order], av[order], b[order], bv[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (av[1:] != av[:-1]) | (b[1:] != b[:-1]) | (bv[1:] != bv[:-1])
    return rows(_PAIRS, [a[head], av[head], b[head], bv[head]])


_CHECKED = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("other_id", pa.int64()), ("other_mark", pa.int64()), ("distance", pa.float64()), ("linked", pa.bool_())])
_CHECKED_DDL = "id long, version long, other_id long, other_mark long, distance double, linked boolean"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = np.zeros(batch.num_rows, np.int64)
        for i, (a, b) in enumerate(zip(batch.column("tokens"), batch.column("other_tokens"), strict=True)):
            x = np.sort(np.concatenate((np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))))
            both[i] = np.count_nonzero(x[1:] == x[:-1])
        total = batch.column("n").to_numpy() + batch.column("other_n").to_numpy() - both
        linked = 100 * both >= PERCENT * total
        mark = _marks(batch.column("other_id").to_numpy(), batch.column("other_version").to_numpy()).view(np.int64)
        yield rows(_CHECKED, [batch.column("id"), batch.column("version"), batch.column("other_id"), mark, 1 - both / total, linked])


def _check(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlap of each pair of sets."""
    other = sets.select(F.col("id").alias("other_id"), F.col("version").alias("other_version"), F.col("n").alias("other_n"), F.col("tokens").alias("other_tokens"))
    sided = pairs.join(sets.select("id", "version", "n", "tokens"), ["id", "version"]).join(other, ["other_id", "other_version"])
    return sided.select("id", "version", "other_id", "other_version", "n", "other_n", "tokens", "other_tokens").mapInArrow(tidied(_compared), _CHECKED_DDL)


def _ends(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of any of these pairs, stored. Where pairs are few, their shingles are all that the comparison moves."""
    ends = pairs.select("id", "version").unionByName(pairs.select(F.col("other_id").alias("id"), F.col("other_version").alias("version")))
    return stored(sets.select("id", "version", "n", "tokens").join(ends.distinct(), ["id", "version"], "left_semi"), "open-sets")


def _gathered(links: DataFrame, key: str) -> DataFrame:
    """Rows of few bytes from tasks that read many, dealt anew by size, so that they are stored in few files.

    Every file costs work beyond its bytes; a local folder has its rights set by processes that the executor starts.
    """
    return links.hint("rebalance", key)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Group documents by similar shingle sets: (doc_id, n_shingles, component_id), one row per row of ``docs``.

    Words are lower-cased in A-Z; a set holds the hashes of all runs of five words, a shorter text its whole sequence,
    an empty or null one nothing. Sets link at 100 * intersection >= 75 * union. component_id is the smallest doc_id
    reachable by links, the own one without links. Rows with equal ids are one document with the links of each text;
    rows without id link with nothing and have a null component. Other columns don't matter.

    No group is brought together: equal sets reach a bucket once per task, a shingle's list gives one pair per set, and
    pairs inside a component are never formed. Open pairs are those between components that share a listed shingle; they
    are compared in turns, and links of one turn close pairs of the next; only sets of long lists with many open pairs
    take a second turn. Stored are the sets that may link, with their shared shingles.
    """
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return _components(docs)


def _components(docs: DataFrame) -> DataFrame:
    n = shuffle_partitions(docs.sparkSession)
    # Few buckets, so that a set has several shingles in each and its id is sent with all of them.
    buckets = n
    given = texts(docs)
    dealt = given.where("id is not null").mapInArrow(tidied(_set_lists(buckets)), _SETS_DDL).repartition(n, "bucket")
    common = dealt.mapInArrow(tidied(_shared_tokens(4 * n)), _SHARED_DDL).repartition(n, "part")
    table = stored(common.mapInArrow(tidied(_assembled(buckets)), _TABLE_DDL), "shingle-sets")
    # rows with the same id and set stand for one set
    sets = table.where("tokens is not null and same_as = id").select("id", "version", "n", "tokens")
    copies = table.where("same_as != id").select(F.col("id").alias("a"), F.col("same_as").alias("b"))

    shared = F.expr("length(tokens) div 8").alias("shared")
    plain = sets.select("id", "version", "n", shared, "tokens", F.lit(0).cast("long").alias("label"), F.lit(0).cast("long").alias("leader"), F.lit(0.0).alias("distance"))
    lists = plain.mapInArrow(tidied(_postings(buckets)), _POSTINGS_DDL).repartition(n, "bucket")
    nearest = lists.mapInArrow(tidied(_leaders), _PAIRS_DDL).groupBy("id", "version").agg(F.min(F.struct("other_id", "other_version")).alias("o"))
    nearest = nearest.select("id", "version", "o.other_id", "o.other_version")
    checked = stored(_gathered(_check(nearest, sets), "id"), "leader-links")
    edges = checked.where("linked").select(F.col("id").alias("a"), F.col("other_id").alias("b")).unionByName(copies)
    found = components(_gathered(edges, "a"))

    label = F.coalesce("component_id", "id").alias("label")
    prefix = F.expr(f"substring(tokens, 1, 8 * (length(tokens) div 8 - (n * {PERCENT} + 99) div 100 + 1))")
    listed = waiting = sets.select("id", "version", "n", shared, prefix.alias("tokens"))
    near = checked.select("id", "version", F.col("other_mark").alias("leader"), "distance")
    low = 0
    for bits in TURNS:
        high = (1 << 64 - bits) - 1
        # what is known of a set is brought together first, so that its shingles move once
        known = sets.select("id", "version").join(found, "id", "left").join(near, ["id", "version"], "left")
        known = known.select("id", "version", label, F.coalesce("leader", F.lit(-1 << 62)).alias("leader"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
        told = waiting.join(known, ["id", "version"]).select("id", "version", "n", "shared", "tokens", "label", "leader", "distance")
        lists = told.mapInArrow(tidied(_postings(buckets)), _POSTINGS_DDL).repartition(n, "bucket")
        open_ = stored(lists.mapInArrow(tidied(_open_pairs(low, high, FEW)), _PAIRS_DDL).distinct(), "open-pairs")
        pairs = open_.where("other_id is not null")
        links = _check(pairs, _ends(pairs, sets)).where("linked").select(F.col("id").alias("a"), F.col("other_id").alias("b"))
        more = stored(_gathered(links, "a"), "open-links")
        if more.head(1):
            # stars of the components so far and the links between them
            stars = found.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
            found = components(more.unionByName(stars))
        left = open_.where("other_id is null")
        if not left.head(1):
            break
        waiting = listed.join(left, ["id", "version"], "left_semi")
        low = high + 1

    sized = table.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"))
    labelled = sized.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    labelled = labelled.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = given.where("id is null").mapInArrow(tidied(_sizes), "n_shingles long")
    return labelled.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def one_per_group(docs: DataFrame, every_text: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its component, with all columns, and all rows without id.

    One row an id, or with ``every_text`` one row for each different text of an id. An id is one document, as in
    ``jaccard_components``: it stays or goes with all its texts. Null and empty texts are linked with nothing and stay;
    an empty table gives no rows; other columns are kept, whatever their names.
    """
    others = jaccard_components(docs.select("doc_id", "text")).where("doc_id != component_id").select(F.col("doc_id").alias("dropped")).distinct()
    # the row is one column from here on, so that no column of it clashes with those of the work
    whole = docs.where("doc_id is not null").select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    stays = whole.join(others, F.col("row.doc_id").cast("long") == F.col("dropped"), "left_anti")
    keys = ["row.doc_id", F.xxhash64("row.text")] if every_text else ["row.doc_id"]
    version = Window.partitionBy(*keys).orderBy(F.xxhash64("row.text"))
    stays = stays.select("row", F.row_number().over(version).alias("place")).where("place = 1")
    return stays.select("row.*").unionByName(docs.where("doc_id is null"))


_SIZE = pa.schema([("n_shingles", pa.int64())])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words, first = word_hashes(part, lower=True)
            yield rows(_SIZE, [distinct_sets(*shingles(words, first, SHINGLE_WORDS), len(part))[1]])
