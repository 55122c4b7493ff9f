"""Periodic runs of words by longest common extensions in suffix trees.

A run is a maximal stretch of words with smallest period q and at least two periods. Each run has a Lyndon root that is
the longest Lyndon word at its first word, for the order of words or for the opposite one; so two candidates a word are
enough, and each is extended both ways by a longest common extension: to the right in the tree of the words, to the left
in the tree of the reversed words. The trees are built by Ukkonen's algorithm; a common extension is the word depth of
the lowest common ancestor of two leaves, a range minimum over the Euler tour.

A run of ``SHORTEST`` words or more is covered by grams of ``GRAM`` words that occur twice in the text, so texts are first
cut to such stretches, again and again until nothing changes; trees are built of what is left.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlake.llm.common import Slice, rows, slices, texts
from dunlake.llm.hashing import gram_hashes, mix, word_bounds

#: A run has at least so many words, and at least two periods.
SHORTEST = 12
#: A run of n words with period q repeats n - q words at distance q, which is SHORTEST / 2 or more.
GRAM = SHORTEST // 2


class SuffixTree:
    """Ukkonen's suffix tree of numbered words; the last one must occur nowhere else, so each suffix ends at a leaf."""

    def __init__(self, words: list[int]):
        n = self.n = len(words)
        size = max(words) + 1
        start, end, link = array("i", [0]), array("i", [0]), array("i", [0])
        suffix = array("i", [-1])
        children: dict[int, int] = {}
        node = edge = length = pending = leaves = 0
        for i, word in enumerate(words):
            pending += 1
            unlinked = 0
            while pending:
                if not length:
                    edge = i
                key = node * size + words[edge]
                child = children.get(key)
                if child is None:
                    children[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(leaves)
                    leaves += 1
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    low = start[child]
                    span = end[child] - low
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if words[low + length] == word:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(start)
                    start.append(low)
                    end.append(low + length)
                    link.append(0)
                    suffix.append(-1)
                    children[key] = inner
                    start[child] = low + length
                    children[inner * size + words[low + length]] = child
                    children[inner * size + word] = inner + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(leaves)
                    leaves += 1
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.start, self.end, self.suffix = (np.frombuffer(a, np.int32) for a in (start, end, suffix))
        keys = np.fromiter(children.keys(), np.int64, len(children))
        ends = np.fromiter(children.values(), np.int64, len(children))
        order = np.argsort(keys)
        self.child = ends[order]
        self.first = np.searchsorted(keys[order] // size, np.arange(len(start) + 1))

    def tour(self, last_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their leaves, and the word depth of the lowest ancestor that each shares with the one before.

        ``last_first`` is the order by the opposite order of words. A suffix that begins another one comes first in both
        orders, so the closing word is the smallest in both; it is the word with number 0.
        """
        span = (self.end - self.start).tolist()
        first, child, suffix = self.first.tolist(), self.child.tolist(), self.suffix.tolist()
        words_first = self.start.tolist()
        leaves, shared = array("i"), array("i")
        stack, depths, low = [0], [0], 0
        closing = self.n - 1
        while stack:
            node, depth = stack.pop(), depths.pop()
            if node < 0:  # back in an inner node
                if depth < low:
                    low = depth
                continue
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                shared.append(low)
                low = self.n
                continue
            depth += span[node] if node else 0
            below = child[first[node] : first[node + 1]]
            if last_first:
                below = below[::-1] if words_first[below[0]] != closing else [below[0], *below[:0:-1]]
            for k in range(len(below) - 1, -1, -1):
                if k < len(below) - 1:
                    stack.append(-1)
                    depths.append(depth)
                stack.append(below[k])
                depths.append(depth)
        return np.frombuffer(leaves, np.int32), np.frombuffer(shared, np.int32)


class Extensions:
    """Longest common prefixes of suffixes in constant time: range minima over the tour by a sparse table."""

    def __init__(self, leaves: np.ndarray, shared: np.ndarray):
        self.place = np.empty(len(leaves), np.int64)
        self.place[leaves] = np.arange(len(leaves))
        self.levels = [shared]
        width = 1
        while 2 * width <= len(shared):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different suffixes the number of words that both begin with."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def _next_smaller(place: np.ndarray, n: int) -> np.ndarray:
    """For each suffix the next one that is smaller; n where there is none."""
    after, ranks = [n] * n, place.tolist()
    stack: list[int] = []
    for i in range(n):
        rank = ranks[i]
        while stack and ranks[stack[-1]] > rank:
            after[stack.pop()] = i
        stack.append(i)
    return np.array(after, np.int64)


def runs_of(words: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """All runs of a sequence of numbers below its length: rows (start, length, period) by start, then period.

    ``shortest`` is the least length; runs have two periods or more.
    """
    n = len(words)
    if n < max(shortest, 2):
        return np.zeros((0, 3), np.int64)
    forward = SuffixTree([*(words + 1).tolist(), 0])
    leaves, shared = forward.tour()
    right = Extensions(leaves, shared)
    opposite, _ = forward.tour(last_first=True)
    other_place = np.empty(n + 1, np.int64)
    other_place[opposite] = np.arange(n + 1)
    del forward
    left = Extensions(*SuffixTree([*(words[::-1] + 1).tolist(), 0]).tour())
    starts = np.tile(np.arange(n), 2)
    periods = np.concatenate([_next_smaller(p, n) for p in (right.place[:n], other_place[:n])]) - starts
    # a root that ends with the text has no copy to its right; suffix n is the closing word
    to_right = right.common(starts, starts + periods)
    to_left = np.zeros(2 * n, np.int64)
    inner = np.flatnonzero(starts > 0)
    i, j = starts[inner] - 1, starts[inner] + periods[inner] - 1
    to_left[inner] = left.common(n - 1 - i, n - 1 - j)
    length = to_left + periods + to_right
    kept = length >= np.maximum(shortest, 2 * periods)
    found = np.stack((starts - to_left, length, periods), axis=1)[kept]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _stretches(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that grams found twice in the same stretch cover; no run is outside them.

    Grams are told apart by hashes; two that are taken for one only make a stretch longer.
    """
    starts, ends = np.zeros(1, np.int64), np.full(1, len(ids))
    values = mix(ids.astype(np.uint64) + np.uint64(1))
    group = owner
    while True:
        grams = gram_hashes(values, GRAM)
        if not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = np.flatnonzero((group[: len(grams)] == group[GRAM - 1 :]) & (group[: len(grams)] >= 0))
        keys = mix(grams[whole] + group[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[order][1:] == keys[order][:-1]
        hit = whole[order[same[:-1] | same[1:]]]
        change = np.zeros(len(ids) + 1, np.int32)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + GRAM, -1)
        covered = np.cumsum(change[:-1]) > 0
        edge = np.ones(len(ids), bool)
        edge[1:] = (covered[1:] != covered[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(ids))
        kept = covered[first] & (last - first >= SHORTEST)
        first, last = first[kept], last[kept]
        if len(first) == len(starts) and (first == starts).all() and (last == ends).all():
            return starts, ends
        starts, ends = first, last
        if not len(starts):
            return starts, ends
        group = np.full(len(ids), -1, np.int64)
        size = ends - starts
        group[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(np.arange(len(starts)), size)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _words(part: Slice) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each word of a slice, equal for equal words; words before each text; and the words."""
    starts, ends, first = word_bounds(part)
    sizes = ends - starts
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    inner = np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])
    data = part.data[inner]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), first, words


def _slice_runs(part: Slice) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Runs of all texts of a slice with the number of their text, each text's collapsed words, and each one's number of words."""
    ids, first, words = _words(part)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(part)), counts)
    found, of = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    dropped = np.zeros(len(ids) + 1, np.int64)
    if len(ids):
        starts, ends = _stretches(ids, owner)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            _, numbers = np.unique(ids[a:b], return_inverse=True)
            runs = runs_of(numbers)
            np.add.at(dropped, a + runs[:, 0] + runs[:, 2], 1)
            np.add.at(dropped, a + runs[:, 0] + runs[:, 1], -1)
            text = owner[a]
            found.append(runs + np.array([a - first[text], 0, 0]))
            of.append(np.full(len(runs), text))
    kept = np.cumsum(dropped[:-1]) == 0
    before = np.concatenate(([0], np.cumsum(kept)))[first]
    left = words.filter(pa.array(kept)) if not kept.all() else words
    lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), left)
    return np.concatenate(found), np.concatenate(of), pc.binary_join(lists, pa.scalar(" ", left.type)).cast(pa.string()), counts


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of words of every whole text: (doc_id, n_words, runs, collapsed), one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds (start, length, period) of each run of at least
    SHORTEST words and two periods, by start, then period. ``collapsed`` are the words joined by blanks, without those
    that a run contains after its first period. Null, empty and blank texts have no words, no runs and an empty collapsed
    text. Null ids, repeated rows and other columns are taken as they are; an empty table gives no rows. No row depends on
    others. A task holds a slice of texts, or one longer text as a whole with the trees of its longest repetitive stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch):
                found, of, collapsed, counts = _slice_runs(part)
                bounds = np.searchsorted(of, np.arange(len(part) + 1))
                columns = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), columns)
                doc_ids = batch.column("id").slice(done, len(part))
                done += len(part)
                yield rows(_FOUND, [doc_ids, counts, lists, collapsed])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns, with texts of a tenth of the ids made periodic from some word on, for tests of the runs.

    With h the CRC-32 of the decimal id and g = h // 10, texts of ids with h % 10 = 0 repeat from word a = g % n on their
    next p = 1 + (n - a) // (3 + g % 8) words. Texts of null ids, and texts without words, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    chosen = chosen.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))
