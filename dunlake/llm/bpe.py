"""Byte-level BPE by speculation: greedy longest matches, vectorised pair checks, exact merging of what fails.

Greedy tokens of a word are its encoding exactly if every token is what the merges make of its own bytes and no merge
reaches across two neighbouring tokens while they are built. Merges apply by rank, the leftmost first. In the tree of
a token, a part exists from its own rank until its parent's. So across tokens a and b only parts that end a (its right
edge) and begin b (its left edge) can meet, and the merge (x, y) takes place if its rank comes before the parent of x
in a, and not after the parent of y in b, where at the same rank the left merge (x, y) goes first.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

from dunlake.llm.common import Slice
from dunlake.llm.hashing import MULTIPLIERS, mix

NEVER = np.int64(1) << np.int64(40)
#: Longer words are merged one by one.
SIDE_BY_SIDE_BYTES = 32
#: Words merged side by side go by size, so that few cells of their arrays are empty.
SIZE_STEPS = np.array([5, 7, 9, 12, 16, 22])
#: Words kept by a worker; the cache starts anew beyond it.
CACHE_WORDS = 400_000
_LETTER, _NUMBER, _SPACE, _OTHER, _EDGE = 0, 1, 2, 3, 4
EDGE_POINT = 0x110000


def _byte_letters() -> dict[str, int]:
    """The vocabulary writes bytes as letters: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


def _point_classes() -> np.ndarray:
    """Class of each code point for the pre-tokenizer's pattern, and of the edge between texts."""
    import regex

    everything = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    classes = np.full(EDGE_POINT + 1, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for found in regex.finditer(pattern, everything):
            classes[found.start() : found.end()] = kind
    classes[EDGE_POINT] = _EDGE
    return classes


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of runs of these starts and lengths, one run after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class IntMap:
    """Map of non-negative integers by open addressing in arrays; the longest chain of probes bounds every look-up."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: np.int64):
        bits = int(np.ceil(np.log2(4 * len(keys) + 1)))
        self.missing, self.shift, self.cells = missing, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing)
        self.probes, waiting, at = 0, np.arange(len(keys)), self._cell(keys)
        while len(waiting):
            cell = at[waiting] + self.probes & self.cells
            free = self.keys[cell] < 0
            chosen, first = np.unique(cell[free], return_index=True)
            placed = waiting[free][first]
            self.keys[chosen], self.values[chosen] = keys[placed], values[placed]
            waiting = np.setdiff1d(waiting, placed)
            self.probes += 1

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * MULTIPLIERS[4] >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._cell(keys)
        here = self.keys[at]
        found = np.where(here == keys, self.values[at], self.missing)
        open_ = np.flatnonzero((here != keys) & (here >= 0))  # places in the flattened array
        for k in range(1, self.probes):
            if not len(open_):
                break
            cell = at.flat[open_] + k & self.cells
            here, wanted = self.keys[cell], keys.flat[open_]
            hit = here == wanted
            found.flat[open_[hit]] = self.values[cell[hit]]
            open_ = open_[~hit & (here >= 0)]
        return found


class WordTable:
    """Slots of word hashes, none of which is 0, by open addressing in arrays with at most two cells in five in use."""

    def __init__(self, words: int):
        bits = int(np.ceil(np.log2(2.5 * words + 1)))
        self.mask = np.uint64((1 << bits) - 1)
        self.hashes, self.slots = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.count = 0

    def _cells(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return (hashes + np.uint64(k) & self.mask).astype(np.int64)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not known."""
        cells = self._cells(hashes, 0)
        here = self.hashes[cells]
        found = np.where(here == hashes, self.slots[cells], -1).astype(np.int64)
        open_ = np.flatnonzero((here != hashes) & (here != 0))
        k = 1
        while len(open_):
            wanted = hashes[open_]
            cells = self._cells(wanted, k)
            here = self.hashes[cells]
            hit = here == wanted
            found[open_[hit]] = self.slots[cells[hit]]
            open_ = open_[~hit & (here != 0)]
            k += 1
        return found

    def put(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """Add different hashes that are not known yet."""
        self.count += len(hashes)
        k = 0
        while len(hashes):
            cells = self._cells(hashes, k)
            free = self.hashes[cells] == 0
            self.hashes[cells[free]] = hashes[free]  # of two hashes with one cell one stays, the other goes on
            won = self.hashes[cells] == hashes
            self.slots[cells[won]] = slots[won]
            hashes, slots = hashes[~won], slots[~won]
            k += 1


class Tokenizer:
    """Encoder and decoder made from a tokenizer file; one is kept by each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in text): i for text, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes_of[i] = text
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = vocab[bytes([b])]
        # rank[(left, right)] and what it makes
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        coded = [tuple(vocab[bytes(letters[c] for c in half)] for half in pair) for pair in pairs]
        self.merges = {pair: (rank, vocab[self.bytes_of[pair[0]] + self.bytes_of[pair[1]]]) for rank, pair in reversed(list(enumerate(coded)))}
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        self.pairs = IntMap(keys, ranks, NEVER)
        self.made_by = np.array([self.merges[p][1] for p in coded], np.int64)
        left, right, made = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for (a, b), (rank, token) in self.merges.items():
            if made[token] < 0 or rank < made[token]:
                left[token], right[token], made[token] = a, b, rank
        self.right_edge = self._edges(right, made)
        self.left_edge = self._edges(left, made)
        self.proposals = self._own(left, right, made)
        self.longest = max(map(len, self.proposals))
        self._plant()
        self.classes = _point_classes()
        self.point_values = mix(np.arange(EDGE_POINT + 1, dtype=np.uint64) + MULTIPLIERS[2])
        self.reset()

    def reset(self, words: int = 0) -> None:
        """Forget all words, and make room for the cache's, or for so many if one slice has more."""
        self.pair_fits: dict[int, bool] = {}
        self.known = WordTable(max(CACHE_WORDS, words))
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.flat = np.zeros(8192, np.uint32)
        self.used = 0

    @staticmethod
    def _edges(child: np.ndarray, made: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth: the part at the edge and its parent's rank; -1 where a tree is less deep."""
        part, parent = np.arange(len(child)), np.full(len(child), NEVER)
        levels = []
        while (part >= 0).any():
            levels.append((part, parent))
            inner = (part >= 0) & (child[part] >= 0)
            parent = np.where(inner, made[part], NEVER)
            part = np.where(inner, child[part], -1)
        return levels

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER where the two don't merge or one is missing."""
        return self.pairs.get(np.where((left >= 0) & (right >= 0), left << 32 | right, -2))

    def _first_crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the first merge across each pair of neighbours, NEVER if none takes place."""
        first = np.full(len(a), NEVER)
        for x_part, x_parent in self.right_edge:
            x, x_until = x_part[a], x_parent[a]
            if not (x >= 0).any():
                break
            for y_part, y_parent in self.left_edge:
                y, y_until = y_part[b], y_parent[b]
                if not (y >= 0).any():
                    break
                rank = self._rank(x, y)
                first = np.minimum(first, np.where((rank < x_until) & (rank <= y_until), rank, NEVER))
        return first

    def _own(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> dict[bytes, int]:
        """Tokens that the merges really make of their bytes; only these are proposed."""
        merged = np.flatnonzero(made >= 0)
        clean = np.zeros(len(made), bool)
        clean[self.single] = True
        crossing = np.full(len(made), NEVER)
        crossing[merged] = self._first_crossing(left[merged], right[merged])
        for token in merged[np.argsort(made[merged], kind="stable")]:
            clean[token] = clean[left[token]] and clean[right[token]] and crossing[token] == made[token]
        return {self.bytes_of[t]: int(t) for t in np.flatnonzero(clean)}

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding of a word: the lowest rank first, of equal ranks the leftmost."""
        ids = [int(self.single[b]) for b in word]
        n, merges = len(ids), self.merges
        following, previous = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(merges[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            following[i] = k = following[j]
            if k >= 0:
                previous[k] = i
                if (p := (ids[i], ids[k])) in merges:
                    heapq.heappush(heap, (merges[p][0], i, *p))
            if (h := previous[i]) >= 0 and (p := (ids[h], ids[i])) in merges:
                heapq.heappush(heap, (merges[p][0], h, *p))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact encodings of short words side by side, as ids one word after the other and the number of each word's ids."""
        step = np.searchsorted(SIZE_STEPS, np.fromiter(map(len, words), np.int64, len(words)))
        counts, blocks = np.zeros(len(words), np.int64), []
        for k in np.unique(step).tolist():
            here = np.flatnonzero(step == k)
            ids, counts[here] = self._merge_block([words[i] for i in here.tolist()])
            blocks.append((here, ids))
        flat, starts = np.zeros(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        for here, ids in blocks:
            flat[_spread(starts[here], counts[here])] = ids
        return flat, counts

    def _merge_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge_many`` of words of about one size: every step merges the best pair of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        ids = np.full((len(words), width + 2), -1, np.int64)
        filled = np.arange(width + 2) < sizes[:, None]
        ids[filled] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        done, rows, columns = np.full((len(words), width + 2), -1, np.int64), np.arange(len(words)), np.arange(width + 2)
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            over = best == NEVER
            if over.any():
                done[rows[over]] = ids[over]
                going = ~over
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            move = np.minimum(columns + (columns > at[:, None]), width + 1)
            ids = np.take_along_axis(ids, move, 1)
            ids[:, -1] = -1
            ids[every, at] = self.made_by[best]
            ranks = np.take_along_axis(ranks, np.minimum(move[:, :-1], width), 1)
            ranks[every, at] = self._rank(ids[every, at], ids[every, at + 1])
            inner = at > 0
            ranks[every[inner], at[inner] - 1] = self._rank(ids[every[inner], at[inner] - 1], ids[every[inner], at[inner]])
        filled = done >= 0
        return done[filled], filled.sum(axis=1)

    def _plant(self) -> None:
        """Prefix tree of the proposals: the child of (node, byte), and the token that ends at a node."""
        nodes: dict[bytes, int] = {b"": 0}
        for text in self.proposals:
            for end in range(1, len(text) + 1):
                nodes.setdefault(text[:end], len(nodes))
        steps = [(nodes[text[:-1]] << 8 | text[-1], node) for text, node in nodes.items() if node]
        self.children = IntMap(np.array([k for k, _ in steps], np.int64), np.array([v for _, v in steps], np.int64), np.int64(-1))
        self.token_at = np.full(len(nodes), -1, np.int64)
        for text, token in self.proposals.items():
            self.token_at[nodes[text]] = token

    def greedy_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches of short words, walking the prefix tree with all words at once, in the form of ``merge_many``."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max(initial=0))
        text = np.full((len(words), width + 1), -1, np.int64)
        text[np.arange(width + 1) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        out = np.full((len(words), width + 1), -1, np.int64)
        rows = np.flatnonzero(sizes)
        at, node, count = (np.zeros(len(rows), np.int64) for _ in range(3))
        best, best_end = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
        while len(rows):
            byte = text[rows, at]
            child = np.where(byte >= 0, self.children.get(node << 8 | np.maximum(byte, 0)), -1)
            on = child >= 0
            at += on
            node = np.where(on, child, 0)
            token = np.where(on, self.token_at[node], -1)
            ends = token >= 0
            best, best_end = np.where(ends, token, best), np.where(ends, at, best_end)
            stuck = np.flatnonzero(~on)
            out[rows[stuck], count[stuck]] = best[stuck]
            count[stuck] += 1
            at[stuck] = best_end[stuck]
            left = on | (at < sizes[rows])
            if not left.all():
                rows, at, node, count, best, best_end = (x[left] for x in (rows, at, node, count, best, best_end))
        filled = out >= 0
        return out[filled], filled.sum(axis=1)

    def greedy(self, word: bytes) -> list[int]:
        found, proposals, longest, at, n = [], self.proposals, self.longest, 0, len(word)
        while at < n:
            end = min(n, at + longest)
            while (token := proposals.get(word[at:end])) is None:
                end -= 1
            found.append(token)
            at = end
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """``encode_many`` as one list a word."""
        ids, counts = self.encode_many(words)
        ends = np.cumsum(counts)
        return [ids[a:b].tolist() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Propose, check every adjacent pair at once, and merge only the words that fail; the form is that of ``merge_many``."""
        chosen = np.arange(len(words))
        ids, counts = self._by_size(words, chosen, self.greedy_many, self.greedy)
        if len(ids) < 2:
            return ids, counts
        owner = np.repeat(chosen, counts)
        inside = owner[1:] == owner[:-1]
        pairs, back = np.unique((ids[:-1] << 32 | ids[1:])[inside], return_inverse=True)
        if not len(pairs):
            return ids, counts
        fits = self.pair_fits
        new = [p for p in pairs.tolist() if p not in fits]
        if new:
            fresh = np.array(new, np.int64)
            fits.update(zip(new, (self._first_crossing(fresh >> 32, fresh & 0xFFFFFFFF) == NEVER).tolist(), strict=True))
        good = np.fromiter(map(fits.__getitem__, pairs.tolist()), bool, len(pairs))[back]
        fails = np.zeros(len(words), bool)
        fails[owner[:-1][inside][~good]] = True
        failing = np.flatnonzero(fails)
        if not len(failing):
            return ids, counts
        merged, merged_counts = self._by_size(words, failing, self.merge_many, self.merge)
        kept, kept_counts = ids[~fails[owner]], counts[~fails]
        counts[failing] = merged_counts
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int64)
        ids[_spread(starts[~fails], kept_counts)] = kept
        ids[_spread(starts[failing], merged_counts)] = merged
        return ids, counts

    @staticmethod
    def _by_size(words: list[bytes], chosen: np.ndarray, many, one) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chosen words, of short ones by ``many`` and of others by ``one``."""
        sizes = np.fromiter((len(words[i]) for i in chosen.tolist()), np.int64, len(chosen))
        short, long = np.flatnonzero(sizes <= SIDE_BY_SIDE_BYTES), np.flatnonzero(sizes > SIDE_BY_SIDE_BYTES)
        counts = np.zeros(len(chosen), np.int64)
        found = np.zeros(0, np.int64)
        if len(short):
            found, counts[short] = many([words[i] for i in chosen[short].tolist()])
        if not len(long):
            return found, counts
        others = [one(words[i]) for i in chosen[long].tolist()]
        counts[long] = [len(ids) for ids in others]
        flat, starts = np.zeros(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        flat[_spread(starts[short], counts[short])] = found
        flat[_spread(starts[long], counts[long])] = np.concatenate([np.array(ids, np.int64) for ids in others])
        return flat, counts

    def _word_starts(self, points: np.ndarray) -> np.ndarray:
        """Places where a word of the pre-tokenizer starts; each edge is a word of its own."""
        kind = self.classes[points]
        n = len(points)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= kind == _EDGE
        space = kind == _SPACE
        # The last character of a run of spaces before something else stands alone, or joins what follows if it is a blank.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & (kind[1:] != _EDGE)
        start |= last
        blank = np.flatnonzero(last & (points == 0x20))
        start[blank + 1] = False
        # 's 't 'm 'd 're 've 'll, if the apostrophe starts a word and letters follow
        quote = np.flatnonzero((points[:-2] == 0x27) & start[:-2] & (kind[1:-1] == _LETTER)) if n > 2 else np.zeros(0, np.int64)
        if len(quote):
            one, two = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
            for chosen, width in ((quote[short], 2), (quote[long], 3)):
                start[chosen + 1] = False
                after = chosen + width
                start[after[after < n]] = True
        return start

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts of a slice and the bounds of each text's ids."""
        owners, pieces = [], []
        for i in range(len(part)):
            text = part.bytes_of(i)
            if b"<|" in text and any(s.encode() in text for s in self.special):
                for chunk in self._around_special(text.decode("utf-8")):
                    owners.append(i)
                    pieces.append(chunk)
            else:
                owners.append(i)
                pieces.append(text)
        ids, bounds = self._encode_plain([p if isinstance(p, bytes) else b"" for p in pieces])
        if len(pieces) == len(part):
            return ids, bounds
        parts, counts = [], np.zeros(len(part), np.int64)
        for k, (owner, piece) in enumerate(zip(owners, pieces, strict=True)):
            now = ids[bounds[k] : bounds[k + 1]] if isinstance(piece, bytes) else np.array([piece], np.uint32)
            parts.append(now)
            counts[owner] += len(now)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))

    def _around_special(self, text: str) -> list[bytes | int]:
        import re

        pattern = "(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
        return [self.special.get(s, s.encode()) for s in re.split(pattern, text) if s]

    def _encode_plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\0".join(texts) + b"\0"
        raw = np.frombuffer(joined, np.uint8)
        points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(sizes + 1) - 1
        # the bytes that start a code point; where all do, a place among code points is one among bytes
        leading = None if len(points) == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)
        if leading is not None:
            edges = np.searchsorted(leading, edges)
        points[edges] = EDGE_POINT
        starts = np.flatnonzero(self._word_starts(points))
        lengths = np.diff(np.append(starts, len(points)))
        is_edge = points[starts] == EDGE_POINT
        hashes = self._hashes(points, starts, lengths)
        slots = self.known.get(hashes)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            unique, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if self.known.count and self.known.count + len(unique) > CACHE_WORDS:
                missing = np.arange(len(hashes))
                unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                self.reset(len(unique))
            new = missing[first]
            low, high = starts[new], starts[new] + lengths[new]
            if leading is not None:
                bounds = np.append(leading, len(raw))
                low, high = bounds[low], bounds[high]
            words = [b"" if e else joined[a:b] for a, b, e in zip(low.tolist(), high.tolist(), is_edge[new].tolist(), strict=True)]
            slots[missing] = self._keep(unique, *self.encode_many(words))[inverse]
        counts = self.lengths[slots]
        total = int(counts.sum())
        before = np.cumsum(counts) - counts
        ids = self.flat[np.repeat(self.starts[slots] - before, counts) + np.arange(total)]
        ends = np.append(before, total)[np.flatnonzero(is_edge)]
        return ids, np.concatenate(([0], ends))

    def _hashes(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hash of each word: the sum over its places of a random value of the code point times a random factor of the place."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        place = np.arange(len(points), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        values = mix((np.arange(int(lengths.max()), dtype=np.uint64) + np.uint64(1)) * MULTIPLIERS[1] | np.uint64(1))[place]
        values |= np.uint64(1)
        values *= self.point_values[points]
        sums = np.add.reduceat(values, starts)
        return np.maximum(mix(sums + lengths.astype(np.uint64) * MULTIPLIERS[3]), np.uint64(1))

    def _keep(self, hashes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        base = self.known.count
        while base + len(counts) > len(self.lengths):
            self.lengths, self.starts = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.starts, 2 * len(self.starts))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        slots = np.arange(base, base + len(counts))
        self.lengths[slots] = counts
        self.starts[slots] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.put(hashes, slots)
        return slots


@lru_cache(maxsize=2)
def byte_table(path: str) -> list[bytes]:
    """Bytes of every id of a tokenizer file; special tokens stay as their text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    table = [b""] * (max([*spec["model"]["vocab"].values(), *special]) + 1)
    for text, i in spec["model"]["vocab"].items():
        table[i] = bytes(letters[c] for c in text)
    for i, text in special.items():
        table[i] = text
    return table


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)
