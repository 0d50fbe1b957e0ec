"""A compressed full-text index over sequences of word codes: Burrows-Wheeler transform, wavelet matrix, backward search.

What is kept is the transform, as a wavelet matrix, one position for each sequence, and where suffixes that share their
first words begin. The suffix order is made to build it and then dropped; where a suffix stands is found by walking back
to the start of its sequence.
"""

from __future__ import annotations

import numpy as np

#: The lowest 0, 1, ... 63 bits.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Wavelet:
    """A wavelet matrix: a packed bit per symbol and level, and the count before each 64 of them."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        n = len(symbols)
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            ones = bit.astype(bool)
            self.levels.append((level, words, counts, n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        values, starts = np.unique(symbols, return_index=True)  # sorted by their bits read from the top level down, so by value within a prefix
        self.start = np.zeros(1 << levels, np.int32)
        self.start[values] = starts

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        at = before
        for level, words, counts, zeros in self.levels:
            block = at >> 6
            ones = counts[block] + np.bitwise_count(words[block] & _BELOW[at & 63])
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol = np.zeros(len(at), np.int32)
        for level, words, counts, zeros in self.levels:
            block, inner = at >> 6, at & 63
            held = words[block]
            bit = ((held >> inner.astype(np.uint64)) & np.uint64(1)).astype(np.int32)
            ones = counts[block] + np.bitwise_count(held & _BELOW[inner])
            at = np.where(bit, zeros + ones, at - ones)
            symbol |= bit << level
        return symbol, at - self.start[symbol]


def suffix_order(code: np.ndarray) -> np.ndarray:
    """The suffixes in order. Each 0 ends a sequence; they are apart from each other, in the order in which they stand.

    Prefix doubling, in which suffixes that are told apart already are left alone.
    """
    n = len(code)
    ends = code == 0
    rank = np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + code).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    slots, idx, key, width = np.arange(n), order, rank[order], 1
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = slots[new]
        rank[idx] = np.repeat(starts, np.diff(np.append(np.flatnonzero(new), len(slots))))
        alone = new & np.append(new[1:], True)
        slots, idx = slots[~alone], idx[~alone]
        if not len(slots):
            return order
        # one that isn't alone has no end within ``width``, so what follows is still there
        key = rank[idx] * n + rank[idx + width]
        by = np.argsort(key, kind="stable")
        idx, key = idx[by], key[by]
        order[slots] = idx
        width *= 2


class Index:
    """Backward search over sequences of symbols from 1 on, each followed by a 0. ``depth``: the words of a whole match."""

    def __init__(self, text: np.ndarray, depth: int):
        self.size, self.depth = len(text), depth
        self.symbols, code = np.unique(text, return_inverse=True)
        code = code.reshape(-1).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.symbols)))]).astype(np.int32)
        order = suffix_order(code)
        before = code[order - 1]
        self.tree = Wavelet(before, max(1, int(len(self.symbols) - 1).bit_length()))
        #: Where each sequence begins, in the order of those suffixes.
        self.starts = order[before == 0].astype(np.int32)
        # rows that differ from the one before within depth - 1 words
        same = np.arange(1, self.size)
        for k in range(depth - 1):
            a, b = order[same - 1] + k, order[same] + k
            same = same[(code[a] == code[b]) & (code[a] != 0)] if len(same) else same
        edge = np.ones(self.size, bool)
        edge[same] = False
        self.edges = np.append(np.flatnonzero(edge), self.size).astype(np.int32)

    def codes(self, text: np.ndarray) -> np.ndarray:
        """The index's code of each symbol, -1 for those that it hasn't."""
        at = np.searchsorted(self.symbols, text).clip(0, len(self.symbols) - 1).astype(np.int32)
        return np.where(self.symbols[at] == text, at, -1).astype(np.int32)

    def _left(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of what ``code`` before what the intervals are of makes; empty where the code is unknown."""
        c = np.maximum(code, 0)
        ranks = self.tree.rank(np.concatenate([c, c]), np.concatenate([low, high]))
        return np.where(code < 0, 0, self.first[c] + ranks[: len(c)]), np.where(code < 0, 0, self.first[c] + ranks[len(c) :])

    def _found(self, codes: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the ``length`` words before each ``stop``."""
        low, high = np.zeros(len(stop), np.int32), np.full(len(stop), self.size, np.int32)
        alive = np.arange(len(stop))
        for k in range(1, length + 1):
            low[alive], high[alive] = self._left(codes[stop[alive] - k], low[alive], high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def matching(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``depth`` words of streams, from each stream's first on, the interval of its matches, empty where it has none.

        A stream is the run start to stop of ``codes``. It is read from its end to its start, with the interval of the
        ``depth`` words from where it is; one step left drops the last word, by widening the interval to the suffixes
        that share the others, and takes the word before. All streams go together. Where a match is lost, the window
        after it is searched anew.
        """
        count = np.maximum(0, stop - start - self.depth + 1)
        base = np.cumsum(count) - count
        low_of, high_of = np.zeros(int(count.sum()), np.int32), np.zeros(int(count.sum()), np.int32)
        live = np.flatnonzero(count)
        low, high = self._found(codes, stop[live], self.depth)
        step = 0
        while len(live):
            at = base[live] + count[live] - 1 - step
            low_of[at], high_of[at] = low, high
            step += 1
            on = count[live] > step
            live, low, high = live[on], low[on], high[on]
            if not len(live):
                break
            where = stop[live] - self.depth - step
            lost = low >= high
            group = np.searchsorted(self.edges, np.minimum(low, self.size - 1), "right") - 1
            low, high = self._left(codes[where], self.edges[group], self.edges[group + 1])
            if lost.any():
                low[lost], high[lost] = self._found(codes, where[lost] + self.depth, self.depth)
        return low_of, high_of

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``patterns`` the interval of suffixes that begin with it, empty where none does."""
        n, width = patterns.shape
        low, high = self._found(self.codes(patterns.reshape(-1)), np.arange(1, n + 1) * width, width)
        gone = low >= high
        return np.where(gone, 0, low), np.where(gone, 0, high)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows stand in the text."""
        out = np.zeros(len(rows), np.int32)
        left, at, step = np.arange(len(rows)), rows, 0
        while len(left):
            symbol, rank = self.tree.access(at)
            done = symbol == 0
            out[left[done]] = self.starts[rank[done]] + step
            on = ~done
            left, at, step = left[on], self.first[symbol[on]] + rank[on], step + 1
        return out

    @property
    def order(self) -> np.ndarray:
        return self.places(np.arange(self.size))

    def least(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of ``values`` (one per position of the text) over the suffixes of each interval; intervals are equal or apart, none is empty."""
        starts, back = np.unique(low, return_inverse=True)
        ends = np.empty(len(starts), np.int64)
        ends[back] = high
        size = ends - starts
        begin = np.cumsum(size) - size
        rows = np.repeat(starts - begin, size) + np.arange(size.sum())
        return np.minimum.reduceat(values[self.places(rows)], begin)[back]
