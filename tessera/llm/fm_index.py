"""An FM-index over numbered words: suffix sorting by doubling, a wavelet matrix of the transform, sampled suffix positions.

Plain arrays of one shard; every search and every walk handles all its phrases or rows at once.
"""

from __future__ import annotations

import numpy as np

#: A suffix position is kept for every so many words of the text.
SAMPLED = 16


class Bits:
    """A bit vector with rank: words of 64 bits and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix: a level for each bit of a symbol, the highest first; zeros go before ones from level to level."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for b in range(self.depth - 1, -1, -1):
            ones = (values >> b) & 1 == 1
            self.levels.append((Bits(ones), int(len(values) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])
        #: Where each symbol's places begin below the last level.
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where((symbols >> (self.depth - 1 - level)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbols = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones(at)
            symbols = symbols * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes in their order; an end comes before any symbol. Suffixes are first sorted by as many symbols as a
    64-bit key holds, then only those that still tie are sorted again, by the rank of what follows, twice as far each time."""
    n, bits = len(text), max(1, int(symbols).bit_length())
    reach = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key <<= bits
        key[: max(0, n - k)] |= text[k:] + 1
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    open_ = ~(new & np.concatenate([new[1:], [True]]))  # slots of groups of two or more
    slots = np.flatnonzero(open_)
    while len(slots):
        rows = order[slots]
        ahead = rows + reach
        key = rank[rows] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[slots] = rows
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.concatenate([new[1:], [True]]))]
        reach *= 2
    return order


class Index:
    """text: symbols from 0 to symbols - 1, none of them negative."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        text = np.append(np.asarray(text, np.int64) + 1, 0)  # 0 ends the text
        self.symbols = symbols + 1
        order = suffix_array(text, self.symbols)
        self.wavelet = Wavelet(text[order - 1], self.symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        kept = order % SAMPLED == 0
        self.kept, self.samples = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: a row of symbols each. The rows of the index, from and to, whose suffixes begin with each phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        last = phrases[:, -1] + 1
        low[:], high[:] = self.before[last], self.before[last + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = phrases[live, k] + 1
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.before[symbol] + both[: len(live)], self.before[symbol] + both[len(live) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text where the suffixes of these rows begin: steps back to a row whose place is kept."""
        places, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            known = self.kept.get(rows)
            places[left[known]] = self.samples[self.kept.ones(rows[known])] + steps
            left, rows = left[~known], rows[~known]
            symbol, rank = self.wavelet.access(rows)
            rows, steps = self.before[symbol] + rank, steps + 1
        return places
