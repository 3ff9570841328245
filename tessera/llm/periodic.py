"""Runs of repeated words: maximal stretches with a smallest period, from Lyndon words.

A stack of starts, scanned from right to left, gives the longest Lyndon word at each start, once under the order of the word
numbers and once under the reverse; each run has one of these words as its root. Suffixes are compared, and roots extended to both sides,
by the longest common extension: halving over rolling hashes, after which the words themselves are compared, so no result rests
on a hash. Stretches known to repeat at some distance answer later comparisons at that distance, so a text of one word isn't
quadratic. No suffix array is built.

The scan runs over those parts of a text that can hold a run: in a run of period q and ``exponent`` times that length or more,
each word but the last q comes again within q words, for (exponent - 1) q words in a row. Parts without such a stretch, found by
the distance to each word's next occurrence, have no run.

Defined results: a null or empty text has no words, no runs and an empty collapsed text. Ids may be null or repeat: a row comes
out for each row that goes in, and only the id and text columns are read. Texts may be as long as a worker can hold. Several
runs may overlap; a word goes if any run drops it. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
RUNS = "array<struct<start: long, length: long, period: long>>"
#: Words that are compared one by one before hashes are.
NEAR = 8


class _Words(dict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbers(words: list[bytes]) -> np.ndarray:
    known = runtime.worker_cache("word numbers", _Words)
    if len(known) > 300_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def next_same(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the distance to its next occurrence in its text; beyond all lengths where there is none. ends: of the texts."""
    n = len(words)
    order = np.sort(words * n + np.arange(n)) if n else np.zeros(0, np.int64)
    at = order % max(n, 1)
    text = np.searchsorted(ends, at, side="right")
    same = (order[1:] // max(n, 1) == order[:-1] // max(n, 1)) & (text[1:] == text[:-1])
    distance = np.full(n, np.iinfo(np.int64).max)
    distance[at[:-1][same]] = (at[1:] - at[:-1])[same]
    return distance


def parts(distance: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """From and to of stretches whose words all come again within the longest period that a stretch allows, and that period."""
    mask = distance < np.iinfo(np.int64).max
    while True:
        change = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        low, high = change[::2], change[1::2]
        n = high - low
        longest = n // (exponent - 1)
        longest = np.where(longest >= np.maximum(1, least - n), longest, 0)  # a period q takes (exponent - 1) q words in a row, and least - q
        allowed = np.zeros(len(mask), np.int64)
        allowed[mask] = np.repeat(longest, n)
        fewer = mask & (distance <= allowed)
        if fewer.sum() == mask.sum():
            return list(zip(low.tolist(), high.tolist(), longest.tolist(), strict=True))
        mask = fewer


class _Text:
    """Words of one text with their rolling hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.a = words.tolist()
        self.n = n = len(self.a)
        power = np.full(n + 1, np.uint64(_BASE))
        power[0] = 1
        power = np.multiply.accumulate(power)
        x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        self.power, self.hash = power.tolist(), [0, *np.cumsum(x * power[:n], dtype=np.uint64).tolist()]
        #: By distance, the last stretch found to repeat at it: from, and to (which includes the repetition).
        self.known: dict[int, tuple[int, int]] = {}

    def _equal(self, i: int, j: int, size: int) -> bool:
        h = self.hash
        return ((h[i + size] - h[i]) * self.power[j - i] - (h[j + size] - h[j])) & _MASK == 0

    def forward(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        a, most = self.a, self.n - j
        found = self.known.get(j - i)
        if found and found[0] <= i and j < found[1]:
            return found[1] - j
        size = 0
        while size < most and size < NEAR and a[i + size] == a[j + size]:
            size += 1
        if size < NEAR or size == most:
            return size
        low, high = size, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._equal(i, j, middle) else (low, middle - 1)
        if a[i : i + low] != a[j : j + low]:  # hashes that collide
            low = next(k for k in range(low) if a[i + k] != a[j + k])
        return low

    def backward(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        a = self.a
        size = 0
        while size < i and size < NEAR and a[i - 1 - size] == a[j - 1 - size]:
            size += 1
        if size < NEAR or size == i:
            return size
        low, high = size, i
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._equal(i - middle, j - middle, middle) else (low, middle - 1)
        if a[i - low : i] != a[j - low : j]:
            low = next(k for k in range(low) if a[i - 1 - k] != a[j - 1 - k])
        return low

    def roots(self, low: int, high: int, sign: int, least: int, exponent: int, found: set) -> None:
        """Runs with a root in words low to high under one order; the end of the part comes before any word."""
        a, stack, covered = self.a, [high], {}
        for i in range(high - 1, low - 1, -1):
            j = stack[-1]
            while j < high:
                x, y = a[i], a[j]
                if x == y:
                    size = self.forward(i, j)
                    if j - i <= size:
                        self._extend(i, j, size)
                    if j + size >= high:
                        break  # what follows j begins what follows i: it is the smaller one
                    x, y = a[i + size], a[j + size]
                if (y - x) * sign < 0:
                    break
                stack.pop()
                j = stack[-1]
            stack.append(i)
            period = j - i
            if j < self.n and a[i] == a[j] or i and a[i - 1] == a[j - 1]:
                done = covered.get(period)
                if done and done[0] <= i and j <= done[1]:
                    continue
                size = self.forward(i, j) if j < self.n else 0
                start, end = self._extend(i, j, size)
                covered[period] = start, end
                if end - start >= max(least, exponent * period):
                    found.add((start, end - start, period))

    def _extend(self, i: int, j: int, size: int) -> tuple[int, int]:
        """From and to of the longest stretch around i and j that repeats at their distance, of which size words are known."""
        found = self.known.get(j - i)
        if found and found[0] <= i and j <= found[1]:
            return found
        found = i - self.backward(i, j), j + size
        if found[1] - found[0] >= 2 * (j - i):
            self.known[j - i] = found
        return found


def runs(words: np.ndarray, least: int = 6, exponent: int = 4, distance: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """start, length and period of every run of a text of word numbers, by start, then period. A run's smallest period is q, its
    length at least ``least`` and ``exponent`` times q (2 or more), and no neighbouring word extends it keeping q."""
    if distance is None:
        distance = next_same(words, np.array([len(words)]))
    found: set = set()
    text = None
    for low, high, longest in parts(distance, least, exponent):
        text = text or _Text(words)
        end = min(text.n, high + longest + 1)  # a run of the part ends before, or with the text
        for sign in (1, -1):
            text.roots(low, end, sign, least, exponent, found)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by spaces: of each run the first period."""
    if found:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            change[start + period] += 1
            change[start + length] -= 1
        kept = np.cumsum(change[:-1]) == 0
        words = [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]
    return b" ".join(words)


def find(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, runs (start and length in words, period; by start, then period) and collapsed, the text with one
    period of each run, its words joined by single spaces. Words are what ASCII white space parts."""
    runtime.ship(docs.sparkSession)

    def run(batches):
        for batch in runtime.slices(batches, "text"):
            split = [(x or "").encode().split() for x in batch.column(1).to_pylist()]
            n = [len(x) for x in split]
            words = [numbers(x) for x in split]
            ends = np.cumsum(n)
            distance = next_same(np.concatenate(words), ends)
            found = [runs(w, least, exponent, distance[e - len(w) : e]) for w, e in zip(words, ends.tolist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            rows = [[{"start": s, "length": k, "period": p} for s, k, p in f] for f in found]
            text = [collapsed(w, f).decode() for w, f in zip(split, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(rows, kind), pa.array(text)], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
