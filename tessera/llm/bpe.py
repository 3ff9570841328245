"""Byte-level BPE kernels on numpy arrays: vocabulary, pair table, two merge methods, pre-token interning.

Two merge methods live here. ``merge_padded`` holds pre-tokens of similar length in padded matrices, each row merging its
leftmost lowest-rank pair per round (``merge_blocks`` does the same for one very long pre-token). ``count_ragged`` holds all pre-tokens in one flat array, each sequence applying its
lowest-rank pair at all its places per round.
"""

from __future__ import annotations

import base64
import json
import math
import re
from functools import lru_cache

import numpy as np
import regex

NONE = np.int32(2**31 - 1)
#: Pre-tokens of more bytes than this are rows of a matrix each: a padded round for each merge would cost the square of it.
LONG = 512
#: Upper ends of the length buckets.
BUCKETS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 256, LONG)


class PairTable:
    """(left id, right id) -> (rank, merged id), by open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.full(size, NONE, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            at = slot[todo]
            free = self.keys[at] == np.uint64(2**64 - 1)
            cand = todo[free]
            _, first = np.unique(slot[cand], return_index=True)
            won = cand[first]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = keys[won], rank[won], merged[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, slot, -1)
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            s = slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[s]
            hit = held == keys[open_]
            out[open_[hit]] = s[hit]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.find(left, right)
        return np.where(at >= 0, self.rank[at], NONE).astype(np.int32)


def ascii_pattern(pattern: str) -> re.Pattern:
    """The same pattern for ASCII texts alone, with its classes spelt out, for the faster matcher of the standard library."""
    classes = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "}
    out, inside = [], False
    for token in re.findall(r"\[\^?|\]|\\p\{[LN]\}|\\.|.", pattern):
        if token in classes:
            out.append(classes[token] if inside else f"[{classes[token]}]")
        elif token == r"\S":
            out.append(r"[^\t-\r ]")
        else:
            inside = token[0] == "[" or inside and token != "]"
            out.append(token)
    return re.compile("".join(out))


class Vocabulary:
    """Tokens by id, ids of single bytes, and the pair table."""

    def __init__(self, tokens: list[bytes], table: PairTable, special: dict[str, int], pattern: str) -> None:
        self.tokens, self.table, self.special = tokens, table, special
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if tokens else np.zeros(0, np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes_to_id = np.full(256, -1, np.int32)
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.bytes_to_id[t[0]] = i
        self.split, self.split_ascii = regex.compile(pattern), ascii_pattern(pattern)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text in order; special strings stay whole where the vocabulary has them."""
        split = self.split_ascii if text.isascii() else self.split
        if self.special_split is None or not any(s in text for s in self.special):
            return split.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special_split.split(text)):
            out += [part] if i % 2 else split.findall(part)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_gather(self.flat, self.offsets[ids], self.lengths[ids]).tobytes()


@lru_cache(maxsize=4)
def from_ranks(path: str, pattern: str) -> Vocabulary:
    """Vocabulary of a rank file: each line has a token in base64 and its rank. Any two neighbours that join to a token can merge."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        tokens[rank] = token
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a), right.append(b), merged.append(rank)
    m = np.array(merged, np.int32)
    return Vocabulary(tokens, PairTable(np.array(left), np.array(right), m, m), {}, pattern)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            letters[chr(extra)] = b
            extra += 1
    return letters


@lru_cache(maxsize=4)
def from_json(path: str, pattern: str) -> Vocabulary:
    """Vocabulary of a tokenizer description in JSON: listed merges only, special strings kept whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for t, i in vocab.items():
        tokens[i] = t.encode() if t in special else bytes(letters[c] for c in t)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    table = PairTable(
        np.array([vocab[a] for a, _ in pairs]),
        np.array([vocab[b] for _, b in pairs]),
        np.arange(len(pairs), dtype=np.int32),
        np.array([vocab[a + b] for a, b in pairs], np.int32),
    )
    return Vocabulary(tokens, table, special, pattern)


def ragged_gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate flat[starts[i] : starts[i] + lengths[i]]."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def merge_blocks(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """The rounds of ``merge_padded`` for one very long pre-token, held as the rows of a square matrix that each know their
    lowest rank. A round finds the first row with the lowest rank, then the pair in it, merges that pair and looks again at the
    rows it touched: the root of the length instead of all of it. Half empty, the matrix is made anew."""
    none, known = int(NONE), {}

    def look(a: int, b: int) -> tuple[int, int]:
        found = known.get((a, b))
        if found is None:
            s = int(table.find(np.array([a]), np.array([b]))[0])
            found = known[a, b] = (int(table.rank[s]), int(table.merged[s])) if s >= 0 else (none, -1)
        return found

    while True:
        n, width = len(ids), max(16, math.isqrt(len(ids)))
        rows = -(-n // width)
        cells, ranks = np.zeros((rows, width), np.int64), np.full((rows, width), NONE, np.int32)
        cells.ravel()[:n], ranks.ravel()[: n - 1] = ids, table.ranks(ids[:-1], ids[1:])
        size = [width] * (rows - 1) + [n - width * (rows - 1)]
        lowest, left = ranks.min(1), n
        while 2 * left > n or n < 256:
            i = int(lowest.argmin())
            if lowest[i] == NONE:
                return np.concatenate([cells[r, : size[r]] for r in range(rows)]).astype(np.int32)
            j = int(ranks[i].argmin())

            def after() -> tuple[int, int] | None:
                if j + 1 < size[i]:
                    return i, j + 1
                return next(((r, 0) for r in range(i + 1, rows) if size[r]), None)

            r, c = after()
            new = cells[i, j] = look(int(cells[i, j]), int(cells[r, c]))[1]
            size[r] -= 1
            left -= 1
            for held in (cells, ranks):  # compaction of the row that lost its cell
                held[r, c : size[r]] = held[r, c + 1 : size[r] + 1]
            ranks[r, size[r]] = NONE
            follows = after()
            ranks[i, j] = look(new, int(cells[follows]))[0] if follows else NONE
            before = (i, j - 1) if j else next(((k, size[k] - 1) for k in range(i - 1, -1, -1) if size[k]), None)
            if before:
                ranks[before] = look(int(cells[before]), new)[0]
                lowest[before[0]] = ranks[before[0]].min()
            lowest[i] = ranks[i].min()
            if r != i:
                lowest[r] = ranks[r].min()
        ids = np.concatenate([cells[r, : size[r]] for r in range(rows)])


def merge_padded(matrix: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of a padded id matrix to its end. Returns the matrix and the lengths left."""
    n, width = matrix.shape
    if width < 2 or not n:
        return matrix, lengths
    out, out_len = matrix.copy(), lengths.copy()
    rows, ids, left = np.arange(n), matrix.astype(np.int32), lengths.copy()
    ranks = table.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    ranks[np.arange(width - 1)[None, :] >= (left - 1)[:, None]] = NONE
    while True:
        where = ranks.argmin(1)
        live = ranks[np.arange(len(rows)), where] != NONE
        if not live.all():  # compaction: finished rows leave
            done = ~live
            out[rows[done], : ids.shape[1]] = ids[done]
            out_len[rows[done]] = left[done]
            rows, ids, left, ranks, where = rows[live], ids[live], left[live], ranks[live], where[live]
            if not len(rows):
                return out, out_len
        k = np.arange(len(rows))
        ids[k, where] = table.merged[table.find(ids[k, where], ids[k, where + 1])]
        columns = np.arange(ids.shape[1])
        source = np.minimum(columns[None, :] + (columns[None, :] > where[:, None]), ids.shape[1] - 1)
        ids = np.take_along_axis(ids, source, 1)
        left -= 1
        ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], ranks.shape[1] - 1), 1)
        for place in (where - 1, where):
            ok = (place >= 0) & (place + 1 < left)
            r, p = k[ok], place[ok]
            ranks[r, p] = table.ranks(ids[r, p], ids[r, p + 1])
        ranks[columns[None, :-1] >= (left - 1)[:, None]] = NONE
        if (keep := int(left.max())) < ids.shape[1]:
            ids, ranks = ids[:, :keep], ranks[:, : keep - 1]
            if keep < 2:
                out[rows, :1], out_len[rows] = ids, left
                return out, out_len


def encode_padded(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens, concatenated, and how many each has."""
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = vocab.bytes_to_id[np.frombuffer(b"".join(raw), np.uint8)]
    start = np.cumsum(size) - size
    bucket = np.searchsorted(BUCKETS, size)
    counts, parts, order = size.copy(), [], []
    for b in np.unique(bucket):
        members = np.flatnonzero(bucket == b)
        if b == len(BUCKETS):
            done = [merge_blocks(flat[start[r] : start[r] + size[r]], vocab.table) for r in members]
            parts += done
            counts[members] = [len(x) for x in done]
            order.append(members)
            continue
        width, step = BUCKETS[b], max(1, 400_000 // BUCKETS[b])
        for at in range(0, len(members), step):
            rows = members[at : at + step]
            columns = np.arange(width)[None, :]
            inside = columns < size[rows][:, None]
            matrix = np.where(inside, flat[np.minimum(start[rows][:, None] + columns, max(0, len(flat) - 1))], 0)
            matrix, left = merge_padded(matrix, size[rows], vocab.table)
            parts.append(matrix[np.arange(width)[None, :] < left[:, None]].astype(np.int32))
            counts[rows] = left
            order.append(rows)
    if not parts:
        return np.zeros(0, np.int32), counts
    order_ = np.concatenate(order)
    grouped = np.concatenate(parts)
    begin = np.empty(len(raw), np.int64)
    lengths = counts[order_]
    begin[order_] = np.cumsum(lengths) - lengths
    return ragged_gather(grouped, begin, counts), counts


def count_ragged(words: list[str], vocab: Vocabulary) -> np.ndarray:
    """Tokens in each pre-token: every round, each sequence applies its lowest-rank pair at all its places."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    result = sizes.copy()
    own = np.flatnonzero(sizes > 1)
    ids = vocab.bytes_to_id[np.frombuffer(b"".join(raw[i] for i in own), np.uint8)]
    sizes = sizes[own]
    while len(own):
        start = np.cumsum(sizes) - sizes
        ranks = np.full(len(ids), NONE, np.int32)
        at = vocab.table.find(ids[:-1], ids[1:])
        at[start[1:] - 1] = -1
        found = at >= 0
        ranks[:-1][found] = vocab.table.rank[at[found]]
        lowest = np.minimum.reduceat(ranks, start)
        live = lowest != NONE
        if not live.all():
            result[own[~live]] = sizes[~live]
            keep = np.repeat(live, sizes)
            ids, ranks, at = ids[keep], ranks[keep], np.append(at, -1)[keep]
            own, sizes, lowest = own[live], sizes[live], lowest[live]
            if not len(own):
                break
        else:
            at = np.append(at, -1)
        hit = ranks == np.repeat(lowest, sizes)
        places = np.flatnonzero(hit)
        run = np.ones(len(places), bool)
        run[1:] = np.diff(places) != 1
        first = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - first) % 2 == 0]  # of overlapping places, every other one from the left
        ids[places] = vocab.table.merged[at[places]]
        gone = np.zeros(len(ids), bool)
        gone[places + 1] = True
        start = np.cumsum(sizes) - sizes
        sizes = sizes - np.add.reduceat(gone.astype(np.int64), start)
        ids = ids[~gone]
    return result


class Interner(dict):
    """Codes of pre-tokens. Keys without a code get the next one and wait in ``new``. Between chunks it is emptied once it holds
    ``limit`` keys, or 16 characters for each of so many."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.new, self.characters = limit, [], 0

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        self.characters += len(key)
        return code

    def full(self) -> bool:
        return len(self) > self.limit or self.characters > 16 * self.limit


class Counter:
    """Token counts of texts; remembers the counts of pre-tokens that it has met, up to a limit."""

    def __init__(self, vocab: Vocabulary, limit: int = 250_000) -> None:
        self.vocab, self.codes, self.counts = vocab, Interner(limit), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.codes.full():
            self.codes, self.counts = Interner(self.codes.limit), np.zeros(0, np.int64)
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = list(map(self.codes.__getitem__, self.vocab.pretokens(text)))
            sizes[i] = len(found)
            flat += found
        if self.codes.new:
            counts = count_ragged(self.codes.new, self.vocab)
            for i, w in enumerate(self.codes.new) if self.vocab.special else ():
                if w in self.vocab.special:
                    counts[i] = 1
            self.counts, self.codes.new = np.concatenate([self.counts, counts]), []
        return segment_sums(self.counts[np.array(flat, np.int64)], sizes)


class Encoder:
    """Token ids of texts; remembers the ids of pre-tokens that it has met, up to a limit."""

    def __init__(self, vocab: Vocabulary, limit: int = 250_000) -> None:
        self.vocab, self.codes = vocab, Interner(limit)
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and how many each text has."""
        if self.codes.full():
            self.__init__(self.vocab, self.codes.limit)
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = list(map(self.codes.__getitem__, self.vocab.pretokens(text)))
            sizes[i] = len(found)
            flat += found
        if self.codes.new:
            ids, counts = encode_padded(self.codes.new, self.vocab)
            if self.vocab.special and any(w in self.vocab.special for w in self.codes.new):
                parts = np.split(ids, np.cumsum(counts)[:-1])
                parts = [np.array([self.vocab.special[w]], np.int32) if w in self.vocab.special else p for w, p in zip(self.codes.new, parts, strict=True)]
                ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
            self.ids, self.counts, self.codes.new = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts]), []
            self.begins = np.cumsum(self.counts) - self.counts
        codes = np.array(flat, np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), sizes
        counts = self.counts[codes]
        return ragged_gather(self.ids, self.begins[codes], counts), segment_sums(counts, sizes)


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
