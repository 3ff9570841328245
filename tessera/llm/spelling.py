"""Spelling variants grouped by full neighbourhoods.

Words are counted map-side, then by Spark. Every word of the vocabulary emits all distinct strings that one deletion, one
replacement or one insertion over the observed alphabet gives; an equi-join with the vocabulary leaves those that are words.
Equality is all it takes, no distance is computed. Each word's most frequent neighbour, if that is frequent enough, is its form;
forms are followed to the last by pointer jumping.

A neighbourhood has about a thousand strings a word, most of which are no words. So the strings first meet a table of bits:
a word of the vocabulary sets two bits, by hashes that follow from the word's in a few operations for each neighbour, and only
strings whose bits are set are built and shuffled. The table has 128 bits a word, at most ``_MOST_BITS`` (32 MB): that bounds what
is broadcast, however large the vocabulary; beyond it more strings pass that the join then drops. No neighbour is lost.

Defined results: null and empty texts have no words; a null id counts as an empty string where ids matter (``typos``). Texts and
words may be of any length. Repeated rows count each time. Of neighbours with the same count the first in code-point
order is the form. Only the named columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Letters A to Z and U+00C0 to U+00FF; all other characters part words. Each code point up to U+00FF is one byte of Latin-1.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_MOST_BITS = 28
#: Neighbours that are hashed at once.
_AT_ONCE = 1 << 21
_HELD = 400_000
_B = 0x9E3779B97F4A7C15
_B_INVERSE = np.uint64(pow(_B, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str) -> list[bytes]:
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def word_counts(docs: DataFrame, shortest: int = 6, typos: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: distinct lower-case runs of letters of at least ``shortest`` code points, and how often all whole texts have them.

    typos: delete a letter of about one in so many distinct words of a document, wherever the document has the word."""
    runtime.ship(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in runtime.slices(batches, "text"):
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                found: Counter = Counter()
                for piece in runtime.pieces(text):
                    found.update(words_of(piece))
                if typos:
                    seed = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                    crc = zlib.crc32
                    for word, n in found.items():
                        if len(word) >= shortest:
                            h = crc(word if word.isascii() else word.decode("latin-1").encode(), seed)
                            if h % typos == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < shortest:
                                    continue
                            held[word] += n
                else:
                    for word, n in found.items():
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) > _HELD:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Hashes:
    """Polynomial hashes of words and of their neighbours over an alphabet (code points up to U+00FF)."""

    def __init__(self, alphabet: list[int]) -> None:
        self.alphabet = np.array(alphabet, np.int64)
        x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_B)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        self.of = (x ^ (x >> np.uint64(27))) * _MIX[1]

    def _sums(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: a row of code points each. Powers of the base, and sums of each word's first letters."""
        power = np.full(words.shape[1] + 1, np.uint64(_B))
        power[0] = 1
        power = np.multiply.accumulate(power)
        sums = np.zeros((len(words), words.shape[1] + 1), np.uint64)
        np.cumsum(self.of[words] * power[:-1], axis=1, dtype=np.uint64, out=sums[:, 1:])
        return power, sums

    def words(self, words: np.ndarray) -> np.ndarray:
        return self._sums(words)[1][:, -1]

    def neighbours(self, words: np.ndarray):
        """Hashes of distinct neighbours: deletions (word, place), replacements and insertions (word, place, letter), each with
        the mask of those that count, since some edits give the same string."""
        power, sums = self._sums(words)
        size, whole = words.shape[1], sums[:, -1:]
        letters = self.of[self.alphabet]
        last = np.concatenate([words[:, 1:] != words[:, :-1], np.ones((len(words), 1), bool)], axis=1)  # of equal letters in a row
        yield "delete", sums[:, :-1] + (whole - sums[:, 1:]) * _B_INVERSE, last
        other = words[:, :, None] != self.alphabet
        yield "replace", whole[:, :, None] + (letters - self.of[words][:, :, None]) * power[:size, None], other
        before = np.concatenate([other, np.ones((len(words), 1, len(letters)), bool)], axis=1)  # before an equal letter is as good as after it
        yield "insert", (sums + (whole - sums) * np.uint64(_B))[:, :, None] + letters * power[:, None], before


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    out = []
    for k in range(2):
        x = (hashes ^ (hashes >> np.uint64(31))) * _MIX[k]
        out.append((x ^ (x >> np.uint64(29))) * np.uint64(_B) >> np.uint64(64 - bits))
    return out[0], out[1]


def _by_length(words: list[str], limit: int, wide: int):
    """Numbers and code points of words of one length, so many at a time that they have about limit neighbours."""
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(len(w), []).append(i)
    for size, all_ in at.items():
        step = max(1, limit // ((size + 1) * wide))
        for k in range(0, len(all_), step):
            part = all_[k : k + step]
            yield part, np.frombuffer("".join(words[i] for i in part).encode("latin-1"), np.uint8).reshape(len(part), size).astype(np.int64)


def _bits(vocabulary: DataFrame, alphabet: list[int], bits: int) -> np.ndarray:
    """The table of bits of a vocabulary: made by ranges, 64 bits a row, of which there are at most 2^(bits - 6)."""

    def run(batches):
        hashes = Hashes(alphabet)
        for batch in batches:
            for _, words in _by_length(batch.column(0).to_pylist(), _AT_ONCE, 1):
                slot = np.concatenate(_slots(hashes.words(words), bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    rows = vocabulary.select("word").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    table[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return table


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words of a vocabulary (word, n; a table) that differ by one edit, in both directions."""
    spark = vocabulary.sparkSession
    runtime.ship(spark)
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = sorted(ord(r[0]) for r in letters.collect())  # 90 letters at most
    size = vocabulary.count()
    bits = min(_MOST_BITS, max(10, (128 * size).bit_length()))
    table = spark.sparkContext.broadcast(_bits(vocabulary, alphabet, bits))

    def run(batches):
        hashes, held, chars = Hashes(alphabet), table.value, [chr(c) for c in alphabet]
        if not alphabet:
            return
        for batch in batches:
            words = batch.column(0).to_pylist()
            for rows, codes in _by_length(words, _AT_ONCE, len(chars)):
                of, near = [], []
                for kind, h, mask in hashes.neighbours(codes):
                    first, second = _slots(h, bits)
                    hit = mask & ((held[first >> np.uint64(6)] >> (first & np.uint64(63))) & np.uint64(1) == 1)
                    at = np.nonzero(hit)
                    second = second[at]
                    at = [x[(held[second >> np.uint64(6)] >> (second & np.uint64(63))) & np.uint64(1) == 1].tolist() for x in at]
                    for k, i, *letter in zip(*at, strict=True):
                        word = words[rows[k]]
                        of.append(rows[k])
                        near.append(word[:i] + (chars[letter[0]] if letter else "") + word[i + (kind != "insert") :])
                picked = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(near, pa.string())], ["word", "n", "near"])

    emitted = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, near string")
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return emitted.join(known, "near").select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. word, root: where the forms of forms end. Counts grow fivefold a step, or at least by one, so no circle
    exists; each round doubles the steps."""
    now = runtime.materialize(forms.select("word", F.col("form").alias("root")), "roots", forms, runtime.NARROW)
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, after = now, runtime.materialize(moved, "roots", forms, runtime.NARROW)
        runtime.discard(before)
        now = after.drop("moved")
        now._tessera_path = after._tessera_path
        if not after.where("moved").limit(1).count():
            return now


def group(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """counts: word, n (distinct words of letters that word_counts has). word, n, n_near, form, form_n, root: how many words are
    one edit away, the most frequent of them if it is ``ratio`` (2 or more) times as frequent, and where its forms end."""
    vocabulary = runtime.materialize(counts.select("word", "n"), "vocabulary", counts, runtime.NARROW)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))  # strings compare by code points
    near = neighbours(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    near = near.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"))
    near = runtime.materialize(near, "near", vocabulary, runtime.NARROW)
    roots = _roots(near.where("form IS NOT NULL").select("word", "form"))
    both = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
