"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the sum
over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words (runs of letters, lower
case, marked at their start). The pieces' probabilities come from expectation-maximisation: forward and backward passes over
word counts give each piece its expected count in all segmentations.

The model is fitted on at most about ``max_rows`` texts of each language (those whose id hashes lowest); prediction reads every
whole text. Expected counts are summed in Spark; what reaches the driver has a row for each piece and language at most.

The posterior compares the learned languages alone, so text in none of them can be sure of one. ``fit`` tells such text: the
log-probability of a letter that is usual in the language, over that of the text's letters; about 1 for its own texts, less
for text that the language's pieces explain worse.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing was learned. Ties
go to the language that sorts first; ``und`` has fit 0. Words have any length: sums are scaled on the way. Rows with a null id or language are
never learned from. One row comes out for each row that goes in. Only the named columns are read. An empty table gives an
empty table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime
from .bpe import Interner, segment_sums

START = "▁"
FLOOR = 1e-7
#: Letters of words looked at together, starts of pieces held at once, letters after which sums are scaled.
LETTERS, SPAN, SCALED = 160_000, 512, 16
WORDS = regex.compile(r"\p{L}+")
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The letter pieces of a vocabulary, found by the hash of their code points."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.texts = sorted({p for p in found if p.removeprefix(START).isalpha() and p == p.lower()} | {START})
        self.longest = max(map(len, self.texts))
        keys = np.array([self.key(p) for p in self.texts], np.uint64) * _MIX
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        bits = self.bits = 18
        heads = np.searchsorted(self.keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        self.heads, self.depth = heads[:-1], int(np.diff(heads).max())

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 0x9E3779B97F4A7C15) % 2**64
        return h

    def __len__(self) -> int:
        return len(self.texts)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each piece; len(self) where there is none."""
        hashes = hashes * _MIX
        at = self.heads[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(hashes), len(self), np.int64)
        for step in range(self.depth):
            ok = np.minimum(at + step, len(self.keys) - 1)
            hit = self.keys[ok] == hashes
            out[hit] = self.order[ok[hit]]
        return out


_pieces: dict[str, Pieces] = {}
runtime.dropped_with(_pieces.clear)


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


Cuts = Iterator[tuple[int, list[list[tuple[int, np.ndarray]]]]]


def _cuts(words: list[str], vocab: Pieces) -> Iterator[tuple[np.ndarray, int, Callable[[], Cuts]]]:
    """For words by length, a bounded number of letters at a time: their indices, their length with the mark, and a walk over
    all starts, which gives the lengths and indices of the pieces there, SPAN starts at once however long the word.

    A single letter that is no piece gets index len(vocab) + 1; other absent pieces len(vocab)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for size in np.unique(sizes).tolist():
        members = np.flatnonzero(sizes == size)
        for rows in np.array_split(members, -(-len(members) * size // LETTERS)):
            if not len(rows):
                continue
            points = np.frombuffer("".join(START + words[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), size)

            def walk(points=points, size=size) -> Cuts:
                for first in range(0, size, SPAN):
                    starts = min(SPAN, size - first)
                    part = points[:, first : first + starts + vocab.longest - 1].astype(np.uint64)
                    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(starts)]
                    hashes = None
                    for length in range(1, min(vocab.longest, part.shape[1]) + 1):
                        width = min(starts, part.shape[1] - length + 1)
                        ends = part[:, length - 1 : length - 1 + width] + _MIX
                        hashes = ends if hashes is None else hashes[:, :width] * _BASE + ends
                        at = vocab.find(np.ascontiguousarray(hashes).ravel()).reshape(hashes.shape)
                        if length == 1:
                            at[at == len(vocab)] += 1
                        for start in range(width):
                            if (at[:, start] != len(vocab)).any():
                                found[start].append((length, np.ascontiguousarray(at[:, start])))
                    yield first, found

            yield rows, size, walk


def forward(rows: int, size: int, walk: Callable[[], Cuts], chance, keep: list | None = None) -> np.ndarray:
    """(rows, ...) logarithms of the sums over all segmentations. chance: piece indices -> probabilities.

    Sums of prefixes wait until their end is reached, and are scaled again and again, so long words don't underflow. keep
    gets the sum and the logarithm of its scale at every start."""
    scale = np.zeros(chance(np.zeros(rows, np.int64)).shape)
    wait = {0: np.ones(scale.shape)}
    for first, found in walk():
        for start, pieces_ in enumerate(found, first):
            now = wait.pop(start)
            if start and start % SCALED == 0:
                for later in wait.values():
                    later /= now
                scale, now = scale + np.log(now), np.ones(scale.shape)
            if keep is not None:
                keep.append((now, scale))
            for length, at in pieces_:
                more = now * chance(at)
                if start + length in wait:
                    wait[start + length] += more
                else:
                    wait[start + length] = more
    return scale + np.log(wait[size])


def word_scores(words: list[str], vocab: Pieces, table: np.ndarray) -> np.ndarray:
    """(words, languages) log-probabilities. table: (pieces + 2, languages)."""
    out = np.zeros((len(words), table.shape[1]))
    for rows, size, walk in _cuts(words, vocab):
        out[rows] = forward(len(rows), size, walk, lambda at: table[at])
    return out


def expected_counts(words: list[str], lang: np.ndarray, weight: np.ndarray, vocab: Pieces, table: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """(pieces + 2, languages) expected counts of pieces over all segmentations of the words. Log-probabilities and letters of
    the words are added to seen, (2, languages)."""
    out = np.zeros(table.size)
    seen = np.zeros((2, table.shape[1])) if seen is None else seen
    for rows, size, walk in _cuts(words, vocab):
        k, places, shares = lang[rows], [], []
        chance = lambda at, k=k: table[at, k]
        before: list[tuple[np.ndarray, np.ndarray]] = []
        whole = forward(len(rows), size, walk, chance, before)
        seen += [np.bincount(k, weight[rows] * v, table.shape[1]) for v in (whole, np.full(len(rows), size - 1.0))]
        after, scale = {size: np.ones(len(rows))}, np.zeros(len(rows))  # sums over the segmentations of what follows a place
        for first, found in reversed(list(walk())):
            for start, pieces_ in reversed(list(enumerate(found, first))):
                alpha, alpha_scale = before[start]
                factor, now = weight[rows] * alpha * np.exp(alpha_scale + scale - whole), np.zeros(len(rows))
                for length, at in pieces_:
                    p = chance(at) * after[start + length]
                    now += p
                    places.append(at * table.shape[1] + k), shares.append(factor * p)
                after.pop(start + vocab.longest, None)
                after[start] = now
                if start % SCALED == 0:
                    scale = scale + np.log(now)
                    for later in after.values():
                        if later is not now:
                            later /= now
                    after[start] = np.ones(len(rows))
        out += np.bincount(np.concatenate(places), np.concatenate(shares), table.size)
    return out.reshape(table.shape)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray
    path: str
    name: str
    #: Mean log-probability of a letter in each language's own words.
    usual: np.ndarray


def _normalised(counts: np.ndarray, smooth: float) -> np.ndarray:
    """Probabilities from counts of pieces, with the rows for absent pieces (0) and unknown letters."""
    n = len(counts) - 2
    table = (counts + smooth) / (counts[:n].sum(0) + counts[n + 1] + smooth * (n + 1))
    table[n] = 0
    return np.where(table > 0, np.maximum(table, FLOOR), table) if n else table


def train(rows: DataFrame, path: str, text: Column, lang: Column, id_: Column, max_rows: int = 5_000, rounds: int = 3, smooth: float = 0.05) -> Model:
    """Fit on rows with a language, at most about max_rows of each. path: a sentencepiece model, readable on all machines."""
    spark = rows.sparkSession
    runtime.ship(spark)
    known = rows.where(lang.isNotNull() & id_.isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang.alias("k")).count().collect()}  # a row for each language
    languages = tuple(sorted(sizes))
    vocab = pieces(path)
    if not languages:
        return Model((), np.zeros((len(vocab) + 2, 0)), path, uuid.uuid4().hex, np.zeros(0))
    index = {k: i for i, k in enumerate(languages)}
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_rows / sizes[k]))]), lang)
    sample = known.where(F.pmod(F.xxhash64(id_), F.lit(1 << 30)) < share * float(1 << 30)).select(lang.alias("lang"), text.alias("text"))

    def words(batches):
        for batch in runtime.slices(batches, "text"):
            counts: Counter = Counter()
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = index[k]
                counts.update((i, w) for w in WORDS.findall((t or "").lower()))
            ks = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in ks], pa.int32()), pa.array([w for _, w in ks], pa.string()), pa.array(list(counts.values()), pa.int64())], ["k", "word", "n"])

    table_of_words = runtime.materialize(sample.mapInArrow(words, "k int, word string, n long").groupBy("k", "word").agg(F.sum("n").alias("n")), "words", sample, runtime.NARROW)
    table = _normalised(np.ones((len(vocab) + 2, len(languages))), 0.0)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(table)  # (pieces, languages): fixed by the vocabulary

        def expect(batches, held=held):
            own, total = pieces(path), np.zeros(held.value.shape)
            seen = np.zeros((2, total.shape[1]))
            for batch in batches:
                k, w, n = batch.columns
                if batch.num_rows:
                    total += expected_counts(w.to_pylist(), k.to_numpy(), n.to_numpy().astype(float), own, held.value, seen)
            total = np.vstack([total, seen])
            at, lang_at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(lang_at.astype(np.int32)), pa.array(total[at, lang_at])], ["piece", "k", "c"])

        found = np.zeros((len(table) + 2, len(languages)))
        for r in table_of_words.mapInArrow(expect, "piece int, k int, c double").groupBy("piece", "k").agg(F.sum("c").alias("c")).collect():
            found[r["piece"], r["k"]] = r["c"]
        table = _normalised(found[:-2], smooth)
    runtime.discard(table_of_words)
    return Model(languages, table, path, uuid.uuid4().hex, found[-2] / np.maximum(found[-1], 1))


class Predictor:
    """Scores texts with one model; remembers words that it has met, up to a limit."""

    def __init__(self, model: Model, limit: int = 250_000) -> None:
        self.model, self.vocab, self.words = model, pieces(model.path), Interner(limit)
        self.scores = np.zeros((0, len(model.languages) + 1))  # and the letters of each word

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages + 1) log-probabilities and letters, and how many words each text has."""
        if self.words.full():
            self.words, self.scores = Interner(self.words.limit), self.scores[:0]
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = list(map(self.words.__getitem__, WORDS.findall(text.lower())))
            sizes[i] = len(found)
            flat += found
        if self.words.new:
            new = np.column_stack([word_scores(self.words.new, self.vocab, self.model.table), list(map(len, self.words.new))])
            self.scores, self.words.new = np.vstack([self.scores, new]), []
        codes = np.array(flat, np.int64)
        return np.stack([segment_sums(column[codes], sizes) for column in self.scores.T], 1), sizes


def decide(scores: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language (-1: no word, or no language) and its posterior probability."""
    if not scores.shape[1]:
        return np.full(len(words), -1), np.zeros(len(words))
    sure = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
    return np.where(words == 0, -1, scores.argmax(1)), np.where(words == 0, 0.0, sure)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, text_as: str | None = None) -> DataFrame:
    """``id_col``, extra columns, the text itself under the name text_as, lang_pred, score and fit of every whole text. Extra
    columns and text go through the workers with the text that they read, so nothing is joined."""
    spark = docs.sparkSession
    runtime.ship(spark)
    held = spark.sparkContext.broadcast(model)
    extra = extra or {}
    kinds = dict(docs.select(docs[id_col].alias("id"), *[v.alias(f"x{i}") for i, v in enumerate(extra.values())]).dtypes)
    names = np.array([*model.languages, "und"], object)
    name, usual = model.name, model.usual

    def run(batches):
        own = runtime.worker_cache(("predictor", name), lambda: Predictor(held.value))
        for batch in runtime.slices(batches, "text"):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            total, words = np.zeros((len(texts), len(names))), np.zeros(len(texts), np.int64)
            for at, held_texts in runtime.parts(texts):
                scores, sizes = own(held_texts)
                np.add.at(total, at, scores)
                np.add.at(words, at, sizes)
            best, sure = decide(total[:, :-1], words)
            mean = total[np.arange(len(texts)), best] / np.maximum(total[:, -1], 1)
            fit = np.where(best < 0, 0.0, np.append(usual, 0.0)[best] / np.where(best < 0, 1.0, mean))
            kept = [batch.column(1)] if text_as else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *kept, pa.array(names[best], pa.string()), pa.array(np.round(sure, 6)), pa.array(np.round(fit, 6))], ["id", *batch.schema.names[2:], *["text"] * len(kept), "lang_pred", "score", "fit"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *[v.alias(f"x{i}") for i, v in enumerate(extra.values())])
    out = rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", text string" * bool(text_as) + ", lang_pred string, score double, fit double")
    text = [F.col("text").alias(text_as)] if text_as else []
    return out.select(F.col("id").alias(id_col), *[F.col(f"x{i}").alias(k) for i, k in enumerate(extra)], *text, "lang_pred", "score", "fit")


def held_out(id_: Column) -> Column:
    """True for the fifth of ids that no model learns from; so are null ids."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(5)) == 0, F.lit(True))


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """Learn from rows that aren't held out, predict all: ``id_col``, held_out, lang_pred, score, fit."""
    out = held_out(docs[id_col])
    model = train(docs.where(~out), path, docs[text_col], docs[lang_col], docs[id_col], **settings)
    return predict(docs, model, id_col, text_col, {"held_out": out})
