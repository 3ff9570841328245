"""Benchmark decontamination with an FM-index of every training shard.

The phrases are the windows of ``width`` words of all benchmark items; an item of fewer words is one phrase. Each task turns
its documents into shards of words and indexes each of them. The phrases are searched backwards through wavelet-tree ranks, all
at once; rows of the index that are left are located by sampled suffix positions; the occurrences are merged into spans.

A word that no phrase has is one symbol in the index, and stretches between such words that are shorter than any phrase are left
out, as no occurrence reaches over them. A shard has at most SHARD words; longer documents are cut there, and neighbouring
shards share the words of a phrase but one, so that no occurrence is lost.

Phrases are broadcast in blocks of at most ``block_bytes``, dealt by a hash of phrase and item, as many as their measured size
needs; each block is searched in all documents. With more than one block the spans of a document meet by its row number.

Defined results: a null or empty text has no words and no spans. A null item id is listed as an empty string; items that share
an id are one. Ids of documents may be null or repeat: a row comes out for each row that goes in. Only the named columns are
read. Texts and words may be of any length; phrase words over 64 bytes are compared by 128-bit hashes. Occurrences that touch or
overlap are one span. An empty benchmark finds nothing, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .fm_index import Index

SHARD = 1 << 20
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b not in range(123, 128) else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = "array<struct<start: long, end: long, from: long, to: long>>"
_LONG = 64


def words_of(text: str) -> list[bytes]:
    """Lower-case words: digits, letters and all that isn't ASCII."""
    return text.encode().translate(_WORDS).split()


def _short(word: bytes) -> bytes:
    return word if len(word) <= _LONG else b"\0" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


class Phrases:
    """Phrases with the items that have them, as the symbols of an index: words from 1, 0 for all others."""

    def __init__(self, rows: list[tuple[bytes, str]]) -> None:
        texts = sorted({r[0] for r in rows})
        split = [t.split(b" ") for t in texts]
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for s in split for w in s}))}
        self.hashed = any(w[:1] == b"\0" for w in self.words)
        self.items = sorted({r[1] for r in rows})
        number, at = {x: i for i, x in enumerate(self.items)}, {t: i for i, t in enumerate(texts)}
        pairs = np.array(sorted({(at[t], number[x]) for t, x in rows}), np.int64).reshape(-1, 2)
        self.item_of, self.item_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
        #: Phrases by their length: numbers and symbols.
        self.by_length = []
        for n in sorted({len(s) for s in split}):
            ids = [i for i, s in enumerate(split) if len(s) == n]
            self.by_length.append((n, np.array(ids, np.int64), np.array([[self.words[w] for w in split[i]] for i in ids], np.int64)))
        self.shortest, self.longest = (self.by_length[0][0], self.by_length[-1][0]) if texts else (0, 0)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        if self.hashed:
            words = map(_short, words)
        return np.fromiter(map(self.words.get, words, repeat(0)), np.int64)

    def items_of(self, phrases: np.ndarray) -> np.ndarray:
        """Distinct items of distinct phrases."""
        low, n = self.item_at[phrases], self.item_at[phrases + 1] - self.item_at[phrases]
        return np.unique(self.item_of[_ranges(low, n)])


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... n of them, one range after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)


def occurrences(text: np.ndarray, phrases: Phrases, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and phrases of all occurrences in a text of symbols, found shard by shard."""
    edges = np.flatnonzero(np.concatenate([[True], text == 0, [True]]))  # a stretch lies between two edges
    size = np.diff(edges) - 1
    stretch = size >= max(1, phrases.shortest)
    places = _ranges(edges[:-1][stretch], size[stretch] + 1)  # each with the other word that ends it, if there is one
    places = places[places < len(text)]
    kept = text[places]
    found = []
    for at in range(0, len(kept), shard):
        index = Index(kept[at : at + shard + phrases.longest - 1], len(phrases.words) + 1)
        for n, ids, rows in phrases.by_length:
            low, high = index.search(rows)
            hit = np.flatnonzero(low < high)
            for k in range(0, len(hit), 4096):
                part = hit[k : k + 4096]
                starts = index.locate(_ranges(low[part], high[part] - low[part]))
                which = np.repeat(ids[part], high[part] - low[part])
                found.append((places[at + starts], np.full(len(starts), n), which))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def merged(starts: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the merged spans in a text of n words."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    inside = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def _spans(text: str, low: list[int], high: list[int]) -> list[dict]:
    """Spans in words and in characters; only texts with spans are looked at again."""
    wanted = {*low, *(h - 1 for h in high)}
    at = {i: m.span() for i, m in enumerate(_WORD.finditer(text)) if i in wanted}
    return [{"start": a, "end": b, "from": at[a][0], "to": at[b - 1][1]} for a, b in zip(low, high, strict=True)]


def _pairs(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """phrase (words joined by spaces), item: distinct."""

    def run(batches):
        for batch in runtime.slices(batches, "text"):
            phrases, names = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = list(map(_short, words_of(text or "")))
                for phrase in dict.fromkeys(b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1)) if words):
                    phrases.append(phrase), names.append(item or "")
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(names, pa.string())], ["phrase", "item"])

    rows = items.select(items[id_col].cast("string").alias("item"), items[text_col].alias("text"))
    return rows.mapInArrow(run, "phrase binary, item string").distinct()


def _search(docs: DataFrame, phrases: Phrases, shard: int) -> DataFrame:
    """docs: id and text. id, n_words, spans, items."""
    held = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        known = held.value
        for batch in runtime.slices(batches, "text", 4_000_000):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, parts, rows = np.zeros(len(texts), np.int64), [], []
            for which, pieces in runtime.parts(texts):
                for i, piece in zip(which, pieces, strict=True):
                    words = words_of(piece)
                    n[i] += len(words)
                    if rows and rows[-1] != i:
                        parts.append(np.zeros(1, np.int64))  # no phrase reaches into the next document
                    parts.append(known.symbols(words)), rows.append(i)
            ends = np.cumsum(n + 1) - 1
            begins = ends - n
            text = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            del parts
            starts, lengths, which = occurrences(text, known, shard)
            low, high = merged(starts, lengths, len(text))
            spans, items = [[] for _ in texts], [[] for _ in texts]
            of = np.searchsorted(ends, low)
            for i in np.unique(of).tolist():
                spans[i] = _spans(texts[i], (low[of == i] - begins[i]).tolist(), (high[of == i] - begins[i]).tolist())
            pairs = np.unique(np.stack([np.searchsorted(ends, starts), which]), axis=1) if len(starts) else np.zeros((2, 0), np.int64)
            for i in np.unique(pairs[0]).tolist():
                items[i] = [known.items[k] for k in known.items_of(pairs[1][pairs[0] == i])]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "from", "to")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, spans {SPANS}, items array<string>")


def _joined(spans):
    """Sorted spans, those that touch or overlap as one."""
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_joined_pair(F.element_at(done, -1), s))),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def _joined_pair(a, b):
    return F.struct(a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"), a["from"].alias("from"), F.greatest(a["to"], b["to"]).alias("to"))


def find(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20, shard: int = SHARD) -> DataFrame:
    """``id_col``, n_words, spans (start and end in words, from and to in characters, ends excluded) and items (ids as text, in
    order) for each document: what to remove, and whose phrases it has."""
    spark = docs.sparkSession
    runtime.ship(spark)
    pairs = runtime.materialize(_pairs(items, width, item_col, item_text), "phrases", items, runtime.NARROW)
    size = pairs.agg(F.sum(F.length("phrase") + F.length("item") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    read = lambda k: Phrases([tuple(r) for r in pairs.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)) == k).collect()])  # noqa: E731  a block has about block_bytes
    if blocks == 1:
        return _search(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), read(0), shard).withColumnRenamed("id", id_col)
    table, row = runtime.numbered(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    found = [_search(table.select(F.struct("id", row).alias("id"), "text"), read(k), shard) for k in range(blocks)]
    whole = reduce(DataFrame.unionByName, found).groupBy(F.col(f"id.{row}").alias("row"), F.col("id.id").alias(id_col)).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return whole.select(id_col, "n_words", _joined(F.col("spans")).alias("spans"), "items")


def cut(text, spans):
    """A text without its spans (columns); null stays null."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["to"]))
    starts = F.concat(F.transform(spans, lambda s: s["from"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(text.isNotNull(), F.array_join(kept, ""))
