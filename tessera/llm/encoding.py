"""Byte-level BPE encoding and decoding with length-bucketed padded matrices.

Nulls are encoded as empty texts: no ids. Ids may be null or repeat: one row comes out for each row that goes in, and only
the id and text columns are read, so other columns can't clash. Very long texts are encoded whole, piece by piece. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, runtime

runtime.dropped_with(bpe.from_json.cache_clear)
runtime.dropped_with(bpe.from_ranks.cache_clear)


def encoder(path: str, pattern: str) -> bpe.Encoder:
    """The encoder of this Python worker for a rank file (.tiktoken) or a description (.json)."""
    return runtime.worker_cache(("encoder", path, pattern), lambda: bpe.Encoder((bpe.from_json if path.endswith(".json") else bpe.from_ranks)(path, pattern)))


def encode_texts(own: bpe.Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, concatenated, and how many each has; pre-tokens of long texts are held piece by piece."""
    total, found = np.zeros(len(texts), np.int64), []
    for rows, held in runtime.parts(texts):
        ids, counts = own(held)
        np.add.at(total, rows, counts)
        found.append(ids)
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), total


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids (array<int>) of every whole text."""
    runtime.ship(docs.sparkSession)

    def run(batches):
        own = encoder(path, pattern)
        for batch in runtime.slices(batches, "text"):
            ids, counts = encode_texts(own, [x or "" for x in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and data (binary): the bytes that ids stand for. Null ids give no bytes."""
    runtime.ship(encoded.sparkSession)

    def run(batches):
        vocab = encoder(path, pattern).vocab
        for batch in batches:
            data = [vocab.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["id", "data"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: ``id_col``, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    The ids never leave the worker, so nothing but the digests is written.
    """
    runtime.ship(docs.sparkSession)

    def run(batches):
        own = encoder(path, pattern)
        for batch in runtime.slices(batches, "text"):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            total = np.zeros(len(texts), np.int64)
            digests = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
            for rows, held in runtime.parts(texts):
                ids, counts = own(held)
                np.add.at(total, rows, counts)
                raw, data = memoryview(ids.astype("<u4").tobytes()), memoryview(own.vocab.decode(ids))
                ends, byte_ends = np.cumsum(counts).tolist(), np.cumsum(bpe.segment_sums(own.vocab.lengths[ids], counts)).tolist()
                a = b = 0
                for row, end, byte_end in zip(rows, ends, byte_ends, strict=True):
                    digests[row][0].update(raw[4 * a : 4 * end])
                    digests[row][1].update(data[b:byte_end])
                    a, b = end, byte_end
            hexes = [pa.array([d[k].hexdigest() for d in digests]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), *hexes], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
