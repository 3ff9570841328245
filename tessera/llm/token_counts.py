"""Token counts by rank-synchronous merging of ragged arrays.

Nulls count as empty texts (0 bytes, 0 tokens). Ids may be null or repeat: one row comes out for each row that goes in, and
only the id and text columns are read, so other columns can't clash. Very long texts are counted whole, piece by piece. An empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, runtime

SCHEMA = "id long, n_bytes long, n_tokens long, over_limit boolean"
runtime.dropped_with(bpe.from_json.cache_clear)


def _counter(path: str, pattern: str) -> bpe.Counter:
    return runtime.worker_cache(("counter", path, pattern), lambda: bpe.Counter(bpe.from_json(path, pattern)))


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    path: a byte-level BPE description in JSON, readable on the executors; its special strings count as one token each.
    """
    runtime.ship(docs.sparkSession)

    def run(batches):
        count = _counter(path, pattern)
        for batch in runtime.slices(batches, "text"):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            for rows, held in runtime.parts(texts):
                np.add.at(n, rows, count(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, SCHEMA.replace("id long", f"id {kind}", 1)).withColumnRenamed("id", id_col)
