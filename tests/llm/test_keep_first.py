"""Dedup stages keep one row of each group where ids are null or repeat."""

from __future__ import annotations

from collections import Counter

import pytest

from tessera.llm import exact_dedup, jaccard_join

ROWS = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (2, "g h i j k l"), (2, "g h i j k l"), (3, "m n o p q r"), (3, "s t u v w x")]


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, jaccard_join.keep_first])
def test_one_row_stays_of_each_text(spark, keep):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ROWS)], "doc_id int, text string, _row int")
    got = keep(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert Counter(r.text for r in out) == Counter({t for _, t in ROWS})
    assert {r.text[0]: r.doc_id for r in out} == {"a": 1, "g": 2, "m": 3, "s": 3}
    assert all(ROWS[r["_row"]] == (r.doc_id, r.text) for r in out)
