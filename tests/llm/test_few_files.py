"""How many files the Jaccard join writes: for each, an executor's JVM starts a process or more, which has its memory for a moment."""

from __future__ import annotations

import random
from pathlib import Path

from tessera.llm import jaccard_join, runtime


def test_a_small_join_writes_few_files(spark, monkeypatch, tmp_path):
    written, real = {}, runtime.materialize

    def counted(df, name, *more):
        table = real(df, name, *more)
        written.setdefault(name, []).append(len(list(Path(table._tessera_path.removeprefix("file:")).glob("part-*"))))
        return table

    monkeypatch.setattr(runtime, "materialize", counted)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(200)) for _ in range(60)]
    rows = [(i, texts[i % 60] if i < 90 else f"{texts[i % 60]} end") for i in range(120)]
    spark.createDataFrame(rows, "doc_id int, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(docs, least_heavy=1).collect()}
    assert got == {i: i % 60 for i in range(120)}
    most = runtime.NARROW * spark.sparkContext.defaultParallelism
    assert {"heavy", "shared", "whole"} <= set(written) and max(map(max, written.values())) <= most, written
