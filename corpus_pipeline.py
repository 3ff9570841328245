"""Documents to training sequences: quality rules, language ID, exact dedup, near-duplicate join, packing.

Each stage works on all that the one before it kept and returns the columns of documents; the last returns packed pieces. The
first removes the lines that fail its rules, so later stages see cleaned texts.

Defined results: null and empty texts go in the first stage. Rows may repeat and ids may be null or repeat: of rows with one
text a single one stays, whatever their ids. Further columns of documents go along untouched, whatever their names. Texts may
be of any length that a worker can hold. Ties: see the operators. An empty table gives an empty table from every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, language_id, packing, quality_rules, runtime

#: A document goes if no language is at least as sure as this, or if its letters are so much less likely in the language than
#: usual (1: as usual). Prose in a learned language has about 0.5 even where most of its words are new, unrelated ones below 0.4.
LEAST_SURE, LEAST_FIT = 0.5, 0.42


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])), public_tokenizers.path("piece_bpe_32k.model"), docs["text"], docs["lang"], docs["doc_id"])
    names = [f"_{i}" for i in range(len(docs.columns))]  # none that a prediction has
    at = docs.columns.index("text")
    judged = language_id.predict(docs, model, extra={n: docs[c] for i, (n, c) in enumerate(zip(names, docs.columns, strict=True)) if i != at}, text_as=names[at])
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE) & (F.col("fit") >= LEAST_FIT)
    return judged.where(sure).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("best-fit packing", pack)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.read(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
