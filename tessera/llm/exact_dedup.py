"""Exact dedup, in DataFrame functions only.

Rows are grouped by the 128-bit hash of their normalised text together with the text itself, so the bytes are compared inside
each hash's group and different texts with one hash stay apart. Partial aggregation before the shuffle leaves one row for
each text and map task, however many copies a text has. The verdicts go back to the rows by the 128-bit hash and the SHA-256
digest (384 bits); Spark splits the large partitions of that join, and no group is ever gathered in a task.

Defined results: a null text counts as empty; so all nulls, empty texts and texts of white space alone are one group. Of equal
texts the row with the most code points in its original text stays, then the smallest id (null ids come last), and rows that
tie in both are one id, of which each row reports kept. Texts may be as long as a row can be: they go through the shuffle whole. One row comes out for each row that goes in. Only the id and text
columns are read, so other columns can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, keep_id, group_size, kept and text_sha256 for every row."""
    rows = docs.select(docs[id_col].alias("_id"), F.length(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("_n"), normalised(docs[text_col]).alias("_text"))
    hashed = rows.select("_id", "_n", "_text", F.unhex(F.md5(F.col("_text").cast("binary"))).alias("_h"))
    groups = (
        hashed.groupBy("_h", "_text")
        .agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))).alias("_keep"))
        .select(F.col("_h"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"), "group_size", F.col("_keep.id").alias("keep_id"))
    )
    narrow = hashed.select("_id", F.col("_h").alias("_h2"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha2"))
    joined = narrow.join(groups, (F.col("_h2") == F.col("_h")) & (F.col("_sha2") == F.col("_sha")))
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they were: one for each text. Of rows that tie in length and id any one stays.

    Whole rows go through the aggregation, so texts are hashed and shuffled once and nothing is joined."""
    size, id_ = F.length(F.coalesce(docs[text_col].cast("string"), F.lit(""))), docs[id_col]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.struct((-size).alias("n"), id_.isNull().alias("none"), id_.alias("id")).alias("_order"), normalised(docs[text_col]).alias("_text"))
    hashed = rows.withColumn("_h", F.unhex(F.md5(F.col("_text").cast("binary"))))
    kept = hashed.groupBy("_h", "_text").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
    return runtime.compact(kept, docs)
