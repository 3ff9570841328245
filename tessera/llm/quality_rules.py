"""Line-first cleaning, in DataFrame functions only.

Every line that holds a word is judged by punctuation, navigation and boilerplate rules; lines that fail are removed; a
document that loses too much of its text is rejected, as are documents that fail base rules (too few words, or most words in
repeated 3-word windows).

Defined results: a null text has no words, all counts are 0 and it is rejected; so is an empty text. Lines without a word
are neither judged nor kept. Ids may be null or repeat: one row comes out for each row that goes in. Only the id and text
columns are read, so other columns can't clash. An empty table gives an empty table.

3-word windows are compared by 64-bit hashes inside one text (two different windows of a text of a million words collide with
a chance of about 3e-8). All work is inside a row and at most n log n in its words: no shuffle, no skew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line fails by punctuation if it has no sentence end, or so many symbols or shouts.
    max_symbol_percent: int = 10
    max_shout_percent: int = 30
    #: A line fails by navigation with so many separators, and at least so many in 100 words.
    min_separators: int = 2
    min_separator_percent: int = 20
    #: A document is rejected if it keeps less of its word characters.
    min_kept_percent: int = 50


SENTENCE_END = r"[.!?…][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
SEPARATORS = r"[|»•·›]"
BOILERPLATE = (
    r"(?i)all rights reserved|copyright (\(c\)|©|[0-9]{4})|under the (mit|apache|gnu|bsd|gpl)[^.]{0,40}licen[sc]e|licensed under (the|a|cc)"
    r"|privacy policy|cookie (policy|settings)|terms of (use|service)|(click|tap) here|subscribe to|sign up|log ?in to|enable javascript"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more."""
    size = F.size(words)
    windows = F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<bigint>"))

    def places(hashes: Column) -> Column:
        return let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(places(h))))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def judge_line(line: Column, rules: Rules) -> Column:
    """struct(chars, why): word characters of a line and the rule that removes it (null: it stays)."""

    def verdict(x: Column) -> Column:
        separators = _count(x["line"], SEPARATORS)
        why = (
            F.when((separators >= rules.min_separators) & (separators * 100 >= x["words"] * rules.min_separator_percent), "navigation")
            .when(
                ~x["line"].rlike(SENTENCE_END)
                | (_count(x["line"], SYMBOLS) * 100 > x["chars"] * rules.max_symbol_percent)
                | (_count(x["line"], r"[!?]{2,}") * 100 > x["words"] * rules.max_shout_percent),
                "punctuation",
            )
            .when(x["line"].rlike(BOILERPLATE), "boilerplate")
        )
        return F.struct(x["chars"].alias("chars"), why.alias("why"), x["line"].alias("line"))

    chars = F.length(F.regexp_replace(line, WORD_GAP, ""))
    words = F.size(F.array_remove(F.split(line, WORD_GAP), ""))
    return let(F.struct(line.alias("line"), chars.alias("chars"), words.alias("words")), verdict)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars and the number
    of lines that each rule removed; with_text adds clean_text, the lines that stay."""
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    words = F.array_remove(F.split("_text", WORD_GAP), "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(HAS_WORD))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x["chars"])
    gone = lambda xs, why: F.size(F.filter(xs, lambda x: x["why"] == why)).cast("bigint")
    first = let(
        words,
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
    )

    def by_line(xs: Column) -> Column:
        return F.struct(
            total(F.filter(xs, lambda x: x["why"].isNull())).alias("kept_chars"),
            *[gone(xs, w).alias(f"n_{w}") for w in ("navigation", "punctuation", "boilerplate")],
            *([F.array_join(F.transform(F.filter(xs, lambda x: x["why"].isNull()), lambda x: x["line"]), "\n").alias("clean_text")] if with_text else []),
        )

    second = let(
        lines,
        lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            let(F.transform(ls, lambda x: judge_line(x, rules)), by_line).alias("by"),
        ),
    )
    out = rows.select("_id", first.alias("a"), second.alias("b"), F.when(F.col("_text").rlike(SYMBOLS), _count(F.col("_text"), SYMBOLS)).otherwise(0).cast("bigint").alias("n_symbols"))
    failed = (F.col("a.n_words") < rules.min_words) | (F.col("a.n_repeat_words") * 100 > F.col("a.n_words") * rules.max_repeat_percent)
    return out.select(
        F.col("_id").alias(id_col),
        "a.n_words",
        "a.word_chars",
        "n_symbols",
        "b.n_dup_lines",
        "a.n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("b.by.kept_chars") * 100 >= F.col("a.word_chars") * rules.min_kept_percent)).alias("kept"),
        "b.by.kept_chars",
        "b.by.n_navigation",
        "b.by.n_punctuation",
        "b.by.n_boilerplate",
        *(["b.by.clean_text"] if with_text else []),
    )


def filter_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs whose text is kept, each with its failing lines removed; all other columns as they were, but for the
    number of characters, where docs has that column. A text without a failing line stays as it is, blank lines included.

    Judged in place: no join, no shuffle. The verdict goes through a generator, so Spark computes it once, not again to filter."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP), "")
    none = F.lit(None).cast("bigint")
    base = let(
        words,
        lambda w: F.when(F.size(w) < rules.min_words, none).otherwise(F.when(repeated_words(w) * 100 > F.size(w) * rules.max_repeat_percent, none).otherwise(F.length(F.array_join(w, "")).cast("bigint"))),
    )
    blank = lambda x: F.struct(F.lit(0).alias("chars"), F.lit(None).cast("string").alias("why"), x.alias("line"))
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(HAS_WORD), judge_line(x, rules)).otherwise(blank(x)))

    def cleaned(xs: Column, chars: Column) -> Column:
        stay = F.filter(xs, lambda x: x["why"].isNull())
        left = F.aggregate(stay, F.lit(0).cast("bigint"), lambda a, x: a + x["chars"])
        joined = F.when(F.exists(xs, lambda x: x["why"].isNotNull()), F.array_join(F.transform(stay, lambda x: x["line"]), "\n")).otherwise(text)
        return F.struct((left * 100 >= chars * rules.min_kept_percent).alias("kept"), joined.alias("text"))

    verdict = let(base, lambda chars: F.when(chars.isNotNull(), let(lines, lambda xs: cleaned(xs, chars))))
    name = "_clean"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    rows = docs.select("*", F.explode(F.filter(F.array(verdict), lambda v: v["kept"])).alias(name))
    new = {text_col: F.col(name)["text"], chars_col: F.length(F.col(name)["text"])}
    return rows.select(*[new[c].cast(dict(docs.dtypes)[c]).alias(c) if c in new else rows[c] for c in docs.columns])
