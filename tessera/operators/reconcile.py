"""Comparing two tables: multiset differences, totals from two sources, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.compare import percent_change


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks and the reverse, as often as they differ: side, columns..., times.

    One aggregation of both sides instead of two EXCEPT ALL: the counts of equal rows cancel."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_k")).unionByName(b.select(*cols, F.lit(-1).alias("_k")))
    diff = both.groupBy(*cols).agg(F.sum("_k").alias("_times")).where("_times <> 0")
    return diff.select(F.when(F.col("_times") > 0, "left").otherwise("right").alias("side"), *cols, F.abs("_times").alias("times"))


#: Bits of a row's hash that each level of the digest tree looks at, levels at most, and how many rows are compared one by one
#: before another level is worth its look.
BITS, LEVELS, ROWS = 12, 3, 1_000_000


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with two hashes of its rows; which columns are null is part of them."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return df.select(*columns, F.xxhash64(*parts).alias("_h"), F.xxhash64(F.lit(1), *parts).alias("_g"))


def _digest(df: DataFrame, part: Column) -> DataFrame:
    """part, _n and four sums over halves of hashes: the same for the same rows, in whatever order. Sums of halves don't overflow."""
    halves = {"_a": F.col("_h").bitwiseAND(0xFFFFFFFF), "_b": F.shiftrightunsigned("_h", 32), "_c": F.col("_g").bitwiseAND(0xFFFFFFFF), "_d": F.shiftrightunsigned("_g", 32)}
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("_n"), *[F.sum(v).alias(k) for k, v in halves.items()])


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """``multiset_diff`` by a tree of digests: rows are summed up by ranges of their hash, and only those of ranges that differ are
    compared. Where the tables agree no row is shuffled, only the sums of ranges (4,096 a level). Both tables are read once a
    level and once for the rows. Two different tables have equal digests with a chance of about 1e-38 a range."""
    columns = a.columns
    left, right = _hashed(a, columns), _hashed(b.select(*columns), columns)
    for level in range(LEVELS):
        part = F.shiftrightunsigned(F.shiftleft("_h", BITS * level), 64 - BITS)
        sums = ["_n", "_a", "_b", "_c", "_d"]
        one, two = _digest(left, part), _digest(right, part).withColumnsRenamed({c: f"{c}2" for c in sums})
        same = F.lit(True)
        for c in sums:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
        found = one.join(two, "part", "full").where(~same).select("part", F.greatest("_n", "_n2").alias("n")).collect()  # 4,096 at most
        parts = [r["part"] for r in found]
        left, right = left.where(part.isin(*parts)), right.where(part.isin(*parts))
        if sum(r["n"] for r in found) <= ROWS or len(parts) > (1 << BITS) // 2:
            break
    return multiset_diff(left.select(*columns), right.select(*columns))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return differing_rows(a, b).limit(1).count() == 0


def compare_totals(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ours, theirs and pct_diff of two tables with n; a side that lacks a key counts as null."""
    a, b = ours.select(*keys, F.col("n").alias("ours")), theirs.select(*keys, F.col("n").alias("theirs"))
    return a.join(b, keys, "full").withColumn("pct_diff", percent_change(F.col("ours"), F.col("theirs")))


def score(compared: DataFrame, least: int = 100, steps: tuple[int, ...] = (1, 2, 5), but: Column | None = None) -> DataFrame:
    """How many totals of some size there are, and the share within so many percent; but: rows known to be wrong."""
    big = compared.where(F.col("theirs") >= least)
    big = big if but is None else big.where(~but)
    share = lambda s: F.round(100.0 * F.avg((F.abs("pct_diff") <= s).cast("int")), 2)
    return big.agg(F.count("*").alias("cells"), *[share(s).alias(f"within_{s}") for s in steps], F.max(F.abs("pct_diff")).alias("worst"))


def worst(compared: DataFrame, keys: list[str], least: int = 100, top: int = 15, but: Column | None = None) -> DataFrame:
    """The largest differences among totals of some size, apart from rows that are known to be wrong (but)."""
    big = compared.where(F.col("theirs") >= least).where(F.col("pct_diff").isNotNull())
    big = big if but is None else big.where(~but)
    return big.orderBy(F.desc(F.abs("pct_diff")), *keys).limit(top)


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """How often two fields agree, differ, or one is unknown."""
    return df.agg(
        F.count(F.when(a == b, 1)).alias("same"), F.count(F.when(a != b, 1)).alias("different"), F.count(F.when(a.isNull() | b.isNull(), 1)).alias("unknown"),
        F.round(F.try_divide(100.0 * F.count(F.when(a == b, 1)), F.nullif(F.count(F.when((a == b) | (a != b), 1)), F.lit(0))), 2).alias("pct_same"),
    )


def by_prefix(label: Column, prefixes: dict[str, int]) -> Column:
    """The code of the longest prefix that a label starts with (upper case, single spaces); null if none."""
    text = F.upper(F.regexp_replace(F.trim(label), r"\s+", " "))
    out = None
    for p in sorted(prefixes, key=lambda p: (-len(p), p)):
        out = F.when(text.startswith(p), prefixes[p]) if out is None else out.when(text.startswith(p), prefixes[p])
    return out


def by_prefixes(df: DataFrame, label: str, prefixes: DataFrame) -> DataFrame:
    """df with code, that of the longest of the prefixes (prefix, code; a table of any size) that the label starts with (as
    ``by_prefix`` reads it); null if none. The smallest code where a prefix has several.

    Distinct labels meet the prefixes by equality, once for each length that prefixes have."""
    known = prefixes.where("prefix IS NOT NULL AND prefix <> ''").groupBy(F.col("prefix").alias("_p")).agg(F.min("code").alias("_code"))
    sizes = sorted(r[0] for r in known.select(F.length("_p")).distinct().collect())  # lengths of labels
    labels = df.select(F.col(label).alias("_label")).where("_label IS NOT NULL").distinct()
    text = F.upper(F.regexp_replace(F.trim("_label"), r"\s+", " "))
    starts = labels.withColumn("_t", text).withColumn("_k", F.explode(F.array(*[F.lit(k) for k in sizes]).cast("array<int>"))).where(F.length("_t") >= F.col("_k"))
    found = starts.withColumn("_p", F.substring("_t", F.lit(1), F.col("_k"))).join(known, "_p").groupBy("_label").agg(F.max_by("_code", "_k").alias("code"))
    return df.join(found, df[label] == found["_label"], "left").select(*[df[c] for c in df.columns], "code")


def code_of(label: str, prefixes: dict[str, int], total: str = "TOTAL") -> int | str | None:
    """``by_prefix`` for one label of a sheet: 'total' for totals, else the code of the longest prefix that it starts with."""
    text = " ".join(label.upper().split())
    if text.startswith(total):
        return "total"
    return next((prefixes[p] for p in sorted(prefixes, key=len, reverse=True) if text.startswith(p)), None)


def _number(cell) -> float | None:
    try:
        return float(cell)
    except (TypeError, ValueError):
        return None


def sheet_totals(rows: list[list], corner: str, prefixes: dict[str, int], years: range, unit: bool = False) -> list[tuple]:
    """(unit, code, year, n) of a published sheet whose header row starts with ``corner`` and has years above its columns.

    unit: the first column names a unit (carried forward over blank cells; rows end at the statistical notes) and the second
    the label; else the first is the label, and the unit is null. Cells that are no number are left out."""
    head = next(i for i, r in enumerate(rows) if r and str(r[0]).strip().upper() == corner)
    columns = {int(y): k for k, cell in enumerate(rows[head]) if (y := _number(cell)) is not None and int(y) in years}
    body = carry_forward([tuple(r) for r in rows[head + 1 :] if r]) if unit else [(None, *r) for r in rows[head + 1 :] if r]
    shift, out = 0 if unit else 1, []
    for row in body:
        code = code_of(str(row[1] or ""), prefixes) if len(row) > 1 else None
        if code is None:
            continue
        name = row[0]
        if unit:
            name = str(int(n)) if (n := _number(name)) is not None else name.upper()
        for y, k in columns.items():
            if k + shift < len(row) and (n := _number(row[k + shift])) is not None:
                out.append((name, str(code), y, n))
    return out


def carry_forward(rows: list[tuple], stop: str = "STATISTICAL") -> list[tuple]:
    """Rows of a ragged sheet with blank first cells filled from above, up to a row that starts with ``stop``."""
    out, last = [], None
    for first, *rest in rows:
        cell = str(first or "").strip()
        if cell.upper().startswith(stop):
            break
        last = cell or last
        if last is not None:
            out.append((last, *rest))
    return out
