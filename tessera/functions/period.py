"""Periods as sets of month indices (months since the first January), and the periods they are compared with."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    """The years that data cover, and the year that later periods are compared with."""

    first_year: int = 2016
    last_year: int = 2025
    base_year: int = 2019

    @property
    def months(self) -> int:
        return (self.last_year - self.first_year + 1) * 12

    def index(self, year: int, month0: int) -> int:
        return (year - self.first_year) * 12 + month0

    def year(self, m: int) -> int:
        return self.first_year + m // 12


SPAN = Span()


@dataclass(frozen=True)
class Period:
    mode: str = "year"  # year, month, crossyear, year_range, month_range, all
    first: int = 2025
    last: int = 2025


def months_of(p: Period, span: Span = SPAN) -> list[int]:
    """first and last are years for year and year_range, month indices for month and month_range, a calendar month (from 0) for crossyear."""
    a, b = min(p.first, p.last), max(p.first, p.last)
    if p.mode == "year":
        return [span.index(p.first, k) for k in range(12)]
    if p.mode == "month":
        return [p.first]
    if p.mode == "crossyear":
        return [span.index(y, p.first) for y in range(span.first_year, span.last_year + 1)]
    if p.mode == "year_range":
        return list(range(span.index(a, 0), span.index(b, 11) + 1))
    if p.mode == "month_range":
        return list(range(a, b + 1))
    return list(range(span.months))


def comparison_of(p: Period, span: Span = SPAN) -> list[int] | None:
    """The same period a year before, or the range just before a range; None if data don't reach back or for crossyear."""
    if p.mode == "crossyear":
        return None
    months = months_of(p, span)
    shift = 12 if p.mode in ("year", "month") else len(months)
    before = [m - shift for m in months]
    return before if before[0] >= 0 else None


def baseline_of(p: Period, span: Span = SPAN) -> tuple[list[int], float] | None:
    """Months of the base year and the factor that makes the period's total comparable; else the comparison."""
    months = months_of(p, span)
    if p.mode != "crossyear" and months[0] >= span.index(span.base_year + 1, 0):
        if len(months) > 12:
            return [span.index(span.base_year, k) for k in range(12)], 12 / len(months)
        back = (span.year(months[0]) - span.base_year) * 12
        return [m - back for m in months], 1.0
    before = comparison_of(p, span)
    return (before, 1.0) if before else None


def days_of(months: list[int], span: Span = SPAN) -> int:
    return sum(calendar.monthrange(span.year(m), m % 12 + 1)[1] for m in months)


def normalized(p: Period, a: int, b: int, span: Span = SPAN) -> Period:
    """The simplest period for the months a to b."""
    lo, hi = max(0, min(a, b)), min(span.months - 1, max(a, b))
    if lo % 12 == 0 and hi % 12 == 11:
        return replace(p, mode="year" if span.year(lo) == span.year(hi) else "year_range", first=span.year(lo), last=span.year(hi))
    return replace(p, mode="month" if lo == hi else "month_range", first=lo, last=hi)


def in_months(m: Column, months: list[int]) -> Column:
    """A range where months follow each other (it reaches the scan), a list elsewhere, false for none."""
    if not months:
        return F.lit(False)
    if months[-1] - months[0] == len(months) - 1:
        return m.between(months[0], months[-1])
    return m.isin(*months)


def in_dates(date: Column, first: str, after: str) -> Column:
    """first <= date < after, on the column itself, so that it reaches the scan."""
    return (date >= F.lit(first).cast("date")) & (date < F.lit(after).cast("date"))


def dates_of(months: list[int], span: Span = SPAN) -> tuple[str, str]:
    """The first day of months that follow each other, and the day after them."""
    if not months or months[-1] - months[0] != len(months) - 1:
        raise ValueError("only months that follow each other are a range of days")
    a, b = months[0], months[-1] + 1
    return f"{span.year(a)}-{a % 12 + 1:02d}-01", f"{span.year(b)}-{b % 12 + 1:02d}-01"


def in_types(cat: Column, types: list[int]) -> Column:
    return cat.isin(*types) if types else F.lit(False)


def fair_column(types: list[int], all_types: list[int], months: list[int], span: Span = SPAN) -> tuple[str, str] | None:
    """Which stored vector a fair comparison uses: all types or one, a whole year or (ranges of years) the yearly mean."""
    kind = "all" if set(types) == set(all_types) else str(types[0]) if len(types) == 1 else None
    whole = months and months[0] % 12 == 0 and months[-1] % 12 == 11 and months[-1] - months[0] == len(months) - 1
    if kind is None or not whole:
        return None
    return kind, str(span.year(months[0])) if len(months) == 12 else "avg"


def resolve_group(types: list[int], groups: dict[str, list[int]]) -> str | None:
    """'all', 'type:<n>' or 'group:<name>' if the types are exactly that."""
    chosen, every = set(types), {t for g in groups.values() for t in g}
    if chosen == every:
        return "all"
    if len(chosen) == 1:
        return f"type:{types[0]}"
    return next((f"group:{g}" for g, ts in groups.items() if set(ts) == chosen), None)


def resolved(types: Column, groups: dict[str, list[int]]) -> Column:
    """``resolve_group`` for a column of arrays."""
    chosen = F.array_sort(F.array_distinct(types))
    same = lambda ts: chosen == F.array(*[F.lit(t) for t in sorted(set(ts))])
    out = F.when(same([t for g in groups.values() for t in g]), "all").when(F.size(chosen) == 1, F.concat(F.lit("type:"), chosen[0].cast("string")))
    for name, ts in groups.items():
        out = out.when(same(ts), f"group:{name}")
    return out
