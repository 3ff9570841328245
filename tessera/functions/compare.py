"""Rates, quotients, percentile ranks, medians, class breaks and guarded changes."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of friendly numbers, and the shares at which hexagon classes part.
STEPS = (1, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10)
HEX_SHARES = (0.2, 0.4, 0.6, 0.8, 0.95)


def rate_per_1000(n: Column, residents: Column, days: int, least: int = 2000) -> Column:
    """Yearly rate for 1,000 residents; null where too few live."""
    return F.when(residents >= least, n / residents * 1000.0 / (days / 365.25))


def quotient(n: Column, base: Column, city_n: Column, city_base: Column) -> Column:
    """How a place's ratio compares with the city's; null where undefined."""
    return F.try_divide(F.try_divide(n.cast("double"), base), F.try_divide(city_n.cast("double"), city_base))


def percent_change(now: Column, before: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(100.0 * (now - before), before), digits)


def guarded_change(now: Column, before: Column, scale: float = 1.0, least: int = 20, most: float = 300.0) -> Column:
    """struct(kind, pct): 'counts' where either side is small (pct null), else 'same', 'change' or 'large'."""
    pct = F.try_divide(100.0 * (now * scale - before), before)
    kind = F.when((now < least) | (before < least), "counts").when(F.abs(pct) < 1, "same").when(pct > most, "large").otherwise("change")
    shown = F.when(F.abs(pct) >= 10, F.round(pct, 0)).otherwise(F.round(pct, 1))
    return F.struct(kind.alias("kind"), F.when(kind != "counts", shown).alias("pct"))


def percentile_vector(x: Column, digits: int = 3) -> Column:
    """The 101 percentiles 0, 1, ..., 100 with linear interpolation."""
    return F.transform(F.percentile(x, F.array(*[F.lit(k / 100) for k in range(101)])), lambda v: F.round(v, digits))


def percentile_in_vector(value: Column, vector: Column) -> Column:
    """The largest k with vector[k] < value, 0 at least and 99 at most."""
    below = F.size(F.filter(vector, lambda v: v < value))
    return F.least(F.lit(99), F.greatest(F.lit(0), below - 1))


def round_friendly(x: float) -> float:
    """The friendly number closest to x on a log scale."""
    if not x > 0:
        return 1
    unit = 10.0 ** math.floor(math.log10(x))
    return float(f"{min((s * unit for s in STEPS), key=lambda v: abs(math.log(v / x))):.3g}")


def next_friendly(x: float) -> float:
    unit = 10.0 ** math.floor(math.log10(x))
    values = [float(f"{s * unit:.3g}") for s in STEPS]
    return next((v for v in values if v > x), x * 1.5)


def friendly_breaks(raw: list[float]) -> list[float]:
    """Breaks rounded to friendly numbers, each above the one before."""
    out: list[float] = []
    for b in raw:
        v = round_friendly(b)
        out.append(next_friendly(out[-1]) if out and v <= out[-1] else v)
    return out


def classify(value: Column, breaks: list[float]) -> Column:
    """How many breaks lie below a value."""
    out = F.lit(0)
    for b in breaks:
        out = out + (value > b).cast("int")
    return out


def class_of(value: float, breaks: list[float]) -> int:
    return bisect_left(breaks, value)


def class_labels(breaks: list[float], whole: bool = True) -> list[str]:
    """'1-8', '9-15', ..., '151+' for counts; for rates the ranges meet."""
    show = lambda v: str(int(v)) if v == int(v) else f"{v:g}"
    if not breaks:
        return []
    lows = [1 if whole else 0, *[b + 1 if whole else b for b in breaks]]
    labels = [show(a) if whole and a == b else f"{show(a)}-{show(b)}" for a, b in zip(lows, breaks, strict=False)]
    return [*labels, f"{show(lows[-1])}+"]


def short_number(n: Column) -> Column:
    """1,234 -> 1.2K, 2,500,000 -> 2.5M."""
    one = lambda v: F.regexp_replace(F.format_string("%.1f", v), r"\.0$", "")
    return F.when(n >= 999_950, F.concat(one(n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(one(n / 1e3), F.lit("K"))).otherwise(n.cast("string"))


def grouped_number(n: Column) -> Column:
    """1234567 -> 1,234,567, rounded to whole numbers."""
    return F.format_number(F.round(n.cast("double"), 0), 0)


def signed_change(pct: Column) -> Column:
    """+12.3%, −4.0%, 0.0%; empty where there is no percentage."""
    sign = F.when(pct > 0, "+").when(pct < 0, "−").otherwise("")
    return F.when(pct.isNull() | F.isnan(pct) | (F.abs(pct) == float("inf")), "").otherwise(F.concat(sign, F.format_string("%.1f", F.abs(pct)), F.lit("%")))


def sentence_case(label: Column) -> Column:
    """An official label in capitals as people write it: 'RESIDENCE - APT. HOUSE' -> 'Residence, apt. house'."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(label), r"\s*-\s*", ", "), "/", " / "), r"\bnyc\b", "NYC")
    return F.when(F.coalesce(label, F.lit("")) == "", "Not recorded").otherwise(F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, F.lit(2), F.length(t))))
