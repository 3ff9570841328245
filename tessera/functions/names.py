"""Street names and house numbers as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import let

# Spellings that keys and display names share.
ORDINAL_WORDS = {
    "FIRST": "1", "SECOND": "2", "THIRD": "3", "FOURTH": "4", "FIFTH": "5", "SIXTH": "6",
    "SEVENTH": "7", "EIGHTH": "8", "NINTH": "9", "TENTH": "10", "ELEVENTH": "11", "TWELFTH": "12",
}
ABBREVIATIONS = {
    "AVE": "AVENUE", "AV": "AVENUE", "AVENU": "AVENUE", "BLVD": "BOULEVARD", "BL": "BOULEVARD", "PL": "PLACE",
    "PKWY": "PARKWAY", "PKY": "PARKWAY", "EXPY": "EXPRESSWAY", "EXPWY": "EXPRESSWAY", "EXWY": "EXPRESSWAY", "HWY": "HIGHWAY",
    "TPKE": "TURNPIKE", "TPK": "TURNPIKE", "RD": "ROAD", "LN": "LANE", "CT": "COURT", "TER": "TERRACE", "TERR": "TERRACE",
    "SQ": "SQUARE", "CIR": "CIRCLE", "HTS": "HEIGHTS", "MT": "MOUNT", "FT": "FORT", "JR": "JUNIOR", "BRG": "BRIDGE",
    "PLZ": "PLAZA", "CRES": "CRESCENT", "STS": "STREETS", "WY": "WAY", "CONC": "CONCOURSE", "TUNL": "TUNNEL", "TNNL": "TUNNEL",
    "ALY": "ALLEY", "DRV": "DRIVE", "GDNS": "GARDENS", "BRDG": "BRIDGE", "BDWK": "BOARDWALK", "BCH": "BEACH",
}
DIRECTIONS = {"E": "EAST", "W": "WEST", "N": "NORTH", "S": "SOUTH"}
FILLER = ("OF", "THE")
SMALL = ("OF", "THE", "AND", "DE", "LA")
ACRONYMS = ("FDR", "LGA", "JFK", "BQE", "US", "NY", "NYC", "MLK", "CUNY", "LIE", "PS", "IS", "JHS", "HS", "LIRR", "NYCHA")
HYPHEN_BASE = 1_000_000


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, and those ASCII letters."""
    source, target = [], []
    for c in map(chr, range(0x80, 0x10000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1 and base.isascii():
            source.append(c), target.append(base)
    return "".join(source), "".join(target)


def _lookup(word: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(pairs, word)


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}", "")


def _position_rules(w: Column, i: Column, n: Column, names: dict[str, str]) -> Column:
    """Words whose expansion depends on their place among n: saints, doctors, directions. Null for other words."""
    first, last = i == 0, i == n - 1
    turn = _lookup(w, DIRECTIONS)
    return (
        F.when(w == "ST", F.when(last & ~first, names["street"]).otherwise(names["saint"]))
        .when(w == "DR", F.when(first & ~last, names["doctor"]).otherwise(names["drive"]))
        .when(turn.isNotNull() & ((first & ~last) | (last & (i >= 2))), turn)
    )


def street_key(text: Column) -> Column:
    """One key for all spellings of a street: '5th Ave' and 'FIFTH AVENUE' give '5 AVENUE'. Null stays null."""
    plain = F.upper(F.regexp_replace(strip_accents(text), r"\([^)]*\)", " "))
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, "['’]", ""), "[^A-Z0-9]+", " "))
    names = {"street": "STREET", "saint": "SAINT", "doctor": "DOCTOR", "drive": "DRIVE"}
    ruled = [*ORDINAL_WORDS, *DIRECTIONS, *ABBREVIATIONS, "ST", "DR"]

    def expanded(words: Column) -> Column:
        n = F.size(words)

        def one(w: Column, i: Column) -> Column:
            """Long texts are mostly words that no rule names: one look into a hash set; digits sort before letters."""
            numbered = F.when(w < "A", F.nullif(F.regexp_extract(w, r"^(\d+)(ST|ND|RD|TH)$", 1), F.lit("")))
            by_rule = F.coalesce(_lookup(w, ORDINAL_WORDS), _position_rules(w, i, n, names), _lookup(w, ABBREVIATIONS), w)
            return F.when(w.isin(*ruled), by_rule).otherwise(F.coalesce(numbered, w))

        return F.array_join(F.filter(F.transform(words, one), lambda w: ~w.isin(*FILLER)), " ")

    return let(F.split(plain, " "), expanded)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 11th, ... of a number, or of its digits in a text, however many."""
    digits = F.regexp_replace(n.cast("string"), r"^0+(?=\d)", "")
    teen = digits.rlike(r"1\d$")
    return F.concat(digits, F.when(teen, "th").when(digits.endswith("1"), "st").when(digits.endswith("2"), "nd").when(digits.endswith("3"), "rd").otherwise("th"))


def display_name(raw: Column) -> Column:
    """An official name as people write it: 'W  42 ST' -> 'West 42nd Street'."""
    names = {"street": "Street", "saint": "St", "doctor": "Dr", "drive": "Drive"}

    def title(w: Column) -> Column:
        """Every run of letters, of any script, starts with a capital."""
        runs = F.regexp_extract_all(F.lower(w), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
        return F.regexp_replace(F.array_join(F.transform(runs, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), ""), "'S", "'s")

    def expanded(words: Column) -> Column:
        n = F.size(words)

        def one(w: Column, i: Column) -> Column:
            full = F.coalesce(_lookup(w, ABBREVIATIONS), w)
            special = F.when(w.isin(*ACRONYMS), w).when(w == "JR", "Jr")
            usual = (
                F.when(full.rlike(r"^\d+$"), ordinal(full))
                .when(full.isin(*SMALL) & (i > 0), F.lower(full))
                .when((F.length(full) <= 1) | full.rlike(r"^[A-Z]?\d+[A-Z]?$"), full)
                .when(full.startswith("MC") & (F.length(full) > 2), F.concat(F.lit("Mc"), title(F.substring(full, F.lit(3), F.length(full)))))
                .otherwise(title(full))
            )
            placed = _position_rules(w, i, n, names)
            return F.coalesce(F.when(_lookup(w, DIRECTIONS).isNotNull(), F.initcap(placed)).otherwise(placed), special, usual)

        return F.array_join(F.transform(words, one), " ")

    return let(F.split(F.trim(F.regexp_replace(raw, r"\s+", " ")), " "), expanded)


def house_number(text: Column) -> Column:
    """'1234' -> 1234, '37-012' -> 1037012, no number or zero -> -1. Numbers are bigint; what that can't hold is no number."""
    s = F.trim(text)
    part = lambda k: F.regexp_extract(s, r"^(\d+)-(\d+)$", k).try_cast("bigint")
    plain = F.nullif(F.regexp_extract(s, r"^(\d+)\D*$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    joined = F.try_add(F.try_add(F.try_multiply(part(1), F.lit(1000)), part(2)), F.lit(HYPHEN_BASE))
    return F.coalesce(joined, plain, F.lit(-1).cast("bigint"))


def block_of(number: Column) -> Column:
    """The hundred of a house number (the thousand of a hyphenated one), -1 for none."""
    return F.when(number < 0, -1).when(number >= HYPHEN_BASE, number - number % 1000).otherwise(number - number % 100)


def number_on_segment(t: Column, lf: Column, lt: Column, rf: Column, rt: Column) -> Column:
    """House number at fraction t of a segment: the mean of both sides' interpolations, half to even; -1 for none."""

    def side(lo: Column, hi: Column) -> Column:
        return F.when((lo > 0) & (hi > 0) & ((lo >= HYPHEN_BASE) == (hi >= HYPHEN_BASE)), lo + t * (hi - lo))

    left, right = side(lf, lt), side(rf, rt)
    mean = F.when(left.isNotNull() & right.isNotNull(), (left + right) / 2).otherwise(F.coalesce(left, right))
    return F.coalesce(F.rint(mean).cast("int"), F.lit(-1))


def match_words(typed: Column, words: Column) -> Column:
    """struct(exact, extra, len) if every typed word starts a word of its own, else null.

    Words are taken from the left: an equal word anywhere ahead of a longer one that starts so. Typed numbers must match
    whole, except the word still being typed, the last."""
    n = F.size(typed)
    zero = F.struct(F.lit(0).alias("exact"), F.array().cast("array<int>").alias("used"), F.lit(True).alias("ok"))
    places = F.sequence(F.lit(0), n - 1)

    def step(a: Column, i: Column) -> Column:
        t = typed[i]
        free = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda j: ~F.array_contains(a["used"], j))
        same = F.filter(free, lambda j: words[j] == t)
        longer = F.filter(free, lambda j: words[j].startswith(t) & (~t.rlike(r"^\d+$") | (i == n - 1)))
        hit = F.coalesce(F.get(same, F.lit(0)), F.get(longer, F.lit(0)))
        return F.struct((a["exact"] + (F.size(same) > 0).cast("int")).alias("exact"), F.when(hit.isNull(), a["used"]).otherwise(F.concat(a["used"], F.array(hit))).alias("used"), (a["ok"] & hit.isNotNull()).alias("ok"))

    done = F.aggregate(places, zero, step)
    out = let(done, lambda d: F.when(d["ok"], F.struct(d["exact"].alias("exact"), (F.size(words) - n).alias("extra"), F.length(F.array_join(words, " ")).alias("len"))))
    return F.when((n > 0) & (typed[0] != ""), out)
