"""What people type: corners, precincts, addresses, streets, areas."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.grid import let, point_along
from tessera.functions.names import HYPHEN_BASE, block_of, match_words, street_key, strip_accents

# How boroughs are written at the end of a search, and their order in lists.
BOROUGHS = (
    (r"\b(?:manhattan|mn|new york)$", 1), (r"\b(?:the bronx|bronx|bx)$", 2), (r"\b(?:brooklyn|bk|bklyn)$", 3), (r"\b(?:queens|qn|qns)$", 4), (r"\b(?:staten island|si|staten)$", 5),
)
LIST_ORDER = (1, 3, 4, 2, 5)
PRECINCT = (r"^(?:precinct|pct\.?|pc)\s*#?\s*(\d{1,3})(?:st|nd|rd|th)?$", r"^(\d{1,3})(?:st|nd|rd|th)?\s*(?:precinct|pct\.?|pc)$")
BARE_NUMBER = r"^(\d{1,3})(st|nd|rd|th)?$"
ADDRESS = r"^(\d+(?:-\d+)?)[a-z]?\s+(.+)$"
CORNER = r"\s+(?:and|at)\s+|\s*[&/@]\s*"


@dataclass(frozen=True)
class Route:
    """Which rule answers a search: corner, precinct, address or text; and the precinct that its number names beside that."""

    rule: str
    text: str
    borough: int = 0
    parts: tuple[str, ...] = ()
    precinct: int = 0


def route(raw: str) -> Route:
    text, borough = re.sub(r"\s+", " ", raw.strip().replace(",", " ")), 0
    for pattern, b in BOROUGHS:
        if (m := re.search(pattern, text, re.I)) and m.start() > 0:
            text, borough = text[: m.start()].strip(), b
            break
    parts = tuple(p.strip() for p in re.split(CORNER, text, flags=re.I) if p.strip())
    if len(parts) == 2 and not parts[0].isdigit():
        return Route("corner", text, borough, parts)
    named = next((m[1] for p in PRECINCT if (m := re.match(p, text, re.I))), None)
    bare = re.match(BARE_NUMBER, text, re.I)
    if named or bare and not bare[2]:
        number = named or bare[1]
        return Route("precinct", text, borough, (number,), int(number))
    if m := re.match(ADDRESS, text, re.I):
        return Route("address", text, borough, m.groups())
    return Route("text", text, borough, precinct=int(bare[1]) if bare else 0)  # "75th": a street, and the precinct


def routes(typed: Column) -> Column:
    """``route`` for a column of searches: struct(rule, text, borough, parts, precinct)."""
    whole = F.regexp_replace(F.regexp_replace(F.trim(typed), ",", " "), r"\s+", " ")

    def named(text: Column) -> Column:
        """The text without the first borough, in their order, that ends it behind something else."""
        found = [(F.regexp_instr(text, F.lit(f"(?i){pattern}")), b) for pattern, b in BOROUGHS]
        hits = [F.when(at > 1, F.struct(F.rtrim(F.substring(text, F.lit(1), at - 1)).alias("text"), F.lit(b).alias("borough"))) for at, b in found]
        return F.coalesce(*hits, F.struct(text.alias("text"), F.lit(0).alias("borough")))

    def answered(at: Column) -> Column:
        text, none = at["text"], F.array().cast("array<string>")
        parts = F.filter(F.transform(F.split(text, f"(?i){CORNER}"), lambda x: F.trim(x)), lambda x: x != "")
        number = F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){x}", 1), F.lit("")) for x in PRECINCT])
        bare, ending = (F.nullif(F.regexp_extract(text, f"(?i){BARE_NUMBER}", k), F.lit("")) for k in (1, 2))
        precinct = F.coalesce(number, F.when(ending.isNull(), bare))
        row = lambda rule, parts, n: F.struct(F.lit(rule).alias("rule"), text.alias("text"), at["borough"].alias("borough"), parts.alias("parts"), F.coalesce(n.cast("int"), F.lit(0)).alias("precinct"))
        address = F.array(*[F.regexp_extract(text, f"(?i){ADDRESS}", k) for k in (1, 2)])
        out = F.when((F.size(parts) == 2) & ~parts[0].rlike("^[0-9]+$"), row("corner", parts, F.lit(None))).when(precinct.isNotNull(), row("precinct", F.array(precinct), precinct))
        return out.when(address[0] != "", row("address", address, F.lit(None))).otherwise(row("text", none, bare))

    return let(whole, lambda t: let(named(t), answered))


def _scored(rows: DataFrame, typed: str, keep: list[str]) -> DataFrame:
    """keep..., alias, exact, extra, len of rows (key, aliases) that match the array of typed words."""
    own = match_words(F.col(typed), F.split("key", " "))
    others = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: match_words(F.col(typed), F.split(a, " "))), lambda s: s.isNotNull())
    most = F.array_max(F.transform(others, lambda s: s["exact"]))
    best = F.get(F.filter(others, lambda s: s["exact"] == most), F.lit(0))  # of equal aliases the first
    scored = rows.withColumn("_own", own).withColumn("_s", F.coalesce("_own", best)).where("_s IS NOT NULL")
    return scored.select(*keep, F.col("_own").isNull().cast("int").alias("alias"), "_s.exact", "_s.extra", "_s.len")


def match_streets(streets: DataFrame, typed: str, borough: int = 0, limit: int | None = None) -> DataFrame:
    """streets (id, key, aliases: array of keys, boro) that match, best first: alias, exact, extra, len beside them."""
    one = streets.sparkSession.range(1).select(F.split(street_key(F.lit(typed)), " ").alias("_typed"))
    rows = streets.where(F.col("boro") == borough) if borough else streets
    out = _scored(rows.crossJoin(F.broadcast(one)), "_typed", streets.columns)  # one row
    out = out.orderBy(*_best())
    return out.limit(limit) if limit else out


def _best() -> list:
    """A name's own key comes before its aliases', then more exact words, fewer further words, shorter keys, boroughs and ids."""
    return ["alias", F.desc("exact"), "extra", "len", "boro", "id"]


#: Code points of a word that the index has prefixes of; longer typed words meet the words that share so many.
PREFIX = 8


def prefix_index(streets: DataFrame) -> DataFrame:
    """prefix, id: the streets that have a word, in their own key or an alias, which starts so. To be stored in order of prefix."""
    keys = F.concat(F.array("key"), F.coalesce("aliases", F.array().cast("array<string>")))
    words = streets.select("id", F.explode(F.array_distinct(F.flatten(F.transform(keys, lambda k: F.split(k, " "))))).alias("_w")).where("_w <> ''")
    starts = F.transform(F.sequence(F.lit(1), F.least(F.lit(PREFIX), F.length("_w"))), lambda n: F.substring("_w", F.lit(1), n))
    return words.select("id", F.explode(starts).alias("prefix")).distinct().select("prefix", "id")


def match_many(searches: DataFrame, streets: DataFrame, index: DataFrame, search: str = "search", typed: str = "typed") -> DataFrame:
    """searches (search, typed), each with the streets that match: search, the streets' columns, alias, exact, extra, len and rank
    (from 1, best first).

    Each search meets the streets through the rarest of its words in the index (``prefix_index``), by an equi-join; the matcher
    looks at those alone. Every typed word must start a word of the street, so no match is lost."""
    words = searches.select(search, F.split(street_key(F.col(typed)), " ").alias("_typed"))
    probes = words.select(search, F.explode(F.array_distinct(F.transform("_typed", lambda w: F.left(w, F.lit(PREFIX))))).alias("prefix")).where("prefix <> ''")
    wanted = probes.select("prefix").distinct()
    common = index.join(wanted, "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("_n"))
    rare = probes.join(common, "prefix", "left").groupBy(search).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "prefix")).alias("_p"))
    rare = rare.where("_p.n > 0").select(search, "_p.prefix")
    met = rare.join(index, "prefix").join(words, search).join(streets, "id")
    scored = _scored(met, "_typed", [search, *streets.columns])
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(search).orderBy(*_best())))


def find_corners(corners: DataFrame, first: DataFrame, second: DataFrame, limit: int = 6) -> DataFrame:
    """Corners (a, b, x, y) of a street of each list (id, rank), in either order; one for each place, best ranks first."""
    one, two = first.select(F.col("id").alias("a"), F.col("rank").alias("ra")), second.select(F.col("id").alias("b"), F.col("rank").alias("rb"))
    turned = corners.select("a", "b", "x", "y").unionByName(corners.select(F.col("b").alias("a"), F.col("a").alias("b"), "x", "y"))
    met = turned.join(one, "a").join(two, "b").withColumn("rank", F.col("ra") * 100 + F.col("rb"))
    return met.groupBy("x", "y").agg(F.min(F.struct("rank", "a", "b")).alias("s")).select("x", "y", "s.rank", "s.a", "s.b").orderBy("rank", "x", "y").limit(limit)


def side_fraction(lo: Column, hi: Column, n: Column) -> Column:
    """Where a number falls on one side of a segment, null if it can't be there: same parity and class, inside the range."""
    fits = (lo > 0) & (hi > 0) & ((lo >= HYPHEN_BASE) == (n >= HYPHEN_BASE)) & n.between(F.least(lo, hi), F.greatest(lo, hi)) & (lo % 2 == n % 2)
    return F.when(fits, F.when(lo == hi, 0.5).otherwise(F.try_divide((n - lo).cast("double"), hi - lo)))


#: Levels of numbers: blocks of 100, 1,000, ... numbers, up to one for all.
LEVELS = tuple(10**k for k in range(2, 11))


def _blocks(lo: str, hi: str) -> Column:
    """The blocks (level, block) that a side's numbers reach over, on the finest level where those are 11 at most: a range of any
    width has few. None for a side without numbers."""
    low, high = F.least(lo, hi).cast("bigint"), F.greatest(lo, hi).cast("bigint")
    out = F.array().cast("array<struct<level: bigint, block: bigint>>")
    for size in reversed(LEVELS):
        blocks = F.transform(F.sequence(F.floor(low / size), F.floor(high / size)), lambda b: F.struct(F.lit(size).cast("bigint").alias("level"), b.alias("block")))  # noqa: B023
        out = F.when((low > 0) & (high - low <= 10 * size), blocks).otherwise(out)
    return out


def locate_addresses(wanted: DataFrame, segments: DataFrame) -> DataFrame:
    """wanted (street, number) on segments (seg, street, lf, lt, rf, rt): street, number, seg and t of the first that fits.

    The left side is tried before the right. Numbers meet segments by street and block of numbers, so a long street is no hot
    key; a segment whose numbers reach far is found by larger blocks. Numbers look in the levels that the segments use."""
    n = F.col("number")
    t = F.coalesce(side_fraction(F.col("lf"), F.col("lt"), n), side_fraction(F.col("rf"), F.col("rt"), n))
    by_block = segments.withColumn("_b", F.explode(F.array_distinct(F.concat(_blocks("lf", "lt"), _blocks("rf", "rt")))))
    levels = F.array(*[F.lit(x).cast("bigint") for x in LEVELS])
    asked = wanted.withColumn("_b", F.explode(F.transform(levels, lambda size: F.struct(size.alias("level"), F.floor(n / size).alias("block")))))
    found = asked.join(by_block, ["street", "_b"]).withColumn("t", t).where("t IS NOT NULL")
    return found.groupBy("street", "number").agg(F.min(F.struct("seg", "t")).alias("s")).select("street", "number", "s.seg", "s.t")


def address_points(located: DataFrame, shapes: DataFrame) -> DataFrame:
    """located with x and y at its fraction of the segment's shape (seg, points)."""
    at = located.join(shapes, "seg").withColumn("_p", point_along(F.col("points"), F.col("t")))
    return at.select("street", "number", "seg", "t", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def plain(text: Column) -> Column:
    """Lower case without accents and signs, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(text)), "[^a-z0-9 ]", " "), r"\s+", " "))


def natural_key(text: Column) -> Column:
    """Sorts as people do: runs of digits by their number. Up to 12 digits are filled with zeros; longer numbers get a sign that
    sorts behind all digits for each digit more."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|[^\d]+)"), F.lit(1))

    def filled(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+", "")
        return F.when(F.length(digits) <= 12, F.lpad(digits, 12, "0")).otherwise(F.concat(F.repeat(F.lit(":"), F.length(digits) - 12), digits))

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), filled(p)).otherwise(p)), "")


def search_areas(places: DataFrame, typed: str, borough: int = 0) -> DataFrame:
    """places (label, boro, ...) whose name is the text (rank 0), starts with it (1) or has a word that does (2)."""
    q = plain(F.lit(typed))
    name = plain(F.col("label"))
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(F.exists(F.split(name, " "), lambda w: w.startswith(q)), 2)
    rows = places.where((F.col("boro") == borough) | F.col("boro").isNull()) if borough else places
    return rows.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("order_key", natural_key(F.col("label")))


def borough_lists(places: DataFrame) -> DataFrame:
    """All places by borough (in the order of lists), then by natural order: section (from 0) and order_key."""
    section = F.array_position(F.array(*[F.lit(b) for b in LIST_ORDER]), F.col("boro")) - 1
    return places.withColumn("section", section.cast("int")).where("section >= 0").withColumn("order_key", natural_key(F.col("label")))


def block_segments(segments: DataFrame, block: Column) -> DataFrame:
    """Segments (lf, lt, rf, rt) of a block: those whose middle house number, of the first side with numbers, falls in it."""
    has = lambda lo, hi: (F.col(lo) > 0) & (F.col(hi) > 0)
    middle = F.when(has("lf", "lt"), F.floor((F.col("lf") + F.col("lt")) / 2)).when(has("rf", "rt"), F.floor((F.col("rf") + F.col("rt")) / 2)).otherwise(-1)
    return segments.where(block_of(middle) == block)


def cross_streets(ends: DataFrame, corners: DataFrame, reach: int = 6) -> DataFrame:
    """Streets that meet a block's ends: ends (street, x, y) near corners (a, b, x, y) of that street, in units of 1e-5 degree.

    Both meet by street and cell: a corner is in one, an end is given to all that its reach touches, four at most. So a street of
    any number of corners is no hot key. Neither side is broadcast: pairs and cells make each far larger than Spark's estimate."""
    either = corners.select(F.col("a").alias("street"), F.col("b").alias("other"), F.col("x").alias("cx"), F.col("y").alias("cy")).unionByName(corners.select(F.col("b").alias("street"), F.col("a").alias("other"), F.col("x").alias("cx"), F.col("y").alias("cy")))
    cell = lambda c: F.floor(c / max(4 * reach, 1))
    touched = lambda c: F.explode(F.sequence(cell(F.col(c).cast("bigint") - reach), cell(F.col(c).cast("bigint") + reach)))
    around = ends.select("street", "x", "y", touched("x").alias("_i")).withColumn("_j", touched("y"))
    at = either.withColumns({"_i": cell(F.col("cx")), "_j": cell(F.col("cy"))})
    dx, dy = F.col("x").cast("bigint") - F.col("cx"), F.col("y").cast("bigint") - F.col("cy")
    return around.hint("merge").join(at, ["street", "_i", "_j"]).where(dx * dx + dy * dy <= reach * reach).select("street", "x", "y", "other").distinct()
