"""From raw text records to a typed fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes and descriptions whose places stay hidden.
WITHHELD_CODES = (104, 116, 233)
BOX = (40.49, 40.92, -74.27, -73.68)
# Road types that people may search, and names of what is no street.
ROAD_TYPES = (1, 2, 3, 4, 5, 7, 10)
NO_STREET = r"PEDESTRIAN|\bOPAS\b|\bOVPS\b|\bPED\b|\b(EN|ET|EX)\b|\bEXIT\b|ENTRANCE|ENTRY|\bRAMP\b|\bRP\b"


def null_normalize(c: Column) -> Column:
    """Blank text and the placeholder '(null)' become null."""
    t = F.trim(c)
    return F.when((t != "") & (t != "(null)"), t)


def lenient_timestamp(c: Column) -> Column:
    """ISO text (with T or a space), else month/day/year; null if neither."""
    return F.coalesce(F.replace(c, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"), F.try_to_timestamp(c, F.lit("MM/dd/yyyy")).cast("timestamp_ntz"))


def lenient_int(c: Column, kind: str = "int") -> Column:
    """Whole numbers in text, decimals rounded half away from zero; null for anything else or out of range."""
    return F.round(F.trim(c).try_cast("double"), 0).try_cast(kind)


def hour_of(c: Column) -> Column:
    """The hour at the start of a time's text, -1 if there is none."""
    return F.coalesce(F.substring(c, 1, 2).try_cast("tinyint"), F.lit(-1).cast("tinyint"))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def same_place(lat: Column, lon: Column, at_lat: float, at_lon: float, eps: float = 1e-7) -> Column:
    """Float coordinates within eps of a place, as ranges that reach the scan."""
    near = lambda c, v: c.between(F.lit(v - eps).cast("float"), F.lit(v + eps).cast("float"))
    return near(lat, at_lat) & near(lon, at_lon)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], tie: list[str]) -> DataFrame:
    """One whole row for each key: the first by order, then by the columns of tie. Null keys are a key.

    The minimum of a struct, so map tasks pre-aggregate and no key's rows are gathered or sorted. order: columns that sort
    ascending; nulls come last."""
    rank = [x for i, c in enumerate(order) for x in (c.isNull().alias(f"n{i}"), c.alias(f"o{i}"))]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*rank, *[df[t].alias(f"t_{t}") for t in tie])).alias("_row"))
    return best.select("_row.*")


def anti_guard(facts: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Distinct non-null keys that the dictionary lacks."""
    codes = facts.where(facts[key].isNotNull()).select(facts[key].alias("code")).distinct()
    return codes.join(known.select(known[known_key].alias("code")).distinct(), "code", "left_anti")


def withheld_points(df: DataFrame, code: Column, lat: Column, lon: Column, codes: tuple[int, ...] = WITHHELD_CODES) -> DataFrame:
    """Distinct pairs of coordinates at which an event of a withheld code lies."""
    return df.where(code.isin(*codes) & lat.isNotNull() & lon.isNotNull()).select(lat.alias("lat_raw"), lon.alias("lon_raw")).distinct()


def classify_location(df: DataFrame, sensitive: Column, lat: str, lon: str, withheld: DataFrame, box=BOX) -> DataFrame:
    """df with location_type: precinct_only (sensitive, or on a withheld point), point (in the box), none; lat and lon
    survive for points alone. The points are a few per city block; Spark broadcasts them if their size allows."""
    flagged = df.join(withheld.select(F.col("lat_raw").alias("_wlat"), F.col("lon_raw").alias("_wlon")), (df[lat] == F.col("_wlat")) & (df[lon] == F.col("_wlon")), "left")
    kind = F.when(F.coalesce(sensitive, F.lit(False)) | F.col("_wlat").isNotNull(), "precinct_only").when(in_box(df[lat], df[lon], box), "point").otherwise("none")
    typed = flagged.withColumn("location_type", kind).drop("_wlat", "_wlon")
    shown = F.col("location_type") == "point"
    return typed.withColumns({lat: F.when(shown, F.col(lat)), lon: F.when(shown, F.col(lon))})


def dictionary_join(facts: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Inner joins to small dictionaries by one shared column each; Spark broadcasts them by their known size."""
    for dim, key in dims:
        facts = facts.join(dim, key)
    return facts


def left_default(facts: DataFrame, dim: DataFrame, key: str, value: str, default: int = -1) -> DataFrame:
    """A looked-up code, or the default where the dictionary has no such key."""
    return facts.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def dense_ids(df: DataFrame, key: str, first_seen: str) -> DataFrame:
    """Dictionary of keys with ids 0, 1, ... in order of first appearance, then key. The window runs over the dictionary, in one
    task: for codes, types and the like, not for keys that grow with the rows."""
    seen = df.groupBy(key).agg(F.min(first_seen).alias("seen"))
    return seen.select(key, (F.row_number().over(Window.orderBy("seen", key)) - 1).cast("bigint").alias("id"))


def frequency_ids(df: DataFrame, key: str) -> DataFrame:
    """Dictionary of non-null keys with ids 0, 1, ... from the most frequent on, then by key. The window runs over the dictionary."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.select(key, "n", (F.row_number().over(Window.orderBy(F.desc("n"), key)) - 1).cast("bigint").alias("id"))


def searchable(rw_type: Column, name: Column, boro: Column) -> Column:
    """Segments that people may search: fixed road types, a name that is no ramp or footway, a borough."""
    return rw_type.isin(*ROAD_TYPES) & (F.trim(name) != "") & ~name.rlike(NO_STREET) & boro.between(1, 5)


def alias_groups(df: DataFrame, keys: list[str], name: str, least: int = 2, most: int = 4) -> DataFrame:
    """Names under one key, where there are a few: keys..., name, aliases (the others, in order).

    Groups are counted before they are gathered, so no list grows beyond ``most``."""
    names = df.select(*keys, name).where(F.col(name).isNotNull()).distinct()
    few = names.groupBy(*keys).count().where(F.col("count").between(least, most)).drop("count")
    lists = names.join(few, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(name)).alias("_all"))
    flat = lists.select(*keys, "_all", F.explode("_all").alias(name))
    return flat.select(*keys, name, F.array_join(F.array_remove(F.col("_all"), F.col(name)), " | ").alias("aliases"))
