"""Readers and writers of the record store, dictionaries, shapes and cubes."""

from __future__ import annotations

import csv
import io
import time
import urllib.error
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.reconcile import same_rows, sheet_totals
from tessera.sources import paths
from tessera.sources.ship import ship


def read_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files whose columns may differ, by name, all as text."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.select(*[df[c].cast("string").alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, view: str | None = None, cache: bool = False) -> DataFrame:
    """One Parquet table, optionally as a view and kept in memory."""
    df = spark.read.parquet(path)
    df = df.cache() if cache else df
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_dictionary(spark: SparkSession, path: str, types: str | None = None) -> DataFrame:
    """CSV with a header: all text, or typed by a DDL string with blanks as null."""
    reader = spark.read.option("header", "true").option("inferSchema", "false")
    return reader.schema(types).option("nullValue", "").csv(path) if types else reader.csv(path)


def read_polygons(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A GeoJSON feature collection: code (as it stands), sort_key (the code with zeros before it up to 8 characters; features
    in order of it count as first), properties, rings of x and y.

    Polygons and multipolygons give one row a feature; holes are rings like any other (even-odd)."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    code = F.element_at("f.properties", key)
    sort_key = F.when(F.length(code) < 8, F.lpad(code, 8, "0")).otherwise(code)
    one = F.array(F.from_json("f.geometry.coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))
    many = F.from_json("f.geometry.coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))
    parts = F.when(F.col("f.geometry.type") == "Polygon", one).otherwise(many)
    rings = F.transform(F.flatten(parts), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return features.select(code.alias("code"), sort_key.alias("sort_key"), F.col("f.properties").alias("properties"), rings.alias("rings"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited GeoJSON segments: properties and points (lon as x, lat as y)."""
    schema = "properties map<string, string>, geometry struct<type: string, coordinates: array<array<double>>>"
    rows = spark.read.schema(schema).json(path)
    return rows.select("properties", F.transform("geometry.coordinates", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))


def write_segments(df: DataFrame, path: str, properties: list[str]) -> None:
    """Segments (points: array<struct<lat, lon>>) as line-delimited GeoJSON, as many files as df has partitions."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    df.select(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), line.alias("geometry")).write.json(path)


def write_cube(df: DataFrame, path: str, order: list[str], files: int | None = None, rows_per_group: int = 16_384) -> None:
    """Parquet in a total order, with small row groups so that range predicates skip most of the file."""
    spread = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", rows_per_group).parquet(path)


def write_text_table(df: DataFrame, path: str, kind: str = "csv", one_file: bool = True) -> None:
    """A table as CSV with a header, or as JSON lines: a dictionary in one file, or a file for each partition."""
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)


def write_geojson(df: DataFrame, path: str, key: str, rings: str = "rings", keep: list[str] = (), most: int = 10_000) -> None:
    """Polygons (a row each, rings of x and y) as one GeoJSON feature collection, in order of their key. For the few hundred
    areas of a map: the text is one row, so more than ``most`` are refused."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} areas: write them as segments or tables")
    numbers = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    properties = F.struct(F.col(key).cast("string").alias(key), *[F.col(c) for c in keep])
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), numbers.alias("coordinates")).alias("geometry")))
    rows = df.select(F.struct(F.col(key).alias("k"), feature.alias("f")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("all"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("all", lambda s: s["f"]), ","), F.lit("]}"))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    """value: the table's rows as lines of Markdown (whole numbers with thousands marked, nulls empty), in whatever order df has."""
    cells = []
    for c, kind in df.dtypes:
        text = F.format_number(df[c], 0) if kind in ("tinyint", "smallint", "int", "bigint") else df[c].cast("string")
        cells.append(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_head(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """The first rows of a small table, as they are ordered, in Markdown."""
    return "\n".join([*markdown_head(df), *(r[0] for r in markdown_lines(df.limit(most)).collect())]) + "\n"


def rewrite_verified(spark: SparkSession, path: str, target: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, replace: bool = False) -> bool:
    """Write a table anew beside the old one; False, and nothing kept, unless both hold the same rows, equally often. With
    replace the new table then takes the old one's place: no moment has neither."""
    old = spark.read.parquet(path)
    change(old).write.mode("overwrite").option("compression", "zstd").parquet(target)
    if not same_rows(old, spark.read.parquet(target)):
        paths.delete(spark, target)
        return False
    if replace:
        aside = f"{path.rstrip('/')}.old"
        paths.rename(spark, path, aside)
        paths.rename(spark, target, path)
        paths.delete(spark, aside)
        spark.catalog.refreshByPath(path)
    return True


def as_json(df: DataFrame) -> DataFrame:
    """value: the rows as JSON objects."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def answer(spark: SparkSession, sql: str) -> Iterator[str]:
    """The rows of a query as JSON objects, for a thin service in front; a partition at a time, so a large answer streams by."""
    return spark.sql(sql).toJSON().toLocalIterator()


def with_retry(fetch: Callable[[], bytes], tries: int = 6, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """fetch(), again after 5, 10, 20, ... (120 at most) seconds; client errors other than 429 are final."""
    for i in range(tries):
        try:
            return fetch()
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code != 429 or i == tries - 1:
                raise
        except OSError:
            if i == tries - 1:
                raise
        sleep(min(5 * 2**i, 120))
    raise AssertionError("unreachable")


class _Page(InputPartition):
    def __init__(self, year: int) -> None:
        super().__init__(year)


class PagedRecords(DataSource):
    """Paged records over HTTP, a partition for each year: .format("paged").option("url", ...).option("years", "2016,2017").

    The url has {year}, {offset} and {limit}; pages are JSON arrays of objects; a short page ends a year. With the option
    count_url (with {year}; it answers [{"n": ...}]), a year that has more or fewer rows than the source says fails."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "year int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format "paged" known, and its code to the workers that read it."""
    ship(spark)
    spark.dataSource.register(PagedRecords)


class _PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.url, self.limit, self.count_url = options["url"], int(options.get("limit", "50000")), options.get("count_url")
        self.years = [int(y) for y in options["years"].split(",")]

    def partitions(self):
        return [_Page(y) for y in self.years]

    def read(self, partition) -> Iterator[tuple]:
        import json
        import urllib.request

        load = lambda url: json.loads(with_retry(lambda: urllib.request.urlopen(url, timeout=120).read()))
        year, offset = partition.value, 0
        expected = int(load(self.count_url.format(year=year))[0]["n"]) if self.count_url else None
        while True:
            page = load(self.url.format(year=year, offset=offset, limit=self.limit))
            yield from ((year, json.dumps(r)) for r in page)
            offset += len(page)
            if len(page) < self.limit:
                break
        if expected is not None and offset != expected:
            raise ValueError(f"{year}: {offset} rows, but the source counts {expected}")


def download(spark: SparkSession, path: str, years: list[int], force: tuple[int, ...] = (), **options: str) -> list[int]:
    """Years of a paged source as Parquet, a folder each; returns those that were read now. A year's folder is complete or
    absent, so a run that broke off goes on where it stopped; the folders are the manifest. Years of force are read again."""
    register(spark)
    read = []
    for year in years:  # a few, each read by its own job
        final, part = f"{path}/rpt_year={year}", f"{path}/.part-{year}"
        if year not in force and paths.exists(spark, f"{final}/_SUCCESS"):
            continue
        spark.read.format("paged").options(**options, years=str(year)).load().drop("year").write.mode("overwrite").parquet(part)
        paths.delete(spark, final)
        paths.rename(spark, part, final)
        read.append(year)
    return read


def read_sheet(spark: SparkSession, path: str) -> list[list[str]]:
    """The rows of a small sheet that was saved as CSV, ragged as they are: published tables of a few hundred rows."""
    text = spark.read.text(path, wholetext=True).first()
    return list(csv.reader(io.StringIO(text[0]))) if text else []


def read_sheets(spark: SparkSession, path: str, corner: str, prefixes: dict[str, int], years: range, unit: bool = False) -> DataFrame:
    """unit, code, year, n of all published sheets (CSV files of a few hundred rows each) under a path: a file is read by one task,
    whatever their number."""
    ship(spark)

    def parse(batches):
        for batch in batches:
            rows = [x for text in batch["value"] for x in sheet_totals(list(csv.reader(io.StringIO(text))), corner, prefixes, years, unit)]
            yield pd.DataFrame(rows, columns=["unit", "code", "year", "n"])

    sheets = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return sheets.mapInPandas(parse, "unit string, code string, year int, n double")
