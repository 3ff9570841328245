"""Cubes that follow their source: brute force after appends, deletions and replacements, and which files are read."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.sources import paths, store


class Kept:
    def __init__(self, spark, source, tables=()):
        self.spark, self.source, self.tables, self.read = spark, str(source), [str(t) for t in tables], []
        self.cubes = store.Cubes(self._fine, {"k": (lambda f: f.groupBy("k").agg(F.sum("n").alias("n")), ["k"]), "both": (lambda f: f, ["year", "k"])})

    def _fine(self, spark, at, rows):
        self.read.append(sorted(f.rsplit("/", 1)[-1] for f in rows.inputFiles()))
        return rows.groupBy("year", (F.col("id") % 5).alias("k")).agg(F.count("*").alias("n"))

    def get(self, kind="both"):
        return {tuple(r) for r in self.cubes.get(self.spark, kind, "at", self.source, self.tables).collect()}

    def want(self):
        return {tuple(r) for r in self.spark.read.parquet(self.source).groupBy("year", (F.col("id") % 5).alias("k")).agg(F.count("*").alias("n")).collect()}


def add(spark, source, year, low, high, files=2):
    spark.range(low, high, 1, files).withColumn("year", F.lit(year)).write.mode("append").partitionBy("year").parquet(str(source))


def test_an_append_to_a_partition_is_seen_and_only_new_files_are_read(spark, tmp_path):
    add(spark, tmp_path / "t", 2001, 0, 10)
    add(spark, tmp_path / "t", 2002, 0, 5)
    kept = Kept(spark, tmp_path / "t")
    assert sum(n for _, n in kept.get("k")) == 15 and kept.get() == kept.want()
    assert len(kept.read) == 2  # a part for each year
    before = {f.name for f in (tmp_path / "t").rglob("*.parquet")}
    add(spark, tmp_path / "t", 2001, 100, 107, 1)
    assert kept.get() == kept.want()
    assert len(kept.read) == 3 and not before & set(kept.read[-1]) and len(kept.read[-1]) == 1
    assert kept.get() == kept.want() and len(kept.read) == 3  # nothing changed, nothing read


def test_deleted_and_replaced_files(spark, tmp_path):
    for year in (2001, 2002, 2003):
        add(spark, tmp_path / "t", year, year, year + 50)
    kept = Kept(spark, tmp_path / "t")
    assert kept.get() == kept.want()
    files = sorted((tmp_path / "t" / "year=2002").glob("*.parquet"))
    files[0].unlink()
    kept.read.clear()
    assert kept.get() == kept.want() and kept.read == [[files[1].name]]  # what is left of that folder
    a, b = sorted((tmp_path / "t" / "year=2001").glob("*.parquet")), sorted((tmp_path / "t" / "year=2003").glob("*.parquet"))
    shutil.copy(a[0], b[0])  # replaced in place
    (b[0].parent / f".{b[0].name}.crc").unlink(missing_ok=True)
    kept.read.clear()
    assert kept.get() == kept.want() and len(kept.read) == 1 and len(kept.read[0]) == 2
    shutil.rmtree(tmp_path / "t" / "year=2001")
    kept.read.clear()
    assert kept.get() == kept.want() and not kept.read  # taken away without a look at the source


def test_other_tables_and_lost_cubes(spark, tmp_path):
    add(spark, tmp_path / "t", 2001, 0, 30)
    spark.range(3).write.parquet(str(tmp_path / "names"))
    kept = Kept(spark, tmp_path / "t", [tmp_path / "names"])
    assert kept.get() == kept.want()
    spark.range(2).write.mode("append").parquet(str(tmp_path / "names"))
    assert kept.get() == kept.want() and len(kept.read) == 2
    (state,) = kept.cubes._states.values()
    paths.delete(spark, state.parts[0].fine)
    assert kept.get() == kept.want() and len(kept.read) == 3


@pytest.mark.parametrize("seed", [1])
def test_random_changes(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(store, "MERGED", 4)
    rng = random.Random(seed)
    kept, at = Kept(spark, tmp_path / "t"), 0
    add(spark, tmp_path / "t", 2000, 0, 9)
    for _ in range(12):
        files = sorted((tmp_path / "t").rglob("*.parquet"))
        if rng.random() < 0.35 and len(files) > 2:
            rng.choice(files).unlink()
        else:
            at += 20
            add(spark, tmp_path / "t", rng.randrange(2000, 2003), at, at + rng.randrange(1, 15), rng.choice([1, 2]))
        assert kept.get() == kept.want()
    (state,) = kept.cubes._states.values()
    assert len(state.parts) <= 6


def test_a_source_that_is_one_file(spark, tmp_path):
    spark.range(7).withColumn("year", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    kept = Kept(spark, file)
    assert kept.get() == kept.want() == {(1, k, 2 if k < 2 else 1) for k in range(5)}
