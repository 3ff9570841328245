"""Tables that are written once and read often: cubes that follow their source, answers of a snapshot."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.grid import in_ranges
from tessera.sources import files, paths

#: Parts of a cube at most that a first build makes: one for each folder of the source, or for a share of them.
PARTS = 64
#: Parts above which those of whole files are merged, from the cubes alone.
MERGED = 96


@dataclass
class _Part:
    """What some files of the source add up to: a fine cube, and those rolled up from it so far."""

    files: dict[str, tuple[int, int]]
    fine: str
    kinds: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, list[tuple[str, int, int]]] = field(default_factory=dict)


@dataclass
class _State:
    tables: list = field(default_factory=list)
    parts: list[_Part] = field(default_factory=list)
    retired: list[str] = field(default_factory=list)


class Cubes:
    """Cubes of counts (a column n) of one source table, kept up as its files come, go and change.

    Files are told apart by path, size and time of change, in all folders under the source. Each part of the cubes belongs to
    the files that it was made of; a first build makes one for each folder. Files that came are read, alone, into a part of
    their own. If files of a part went or changed, the part goes, which takes their counts away, and the files of it that are
    left are read again. What a cube says is the sum over its parts, so it equals one made anew. If one of the other
    tables that cubes are made with changes, all are made anew.

    One pass over the source makes a fine cube; all kinds are rolled up from it at their first use and written in the order of
    their keys. Tables that no answer needs any more are deleted one change later."""

    def __init__(self, fine: Callable[[SparkSession, str, DataFrame], DataFrame], kinds: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]]) -> None:
        self.fine, self.kinds = fine, kinds
        self._states: dict[tuple[str, str], _State] = {}
        self._schemas: dict[str, StructType] = {}  # so that no file is opened to find out

    def get(self, spark: SparkSession, kind: str, at: str, source: str, tables: list[str] = (), within: list[tuple[int, int]] | None = None) -> DataFrame:
        """at: what fine is given beside the rows of the source, the folder of its tables. within: ranges of the first key of the
        cube's order, which is whole numbers: only files that reach into them are opened, in these only such row groups read."""
        state = self.build(spark, [kind], at, source, tables)
        roll, order = self.kinds[kind]
        if not state.parts:
            return roll(self.fine(spark, at, spark.read.parquet(source))).limit(0)
        stored = spark.read.schema(self._schemas[kind])
        if within is None:
            cube = stored.parquet(*[p.kinds[kind] for p in state.parts])
        else:
            read = [f for p in state.parts for f, low, high in self._ranges(spark, p, kind) if any(low <= b and a <= high for a, b in within)]
            cube = stored.parquet(*read).where(in_ranges(F.col(order[0]), within)) if read else stored.parquet(state.parts[0].kinds[kind]).limit(0)
        return cube if len(state.parts) == 1 else cube.groupBy(*[c for c in cube.columns if c != "n"]).agg(F.sum("n").alias("n"))

    def build(self, spark: SparkSession, kinds: list[str], at: str, source: str, tables: list[str] = ()) -> _State:
        """Have the cubes of some kinds ready. Each is a job of its own, and jobs that have nothing to do with each other run at
        the same time."""
        state = self._followed(spark, at, source, list(tables))
        missing = [(part, kind) for part in state.parts for kind in kinds if kind not in part.kinds]

        def roll_up(part: _Part, kind: str) -> None:
            roll, order = self.kinds[kind]
            path, cube = paths.fresh_path(spark, f"cube-{kind}"), roll(spark.read.parquet(part.fine))
            files.write_cube(cube, path, order)
            part.kinds[kind], self._schemas[kind] = path, cube.schema

        if len(missing) > 1:
            with ThreadPoolExecutor(min(len(missing), 8)) as pool:
                list(pool.map(lambda x: roll_up(*x), missing))
        else:
            for part, kind in missing:
                roll_up(part, kind)
        return state

    def _ranges(self, spark: SparkSession, part: _Part, kind: str) -> list[tuple[str, int, int]]:
        """The files of a cube with their smallest and largest key: looked up once, kept as long as the cube is."""
        if kind not in part.ranges:
            key = self.kinds[kind][1][0]
            by = spark.read.parquet(part.kinds[kind]).groupBy(F.col("_metadata.file_path")).agg(F.min(key), F.max(key))
            part.ranges[kind] = [tuple(r) for r in by.collect()]  # a row a file
        return part.ranges[kind]

    def _followed(self, spark: SparkSession, at: str, source: str, tables: list[str]) -> _State:
        state = self._states.setdefault((spark.sparkContext.applicationId, source), _State())
        others = [paths.listing(spark, t) for t in tables]
        now = paths.listing(spark, source)
        gone = state.parts if others != state.tables else [p for p in state.parts if any(now.get(f) != x for f, x in p.files.items()) or not paths.exists(spark, p.fine)]
        held = {f for p in state.parts if p not in gone for f in p.files}
        new = {f: x for f, x in now.items() if f not in held}
        if not gone and not new:
            return state
        for old in state.retired:
            paths.delete(spark, old)
        state.retired = [x for p in gone for x in (p.fine, *p.kinds.values())]
        state.parts = [p for p in state.parts if p not in gone]
        state.tables = others
        groups: dict[int, dict] = {}
        names = sorted({f.rsplit("/", 1)[0] for f in new})
        number = {n: k if len(names) <= PARTS else zlib.crc32(n.encode()) % PARTS for k, n in enumerate(names)}
        for f, x in new.items():
            groups.setdefault(number[f.rsplit("/", 1)[0]], {})[f] = x
        for _, group in sorted(groups.items()):
            one = list(now) == [paths.qualified(spark, source)]  # a source that is a file
            rows = spark.read.parquet(source) if one else spark.read.option("basePath", source).parquet(*sorted(group))
            state.parts.append(self._part(spark, self.fine(spark, at, rows), group))
        if len(state.parts) > MERGED:
            self._merge(spark, state)
        return state

    def _part(self, spark: SparkSession, cube: DataFrame, of: dict) -> _Part:
        path = paths.fresh_path(spark, "cube")
        cube.write.parquet(path)
        return _Part(of, path)

    def _merge(self, spark: SparkSession, state: _State) -> None:
        """The parts of each folder as one: many small appends don't make reading slow. The source isn't read."""
        by: dict[int, list[_Part]] = {}
        for p in state.parts:
            by.setdefault(zlib.crc32(min(p.files).rsplit("/", 1)[0].encode()) % PARTS, []).append(p)
        state.parts = []
        for parts in by.values():
            if len(parts) > 1:
                both = spark.read.parquet(*[p.fine for p in parts])
                whole = both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))
                state.retired += [x for p in parts for x in (p.fine, *p.kinds.values())]
                parts = [self._part(spark, whole, {f: x for p in parts for f, x in p.files.items()})]
            state.parts += parts


class Answers:
    """Answers of SQL questions, kept under a folder for the snapshot that they come from. Those of older snapshots are deleted,
    but for the last ``keep``, which others may still read."""

    def __init__(self, spark: SparkSession, folder: str, snapshot: str, keep: int = 1) -> None:
        self.spark, self.folder, self.snapshot = spark, folder.rstrip("/"), snapshot
        older = [f for f in paths.folders(spark, self.folder) if not f.endswith(f"/{snapshot}")]
        for f in older[: len(older) - keep]:
            paths.delete(spark, f)

    def path(self, sql: str) -> str:
        return f"{self.folder}/{self.snapshot}/{hashlib.sha256(sql.encode()).hexdigest()}"

    def get(self, sql: str) -> DataFrame:
        path = self.path(sql)
        if not paths.exists(self.spark, f"{path}/_SUCCESS"):
            self.spark.sql(sql).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
