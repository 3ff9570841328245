"""What the Python-backed operators share: code for executors, tables that cut lineage, bounded batches."""

from __future__ import annotations

import ctypes
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.paths import delete, fresh_path, shared_dir  # noqa: F401
from tessera.sources.ship import ship  # noqa: F401

#: Partitions a core of tables of short rows, and of tables of long ones.
NARROW, WIDE = 2, 8
#: Bytes, as they are stored, of what a table grows with, for each of its partitions.
SHARE = 16 << 20


def read(spark: SparkSession, path: str, row: str | None = None) -> DataFrame:
    """A Parquet table. Where its files have fewer row groups than there are cores, the setting spark.tessera.split deals the
    rows over so many partitions; without it nothing is shuffled. row: a column for a hash of a row's file and place in it,
    which tells equal rows apart and is the same however often a task runs."""
    parts = spark.conf.get("spark.tessera.split", None)
    table = spark.read.parquet(path)
    if row:
        table = table.withColumn(row, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    return table.repartition(int(parts)) if parts else table


def shares(of: DataFrame) -> int:
    """How many times SHARE bytes a table has, as Spark estimates it before it is read."""
    size = int(str(of._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size // SHARE, 1_000_000)


def compact(df: DataFrame, of: DataFrame, per_core: int = WIDE) -> DataFrame:
    """df in as many partitions as keep a cluster busy (so many a core), or one for SHARE bytes of ``of``, the tables that it
    grows with, if those are more. Each task reads its share of shuffle partitions one after the other, so that there is no
    file for every small one."""
    spark = df.sparkSession
    return df.coalesce(max(per_core * spark.sparkContext.defaultParallelism, shares(of)))


def materialize(df: DataFrame, name: str, of: DataFrame | None = None, per_core: int = WIDE) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage is cut, lost executors cost nothing. With of it is
    made compact."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df if of is None else compact(df, of, per_core)).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for t in tables:
        delete(t.sparkSession, t._tessera_path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number for each row, and that column's name. It is a table, so a task that runs again finds the same numbers."""
    name = "_row"
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def give_back() -> None:
    """Return freed memory to the system: workers stay for a while after their task, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


_held: dict = {}
#: Seconds after which an idle worker drops what it holds.
IDLE = 2.0
_tasks = 0


def worker_cache(key, make):
    """What a Python worker keeps between tasks: the object of one key. Another key's replaces it, so that the stages of a
    pipeline, which share workers, don't add up their caches. Workers that get no further task soon drop it."""
    found = _held.get(key)
    if found is None:
        if _held:
            drop()
        found = _held[key] = make()
    return found


_also: list[Callable[[], None]] = []


def dropped_with(clear: Callable[[], None]) -> None:
    """Have clear() called whenever a worker drops what it holds: for the caches of vocabularies."""
    _also.append(clear)


def drop() -> None:
    _held.clear()
    for clear in _also:
        clear()
    give_back()


def _drop_when_idle(tasks: int) -> None:
    """Runs beside the worker's main thread, which waits for a task; another task that began meanwhile keeps the cache."""
    time.sleep(IDLE)
    if tasks == _tasks and _held:
        drop()


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most about ``limit`` bytes of text (one row at least)."""
    global _tasks
    _tasks += 1
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
        start = total = 0
        for i in range(n):
            size = sizes[i]
            size = 0 if size is None or size != size else int(size)
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)
        del batch, column, sizes
    give_back()
    threading.Thread(target=_drop_when_idle, args=(_tasks,), daemon=True).start()


_GAP = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, limit: int = 2_000_000) -> Iterator[str]:
    """A text in pieces of about ``limit`` characters. Each but the first starts with a space that stands alone between
    other characters: no word and no pre-token reaches over it."""
    start = 0
    while len(text) - start > limit and (gap := _GAP.search(text, start + limit)):
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


def parts(texts: list[str], limit: int = 2_000_000) -> Iterator[tuple[list[int], list[str]]]:
    """All texts, long ones in pieces, so many at a time that they have about ``limit`` characters: their rows and themselves."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, limit) if len(text) > limit else (text,):
            if held and size + len(piece) > limit:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(i), held.append(piece)
            size += len(piece)
    if held:
        yield rows, held
