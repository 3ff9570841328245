"""Where tables of our own lie, and the few things that are done to paths."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where one process is both, a folder of our own
    stands in for it; on a cluster no local folder would do."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_tessera_dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        own = tempfile.mkdtemp(prefix="tessera-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = spark.sparkContext._tessera_dir = f"file://{own}"
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder, once none of its results is read any more."""
    delete(spark, own_dir(spark))


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and what reads it twice doesn't make it twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as listings have it."""
    fs, where = _hadoop(spark, path)
    return fs.makeQualified(where).toString()


def rename(spark: SparkSession, path: str, target: str) -> None:
    fs, where = _hadoop(spark, path)
    if not fs.rename(where, _hadoop(spark, target)[1]):
        raise OSError(f"{path} can't be renamed to {target}")


_STATUS = re.compile(r"path=(.+?); isDirectory=(true|false);(?: length=(\d+);)?.*?modification_time=(\d+);")


def listing(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Size and time of change of every data file under a path, however deep: one look a folder. Files and folders whose names
    begin with _ or . are none, as in Spark's own listing (whose memory in the driver is of the same order)."""
    out: dict[str, tuple[int, int]] = {}
    fs, where = _hadoop(spark, path)
    show = spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString
    left = [where]
    while left:
        at = left.pop()
        for name, folder, size, time in _STATUS.findall(show(fs.listStatus(at))):
            if name.rsplit("/", 1)[-1][:1] in "_.":
                continue
            if folder == "true":
                left.append(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name))
            else:
                out[name] = int(size), int(time)
    return out


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, those changed last at the end; none if there is no such folder."""
    if not exists(spark, path):
        return []
    fs, where = _hadoop(spark, path)
    found = _STATUS.findall(spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(where)))
    return [name for _, name in sorted((int(time), name) for name, folder, _, time in found if folder == "true")]


def snapshot(spark: SparkSession, *tables: str) -> str:
    """A hash of the files that tables consist of: their names, sizes and times of change."""
    parts = [f"{f} {size} {time}" for t in tables for f, (size, time) in sorted(listing(spark, t).items())]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()
